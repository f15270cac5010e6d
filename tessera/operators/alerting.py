"""Verification of objects over time and alert levels per person: pure steps, used by batch and by streaming."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import THREAT, VERIFICATION, Threat, Verification
from tessera.operators.folds import ordered_fold, schema_of
from tessera.operators.gates import class_conf_ok
from tessera.operators.matching import attached
from tessera.operators.ordered import with_island
from tessera.operators.suppression import overlap_grid


@dataclass
class Seen:
    label: str
    box: np.ndarray
    seen: int = 1
    missed: int = 0


def persist(tracks: list[Seen], labels: list[str], boxes: np.ndarray, p: Verification = VERIFICATION) -> list[int]:
    """How often each detection of this cycle was seen; ``tracks`` is changed in place.

    A track takes the first free detection of its label that overlaps enough, and its box; the others age.
    """
    def same() -> np.ndarray:
        """Which tracks could be which detections."""
        if not tracks or not len(labels):
            return np.zeros((len(tracks), len(labels)), bool)
        near = overlap_grid(np.stack([t.box for t in tracks]), boxes, clamp=True) >= p.same_iou
        return near & (np.array([t.label for t in tracks])[:, None] == np.array(labels)[None, :])

    free = np.ones(len(labels), bool)
    could = same()
    for t, any_, row in zip(tracks, could.any(axis=1).tolist(), could):
        hits = np.flatnonzero(row & free) if any_ else ()
        if len(hits):
            free[hits[0]] = False
            t.box, t.seen, t.missed = boxes[hits[0]], t.seen + 1, 0
        else:
            t.missed += 1
    tracks += [Seen(labels[i], boxes[i]) for i in np.flatnonzero(free)]
    tracks[:] = [t for t in tracks if t.missed < p.forget_after]
    if not len(labels):
        return []
    now = same()
    return [tracks[k].seen if any_ else 0 for k, any_ in zip(now.argmax(axis=0).tolist(), now.any(axis=0).tolist())]


def persistence(candidates: DataFrame, p: Verification = VERIFICATION) -> DataFrame:
    """``candidates`` with ``seen``; a stream's cycles are its frames that hold or lack candidates, in order.

    Columns: stream_id, frame_id, cand_id, label and a box. A missing frame number is an empty cycle. After
    ``forget_after`` empty cycles nothing is remembered, so a stream is cut there, exactly, and its parts are folded on
    their own: a long stream is spread over its pauses.
    """
    w = Window.partitionBy("stream_id").orderBy("frame_id")
    pause = F.coalesce(F.col("frame_id") - F.lag("frame_id").over(w) > p.forget_after, F.lit(True))
    parts = candidates.select("stream_id", "frame_id").distinct().withColumn("_cut", F.when(pause, F.col("frame_id")))
    parts = parts.select(F.col("stream_id").alias("_s"), F.col("frame_id").alias("_f"), F.last("_cut", ignorenulls=True).over(w).alias("_part"))
    rows = candidates.join(parts, F.col("stream_id").eqNullSafe(F.col("_s")) & (F.col("frame_id") == F.col("_f"))).select(*candidates.columns, "_part")

    def step(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[int] = []
        frames, labels, boxes = pdf["frame_id"].to_numpy(), pdf["label"].tolist(), pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        edges = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)]
        for a, z in zip(edges, edges[1:]):
            before = state.get("frame")
            for _ in range(0 if before is None else min(int(frames[a] - before - 1), p.forget_after)):
                persist(state["tracks"], [], np.zeros((0, 4)), p)
            out += persist(state["tracks"], labels[a:z], boxes[a:z], p)
            state["frame"] = frames[a]
        return pdf.drop(columns="_part").assign(seen=out)

    return ordered_fold(rows, ["stream_id", "_part"], ["frame_id", "cand_id"], lambda: {"tracks": []}, step, schema_of(candidates) + ", seen int", whole="frame_id")


def verified(candidates: DataFrame, people: DataFrame, enabled: bool = True, need_person: bool = True, p: Verification = VERIFICATION) -> DataFrame:
    """``candidates`` (with seen) with ``verdict``: confirmed, or the first reason against it: conf, transient, no person."""
    if not enabled:
        return candidates.withColumn("verdict", F.lit("confirmed"))
    near = attached(candidates, people).select("frame_id", "cand_id", F.lit(True).alias("_near")).distinct()
    j = candidates.join(near, ["frame_id", "cand_id"], "left")
    stays = (F.col("seen") >= p.persistence) | (F.col("conf") >= p.bypass_conf)
    verdict = F.when(~class_conf_ok(F.col("label"), F.col("conf"), p), "conf").when(~stays, "transient")
    if need_person:
        verdict = verdict.when(F.col("_near").isNull(), "no person")
    return j.withColumn("verdict", verdict.otherwise("confirmed")).drop("_near")


def item_level(label: Column, method: Column, raised: Column, p: Threat = THREAT) -> Column:
    """Level of one held object: its base, one less if only overlapping, one more with a raised arm."""
    base = F.lit(p.other)
    for name, level in p.base.items():
        base = F.when(F.lower(label) == name, F.lit(level)).otherwise(base)
    firm = method.isin("wrist", "containment")
    return F.when(~firm, F.greatest(F.lit(0), base - 1)).when(raised, F.least(base + 1, F.lit(p.highest))).otherwise(base)


def desired_levels(held: DataFrame, keys: list[str], p: Threat = THREAT) -> DataFrame:
    """keys, desired, n: the level that a person's objects call for, from label, method, raised and approaching."""
    per = held.withColumn("_l", item_level(F.col("label"), F.col("method"), F.col("raised"), p)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("_l").alias("top"), F.countDistinct(F.lower("label")).alias("kinds"), F.bool_or(F.lower("label") == "guns").alias("guns"), F.bool_or("approaching").alias("near"))
    several = ((F.col("kinds") > 1) & F.col("guns")) | ((F.col("n") > 1) & (F.col("top") >= 2))
    level = F.when(several, F.lit(p.highest)).otherwise(F.col("top"))
    return per.select(*keys, F.when(F.col("near") & (level >= 1), F.least(level + 1, F.lit(p.highest))).otherwise(level).alias("desired"), "n")


@dataclass
class Calm:
    level: int = 0
    streak: int = field(default_factory=lambda: THREAT.calm_frames)


def settle(state: Calm, desired: int | None, p: Threat = THREAT) -> int:
    """Level after a frame: up at once, down one level only after a calm streak. ``desired`` None means no object."""
    if desired is None:
        state.streak += 1
        want = 0 if state.streak >= p.calm_frames else state.level
    else:
        state.streak, want = 0, desired
    if want > state.level:
        state.level = want
    elif want < state.level and state.streak >= p.calm_frames:
        state.level -= 1
        state.streak = 0
    return state.level


def levels(df: DataFrame, p: Threat = THREAT) -> DataFrame:
    """stream_id, person, frame_id, level from desired (null: no object). A missing frame forgets the person.

    Each unbroken presence is folded on its own, so a person's long history is spread over its visits.
    """
    def step(state: Calm, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["stream_id", "person", "frame_id"]].assign(level=[settle(state, None if pd.isna(x) else int(x), p) for x in pdf["desired"]])

    one = with_island(df.select("stream_id", "person", "frame_id", "desired"), ["stream_id", "person"], "frame_id")
    schema = schema_of(one, ["stream_id", "person", "frame_id"]) + ", level int"
    return ordered_fold(one, ["stream_id", "person", "island"], ["frame_id"], lambda: Calm(0, p.calm_frames), step, schema)


def emitted(at: np.ndarray, every: float, last: float = -np.inf) -> tuple[np.ndarray, float]:
    """Which of the ordered times are kept if each kept one silences the next ``every``, and the last kept."""
    keep, i = np.zeros(len(at), bool), 0
    while (i := i + int(np.searchsorted(at[i:], last + every, "left"))) < len(at):
        keep[i], last = True, at[i]
        i += every <= 0
    return keep, last


def deduplicated(df: DataFrame, keys: list[str], order: str, every: float, tie: str) -> DataFrame:
    """Rows that are logged if a key logs at most once per ``every``; the clock starts at the last logged row.

    The anchor moves with what is logged, so this is no fixed window but an ordered fold.
    """
    def step(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        keep, state["last"] = emitted(pdf[order].to_numpy(float), every, state["last"])
        return pdf[keep]

    return ordered_fold(df, keys, [order, tie], lambda: {"last": -np.inf}, step, schema_of(df))
