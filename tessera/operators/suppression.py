"""Folds within one frame or one ordered sequence, in numpy on Arrow groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.folds import ordered_fold, schema_of, whole_groups
from tessera.sources.workspace import Workspace


def pair_overlaps(a: np.ndarray, b: np.ndarray, clamp: bool = False) -> np.ndarray:
    """Intersection over union of the boxes of ``a`` with those of ``b`` in the same places; ``clamp`` takes each area as at least 1."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    inter = np.clip(w, 0, None) * np.clip(h, 0, None)
    area = [(x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1]) for x in (a, b)]
    if clamp:
        area = [np.maximum(1.0, x) for x in area]
    union = area[0] + area[1] - inter
    return np.where((inter > 0) & (union > 0), inter / np.where(union > 0, union, 1.0), 0.0)


def overlap_grid(a: np.ndarray, b: np.ndarray, clamp: bool = False) -> np.ndarray:
    """Intersection over union of every box of ``a`` with every one of ``b``."""
    return pair_overlaps(a[:, None], b[None, :], clamp)


def overlaps(box: np.ndarray, others: np.ndarray, clamp: bool = False) -> np.ndarray:
    return overlap_grid(np.asarray(box)[None, :], others, clamp)[0]


def kept_boxes(boxes: np.ndarray, order: np.ndarray, above: float) -> np.ndarray:
    """Which boxes stay if, in ``order``, each that stays removes the later ones that overlap it by more than ``above``."""
    keep = np.zeros(len(boxes), bool)
    gone = np.zeros(len(boxes), bool)
    for i in order:
        if not gone[i]:
            keep[i] = True
            gone |= overlaps(boxes[i], boxes) > above
    return keep


def suppress_duplicates(df: DataFrame, keys: list[str], row_id: str, above: float = 0.8) -> DataFrame:
    """``df`` without boxes that overlap a better one of their frame: matched before unmatched, then by confidence.

    The rule is recursive, a box that is removed removes none, so it is a fold per frame. Frames are spread over tasks.
    """
    def fold(b: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        boxes, ids, conf, loose = b[["x1", "y1", "x2", "y2"]].to_numpy(float), b[row_id].to_numpy(), -b["conf"].to_numpy(float), ~b["matched"].to_numpy(bool)
        keep = np.zeros(len(b), bool)
        for a, z in bounds:
            keep[a:z] = kept_boxes(boxes[a:z], np.lexsort((ids[a:z], conf[a:z], loose[a:z])), above)
        return b[keep]

    return whole_groups(df, keys, fold, schema_of(df))


def spread_samples(df: DataFrame, key: str, order: str, k: int = 16) -> DataFrame:
    """key, order, rank of each key's ``k`` most diverse vectors, chosen greedily from the first.

    Each round broadcasts or joins the one vector chosen last per key, brings every row's largest likeness to the chosen
    up to date and takes the row with the smallest, the earliest on ties: ``k`` grouped minima with map-side combine, so
    no key is ever held in one task. The likeness so far is written after each round.
    """
    ws = Workspace(df.sparkSession)
    rows = ws.table(df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col("feat").cast("array<double>").alias("_f"), F.lit(-2.0).alias("_near")))
    last = ws.table(rows.groupBy("_k").agg(F.min(F.struct("_o", "_f")).alias("b")).select("_k", F.col("b._o").alias("_c"), F.col("b._f").alias("_v")))
    out = last.select("_k", F.col("_c").alias("_o"), F.lit(0).alias("rank"))
    for r in range(1, k):
        like = F.aggregate(F.zip_with("_f", "_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        nxt = rows.join(last, "_k").where("_o <> _c").select("_k", "_o", "_f", F.greatest("_near", like).alias("_near"))
        nxt = ws.table(nxt)
        ws.drop(rows)
        rows = nxt
        last = ws.table(rows.groupBy("_k").agg(F.min(F.struct("_near", "_o", "_f")).alias("b")).select("_k", F.col("b._o").alias("_c"), F.col("b._f").alias("_v")))
        out = out.unionByName(last.select("_k", F.col("_c").alias("_o"), F.lit(r).alias("rank")))
    return out.select(F.col("_k").alias(key), F.col("_o").alias(order), "rank")


def best_before(boxes: np.ndarray, first: np.ndarray, n: np.ndarray, least: float, room: int = 1 << 20) -> np.ndarray:
    """For each box which of the ``n`` boxes from place ``first`` on overlaps it most, the earliest on ties; -1 if none by ``least``."""
    out = np.full(len(boxes), -1)
    ends = np.cumsum(n)
    a = 0
    while a < len(boxes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + room, "right")))
        at = a + np.flatnonzero(n[a:z])
        if len(at):
            k = n[at]
            starts = np.cumsum(k) - k
            j = np.arange(k.sum()) + np.repeat(first[at] - starts, k)
            o = pair_overlaps(np.repeat(boxes[at], k, axis=0), boxes[j])
            top = np.maximum.reduceat(o, starts)
            best = np.minimum.reduceat(np.where(o == np.repeat(top, k), j, len(boxes)), starts)
            out[at] = np.where(top >= least, best, -1)
        a = z
    return out


def chain_tracks(df: DataFrame, key: str, frame: str, row_id: str, stride: int = 1, least_iou: float = 0.5, least: int = 3) -> DataFrame:
    """key, frame, row_id, track: boxes linked to the most overlapping box of the sample before.

    A box without a link of ``least_iou`` begins a track; several boxes may continue one; an empty sampled frame ends
    all; tracks of fewer than ``least`` boxes are dropped. A null key is a key.

    One pass over batches of sorted rows, whatever keys they hold. From one to the next go the last frame, its tracks'
    numbers and lengths, and the rows of tracks in it that are too short as yet.
    """
    box, name = ["x1", "y1", "x2", "y2"], [key, frame, row_id]

    def changes(b: pd.DataFrame, columns: list[str]) -> np.ndarray:
        new = np.zeros(len(b), bool)
        new[0] = True
        for c in columns:
            x = pd.factorize(b[c], use_na_sentinel=True)[0]
            new[1:] |= x[1:] != x[:-1]
        return new

    def link(b: pd.DataFrame, past: dict | None) -> tuple[pd.DataFrame, dict]:
        """The rows of long tracks and what the next batch must know; ``b`` holds whole frames."""
        m, b = (len(past["rows"]), pd.concat([past["rows"], b], ignore_index=True)) if past else (0, b)
        row, new_key, new = np.arange(len(b)), changes(b, [key]), changes(b, [key, frame])
        start = np.flatnonzero(new)
        at = np.cumsum(new) - 1
        this, that = start[at], start[at - 1]
        f = b[frame].to_numpy()
        linked = (row >= m) & (at > 0) & ~new_key[this] & (f - f[that] == stride)
        root = best_before(b[box].to_numpy(float), that, np.where(linked, this - that, 0), least_iou)
        begins = (root < 0) & (row >= m)
        root = np.where(root < 0, row, root)
        if m:
            known, place, same = np.unique(past["track"], return_index=True, return_inverse=True)
            root[:m] = place[same]
        while (root != (up := root[root])).any():
            root = up
        # Tracks are numbered by key in the order in which they begin.
        count = np.cumsum(begins)
        head = np.flatnonzero(new_key)[np.cumsum(new_key) - 1]
        base = (count - begins)[head] - np.where(head == 0, past["count"] if m else 0, 0)
        number = count - base
        if m:
            number[:m] = past["track"]
        track = number[root]
        length = np.bincount(root[m:], minlength=len(b))
        if m:
            length[place] += past["length"][place]
        on = np.zeros(len(b), bool)
        on[root[start[-1] :]] = True
        rows = b[name].iloc[m:].assign(track=track[m:])
        of = root[m:]
        if m:
            rows = pd.concat([past["short"], rows], ignore_index=True)
            of = np.concatenate([place[np.searchsorted(known, past["short"]["track"].to_numpy())], of])
        long = length[of] >= least
        last = slice(start[-1], None)
        return rows[long], {"rows": b.iloc[last], "track": track[last], "length": length[root[last]], "count": int((count - base)[-1]), "short": rows[~long & on[of]]}

    def run(batches):
        rest, past = None, None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            cut = int(np.flatnonzero(changes(b, [key, frame]))[-1])
            rest = b.iloc[cut:]
            if cut:
                out, past = link(b.iloc[:cut], past)
                yield out
        if rest is not None and len(rest):
            yield link(rest, past)[0]

    rows = df.where(f"{frame} % {stride} = 0").select(*name, *box)
    return rows.repartition(key).sortWithinPartitions(*name).mapInPandas(run, schema_of(rows, name) + ", track long")


def diverse_reservoir(df: DataFrame, key: str, order: str, room: int = 16) -> DataFrame:
    """key, order of the samples that stay if each row in turn is offered to its key's store of ``room`` samples.

    An ordered fold: a key of any size needs a batch and its store. Every change of a store is written as (place, order,
    turn), and the last change of each place is what stays.
    """
    from tessera.operators.identity import Reservoir

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}

    def step(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        took = []
        for at, f in zip(pdf[order], pdf["feat"]):
            place = state["store"].offer(np.asarray(f, float))
            state["turn"] += 1
            if place is not None:
                took.append((at, place, state["turn"]))
        out = pd.DataFrame(took, columns=[order, "place", "turn"])
        out.insert(0, key, pdf[key].iloc[0])
        return out

    changes = ordered_fold(df.select(key, order, "feat"), [key], [order], lambda: {"store": Reservoir(room), "turn": 0}, step, f"{key} {kinds[key]}, {order} {kinds[order]}, place int, turn long")
    return changes.groupBy(key, "place").agg(F.max_by(order, "turn").alias(order)).select(key, order)
