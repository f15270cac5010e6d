"""Identities, levels and log deduplication as Structured Streaming queries.

Each keeps the state of its batch twin per key. Rows are held until the watermark has passed them and then stepped
through in order, so a stream gives what the batch operator gives on the same rows; rows later than the watermark are
dropped by it. Rows are ordered by frame; event time only decides when a frame is complete.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.config import IDENTITY, THREAT, Identity, Threat
from tessera.operators.alerting import Calm, emitted, settle
from tessera.operators.folds import schema_of
from tessera.operators.identity import SCHEMA, Gallery, run_frames
from tessera.sources.tables import EXACT_CSV

STATE = "state binary, held binary"


def frames_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a bounded or growing stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def ordered_state(
    stream: DataFrame, keys: list[str], event_time: str, order: list[str], delay: str, start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str, idle_ms: int = 0,
) -> DataFrame:
    """Steps through each key's rows in order, once the watermark has passed them.

    Rows newer than the watermark wait in the key's state; a timer at their time brings them out. ``idle_ms`` keeps the
    state of a key that long after its last row; with 0 it is kept until the stream ends.
    """
    columns = stream.columns

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inner, held = (pickle.loads(bytes(x)) for x in state.get) if state.exists else (start(), None)
        parts = [held] if held is not None else []
        parts += list(batches) if not state.hasTimedOut else []
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)
        mark = state.getCurrentWatermarkMs()
        if len(rows):
            at = pd.to_datetime(rows[event_time]).astype("int64") // (1_000_000 if str(rows[event_time].dtype).endswith("[ns]") else 1_000)
            ready = (at <= mark).to_numpy()
            due, later = rows[ready].sort_values(order), rows[~ready]
            if len(due):
                yield step(inner, due)
            held = later if len(later) else None
            if held is not None:
                state.setTimeoutTimestamp(max(int(at[~ready].min()) + 1, mark + 1))
        if held is None and state.hasTimedOut and idle_ms:
            state.remove()
            return
        state.update((pickle.dumps(inner), pickle.dumps(held)))
        if held is None and idle_ms:
            state.setTimeoutTimestamp(mark + max(1, idle_ms))

    timed = stream.withWatermark(event_time, delay)
    return timed.groupBy(*keys).applyInPandasWithState(advance, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def identities(stream: DataFrame, event_time: str, delay: str = "1 second", p: Identity = IDENTITY) -> DataFrame:
    """The stream of :func:`tessera.operators.identity.resolve_streams`."""
    return ordered_state(stream, ["stream_id"], event_time, ["frame_id", "track_id"], delay, Gallery, lambda g, pdf: run_frames(g, pdf, p), SCHEMA)


def levels(stream: DataFrame, event_time: str, delay: str = "1 second", p: Threat = THREAT) -> DataFrame:
    """stream_id, person, frame_id, level; a missing frame forgets the person."""
    def step(s: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            if s.get("frame") is None or r.frame_id != s["frame"] + 1:
                s["calm"] = Calm(0, p.calm_frames)
            s["frame"] = r.frame_id
            out.append((r.stream_id, r.person, r.frame_id, settle(s["calm"], None if pd.isna(r.desired) else int(r.desired), p)))
        return pd.DataFrame(out, columns=["stream_id", "person", "frame_id", "level"])

    return ordered_state(stream, ["stream_id", "person"], event_time, ["frame_id"], delay, dict, step, "stream_id long, person long, frame_id long, level int")


def deduplicated(stream: DataFrame, keys: list[str], event_time: str, order: str, tie: str, every: float, delay: str = "1 second") -> DataFrame:
    """Rows that are logged if a key logs at most once per ``every`` units of ``order``."""
    def step(s: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        keep, s["last"] = emitted(pdf[order].to_numpy(float), every, s["last"])
        return pdf[keep]

    return ordered_state(stream, keys, event_time, [order, tie], delay, lambda: {"last": float("-inf")}, step, schema_of(stream))


def visits_per_person(stream: DataFrame, event_time: str, person: str, gap: str, delay: str) -> DataFrame:
    """Sessions of a person: a new one after ``gap`` without a row."""
    s = stream.withWatermark(event_time, delay).groupBy(person, F.session_window(event_time, gap)).agg(F.count("*").alias("n"))
    return s.select(person, F.col("session_window.start").alias("enter"), F.col("session_window.end").alias("leave"), "n")


def append_alerts(stream: DataFrame, path: str, checkpoint: str):
    """The alert log as a CSV sink; each micro-batch replaces its own part, so a repeated one adds nothing."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.csv(f"{path}/batch={number}", mode="overwrite", header=True, **EXACT_CSV)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
