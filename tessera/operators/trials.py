"""Occlusion trials: a person is hidden for some frames, identities are resolved anew, and what it was called is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import IDENTITY, Identity
from tessera.operators.identity import resolve_streams
from tessera.operators.metrics import dominant
from tessera.operators.ordered import longest_run


def occluded(tracks: DataFrame, lengths: list[int], p: Identity = IDENTITY, spare: int = 20, before: int = 15, after: tuple[int, int] = (2, 25)) -> DataFrame:
    """stream_id, track_id, n_frames, identity_before, identity_after, retained, reacquired: a row per trial.

    ``tracks`` as for :func:`tessera.operators.identity.resolve_streams`. Each track of each stream is hidden for each of
    ``lengths`` in the middle of its longest unbroken run, if that is longer by ``spare``: its rows are deleted, and it
    comes back under a new track number, as a short-term tracker would give it. The most frequent identity in the
    ``before`` frames ahead of the gap is compared with that in the frames ``after`` it.

    Trials are streams of their own, so they are resolved in parallel; a stream's rows are repeated once per trial.
    """
    runs = longest_run(tracks, ["stream_id", "track_id"], "frame_id", min(lengths) + spare)
    t = runs.select("stream_id", F.col("track_id").alias("hidden"), "start", "n", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("n_frames")).where(F.col("n") >= F.col("n_frames") + spare)
    t = t.withColumn("a", F.col("start") + F.floor((F.col("n") - F.col("n_frames")) / 2)).withColumn("z", F.col("a") + F.col("n_frames"))
    t = t.withColumn("trial", F.xxhash64("stream_id", "hidden", "n_frames")).select("trial", "stream_id", "hidden", "n_frames", "start", "a", "z")
    same = F.col("track_id") == F.col("hidden")
    rows = tracks.join(t, "stream_id").where(~(same & (F.col("frame_id") >= F.col("a")) & (F.col("frame_id") < F.col("z"))))
    rows = rows.withColumn("track_id", F.col("track_id") * 2 + F.when(same & (F.col("frame_id") >= F.col("z")), 1).otherwise(0))
    ids = resolve_streams(rows.withColumn("stream_id", F.col("trial")).select(*tracks.columns), p)
    mine = ids.withColumnRenamed("stream_id", "trial").join(t, "trial").where(F.floor(F.col("track_id") / 2) == F.col("hidden"))
    frame = F.col("frame_id")
    b = dominant(mine.where((frame >= F.greatest(F.col("start"), F.col("a") - before)) & (frame < F.col("a"))), ["trial"], "canonical_id", ["frame_id"]).withColumnRenamed("canonical_id", "identity_before")
    c = dominant(mine.where((frame >= F.col("z") + after[0]) & (frame < F.col("z") + after[1])), ["trial"], "canonical_id", ["frame_id"]).withColumnRenamed("canonical_id", "identity_after")
    j = t.join(b, "trial", "left").join(c, "trial", "left")
    kept = F.coalesce(F.col("identity_before") == F.col("identity_after"), F.lit(False))
    return j.select("stream_id", F.col("hidden").alias("track_id"), "n_frames", "identity_before", "identity_after", kept.alias("retained"), F.col("identity_after").isNotNull().alias("reacquired"))
