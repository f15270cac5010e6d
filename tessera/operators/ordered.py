"""Ordered analytics: runs, visits, windows that restart on absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str], cell: int) -> DataFrame:
    """``df`` with ``prev_<value>`` of the row before within ``keys`` (null at the start), ordered by ``order``.

    A key is cut into cells of ``cell`` units of the first order column: rows look back within their cell, and the first
    row of a cell takes the last row of the cell before, which windows over cells find. So a key of any size is spread
    over its cells, and only one row per cell of a key comes together. Rows with a null in the first order column are
    one cell, ahead of all others. Equal order values have no certain order.
    """
    w = Window.partitionBy(*keys, "_cell").orderBy(*order)
    rows = df.withColumn("_cell", F.floor(F.col(order[0]) / F.lit(cell)))
    rows = rows.withColumn("_first", F.row_number().over(w) == 1)
    for v in values:
        rows = rows.withColumn(f"prev_{v}", F.lag(v).over(w))
    held = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    last = rows.groupBy(*keys, "_cell").agg(F.max(held).alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_cell"))).where("_before is not null")
    last = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_kc"), "_before")
    same = F.col("_cell").eqNullSafe(F.col("_kc"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.join(last, same, "left")
    for i, v in enumerate(values):
        rows = rows.withColumn(f"prev_{v}", F.when(F.col("_first"), F.col(f"_before.v{i}")).otherwise(F.col(f"prev_{v}")))
    return rows.select(*df.columns, *[f"prev_{v}" for v in values])


#: Cells of a day in microseconds, and of some ten minutes of frames.
DAY_US, FRAMES = 86_400_000_000, 1 << 14


def visits(df: DataFrame, key: str, order: str, gap: int, tie: str | None = None, cell: int = DAY_US) -> DataFrame:
    """``df`` with ``visit``, counted from 1 within a key: a new one begins after more than ``gap`` without a row.

    Visits are numbered within cells of the key and then by the sum of the cells before, see :func:`with_previous`.
    """
    by = [c for c in (order, tie) if c]
    flagged = with_previous(df, [key], by, [order], cell).withColumn("_new", F.coalesce((F.col(order) - F.col(f"prev_{order}") > gap).cast("int"), F.lit(1))).withColumn("_cell", F.floor(F.col(order) / F.lit(cell)))
    per = flagged.groupBy(F.col(key).alias("_k"), F.col("_cell").alias("_c")).agg(F.sum("_new").alias("_n"))
    per = per.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    inner = F.sum("_new").over(Window.partitionBy(key, "_cell").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    j = flagged.withColumn("_in", inner).join(per, F.col(key).eqNullSafe(F.col("_k")) & F.col("_cell").eqNullSafe(F.col("_c")))
    return j.select(*df.columns, (F.col("_in") + F.col("_upto")).alias("visit"))


def islands(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """keys, start, end, n for each unbroken stretch of frames."""
    one = df.select(*keys, frame).distinct()
    w = Window.partitionBy(*keys).orderBy(frame)
    return one.withColumn("_g", F.col(frame) - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("n")).drop("_g")


def longest_run(df: DataFrame, keys: list[str], frame: str, least: int) -> DataFrame:
    """keys, start, n of the longest stretch of at least ``least`` frames, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "start")
    return islands(df, keys, frame).where(F.col("n") >= least).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "start", "n")


def with_island(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """``df`` with ``island``, which changes wherever a frame is missing. One row per key and frame is assumed."""
    w = Window.partitionBy(*keys).orderBy(frame)
    return df.withColumn("island", F.col(frame) - F.row_number().over(w))


def approaching(df: DataFrame, keys: list[str], frame: str, area: str, window: int = 10, ratio: float = 1.5) -> DataFrame:
    """``df`` with ``approaching``: the area grew by ``ratio`` over the last ``window`` frames without a gap."""
    w = Window.partitionBy(*keys, "island").orderBy(frame)
    old = F.lag(area, window - 1).over(w)
    return with_island(df, keys, frame).withColumn("approaching", F.coalesce(F.col(area) >= old * F.lit(ratio), F.lit(False))).drop("island")


def trail(df: DataFrame, keys: list[str], frame: str, point: Column, length: int = 30) -> DataFrame:
    """``df`` with ``trail``: the last points of an unbroken presence, oldest first."""
    w = Window.partitionBy(*keys, "island").orderBy(frame).rowsBetween(-(length - 1), 0)
    return with_island(df, keys, frame).withColumn("trail", F.collect_list(point).over(w)).drop("island")


def held(df: DataFrame, cycle: DataFrame, frame: str, every: int, on: list[str]) -> DataFrame:
    """``df`` joined with what ``cycle`` found in the last frame that is a multiple of ``every``."""
    c = cycle.withColumnRenamed(frame, "_held")
    return df.withColumn("_held", F.col(frame) - F.pmod(F.col(frame), F.lit(every))).join(c, [*on, "_held"], "left").drop("_held")


def one_behind(df: DataFrame, keys: list[str], order: str, value: str, out: str, cell: int = FRAMES) -> DataFrame:
    """``out``: the value of the row before."""
    return with_previous(df, keys, [order], [value], cell).withColumnRenamed(f"prev_{value}", out)


def escalations(df: DataFrame, keys: list[str], order: list[str], level: str, least: int = 2, cell: int = DAY_US) -> DataFrame:
    """Rows whose level is at least ``least`` and above the one before (0 at the start)."""
    before = F.coalesce(F.col(f"prev_{level}"), F.lit(0))
    return with_previous(df, keys, order, [level], cell).where((F.col(level) >= least) & (F.col(level) > before)).drop(f"prev_{level}")


def recordings(df: DataFrame, key: str, order: str, level: str, tail: int, least: int = 2) -> DataFrame:
    """key, start, stop: recordings that begin at a high level and end after ``tail`` of calm.

    The tail's clock begins with the first calm row after a high one; the tail is recorded; a recording that the data
    end before has the last row as stop. All ``level`` values count.
    """
    w = Window.partitionBy(key).orderBy(order)
    hot = F.col(level) >= least
    x = df.select(key, order, hot.alias("hot")).withColumn("was", F.coalesce(F.lag("hot").over(w), F.lit(False)))
    x = x.withColumn("_calm_from", F.when(~F.col("hot") & F.col("was"), F.col(order)))
    # Clock of the running calm, null while hot or before any heat.
    x = x.withColumn("calm", F.when(~F.col("hot"), F.last("_calm_from", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    x = x.withColumn("over", ~F.col("hot") & (F.coalesce(F.col(order) - F.col("calm") >= tail, F.lit(True))))
    on = x.withColumn("_first_over", F.col("over") & ~F.coalesce(F.lag("over").over(w), F.lit(True)))
    keep = on.where(~F.col("over") | F.col("_first_over"))
    begins = F.col("hot") & F.coalesce(F.lag("_first_over").over(w) | F.lag("over").over(w), F.lit(True))
    rec = keep.withColumn("_b", begins.cast("int")).withColumn("rec", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rec.groupBy(key, "rec").agg(F.min(order).alias("start"), F.max(order).alias("stop")).drop("rec")


def ema_per(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, keep: float = 0.9, reach: int = 400) -> DataFrame:
    """keys, ``out``: the last value of the moving average ``keep`` * before + (1 - ``keep``) * value, seeded by the first.

    A value k rows before the end weighs (1 - keep) * keep^k, the first keep^k; weights fall below 1e-18 after ``reach``
    rows, so only that many of each key matter. They are found by a top-k per key, which Spark cuts before the shuffle,
    so a key of any size costs no more than ``reach`` rows a task. Null values are left out.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    rows = df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).alias("_v")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= reach)
    last = F.max("_k").over(Window.partitionBy(*keys))
    weight = F.pow(F.lit(keep), F.col("_k") - 1) * F.when(F.col("_k") == F.col("_n"), 1.0).otherwise(1 - keep)
    return rows.withColumn("_n", last).groupBy(*keys).agg(F.sum(weight * F.col("_v")).alias(out))


def pose_cache(tracks: DataFrame, poses: DataFrame, stream: str, frame: str, track: str, pose: str, every: int = 4) -> DataFrame:
    """stream, frame, track, pose, stale: the pose that each track shows, which may be that of an earlier frame.

    ``tracks``: a row per frame and track; a frame without tracks has one row with a null track. ``poses``: stream,
    frame, track, pose, what would be found for each frame. Poses are looked for in the first of ``every`` frames of a
    stream, and wherever the cache is empty: at the start, after a frame without tracks, or after a search that found
    none; else the last found are shown again and are stale. A track that had none has a null pose.

    Whether the cache is empty is the last certain word before a frame (cleared, filled, or searched in vain in its
    turn), so windows over the frames of a stream decide, without a fold.
    """
    found = poses.groupBy(stream, frame).agg(F.count("*").alias("_p"))
    w = Window.partitionBy(stream).orderBy(frame)
    fr = tracks.groupBy(stream, frame).agg((F.count(track) > 0).alias("_t")).withColumn("_n", F.row_number().over(w)).join(found, [stream, frame], "left")
    word = F.when(~F.col("_t"), True).when(F.col("_p") > 0, False).when(F.col("_n") % every == 1, True)
    bare = F.coalesce(F.last(word, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    fr = fr.withColumn("_bare", bare).withColumn("_src", F.when(F.col("_t") & ((F.col("_n") % every == 1) | F.col("_bare")), F.col(frame)))
    fr = fr.withColumn("_src", F.max("_src").over(w)).where("_t").select(stream, frame, "_src")
    shown = tracks.where(F.col(track).isNotNull()).join(fr, [stream, frame])
    src = poses.select(F.col(stream), F.col(frame).alias("_src"), F.col(track), F.col(pose))
    return shown.join(src, [stream, "_src", track], "left").select(stream, frame, track, pose, (F.col(pose).isNotNull() & (F.col("_src") < F.col(frame))).alias("stale"))
