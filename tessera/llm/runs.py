"""Problem 3: repeated consecutive events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_runs(
    df: DataFrame, keys: list[str], at: str, event_id: str, same: dict[str, Column], resent: str | None = None,
    max_gap_s: float = 5.0, cell_s: int = 600,
) -> DataFrame:
    """One row per run of consecutive equal events.

    Rows are ordered by ``at``, then ``event_id`` within ``keys`` (null keys form a key of their own). A run goes on
    while every expression of ``same`` is null-safe equal and the step from the row before is at most ``max_gap_s``.
    Rows without ``at`` or ``event_id`` can't be ordered and are left out; of rows with equal keys, ``at`` and
    ``event_id`` the one with the smallest ``resent`` counts. An empty table gives no row. Other columns of ``df``
    are not read, so clashing names do no harm.

    Method: each row is compared with its predecessor by a lag window, changes are flagged, and the running sum of the
    flags numbers the runs. A key is cut into cells of ``cell_s`` seconds, so that a key with a third of all rows is
    spread over its cells: the windows run within a cell, and a second pass over only the first and last run of each
    cell joins those that touch. What that pass sees of a key grows with the time covered, not with the rows.

    Columns: the keys, those of ``same``, first_id, last_id, first_us, last_us, n_events, duration_s.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    rows = df.where(F.col(at).isNotNull() & F.col(event_id).isNotNull()).select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        *[c.alias(f"s{i}") for i, c in enumerate(same.values())],
        us.alias("us"), F.col(event_id).alias("id"), *([F.col(resent).alias("re")] if resent else []),
    ).withColumn("cell", F.floor(F.col("us") / F.lit(cell_s * 1_000_000)))
    ks, sig = [f"k{i}" for i in range(len(keys))], F.struct(*[f"s{i}" for i in range(len(same))])
    cell = Window.partitionBy(*ks, "cell")
    rows = rows.repartition(*ks, "cell")
    if resent:
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*ks, "cell", "us", "id").orderBy("re"))).where("copy = 1").drop("copy", "re")
    else:
        rows = rows.dropDuplicates([*ks, "cell", "us", "id"])
    order = cell.orderBy("us", "id")
    limit = int(max_gap_s * 1_000_000)

    def starts(w: Window, last: str) -> Column:
        before = F.lag(last).over(w)
        return (before.isNull() | (F.col("us") - before > limit) | ~F.lag(sig).over(w).eqNullSafe(sig)).cast("int")

    rows = rows.withColumn("new", starts(order, "us")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = rows.groupBy(*ks, "cell", "run").agg(
        *[F.first(f"s{i}").alias(f"s{i}") for i in range(len(same))],
        F.min(F.struct("us", "id")).alias("a"), F.max(F.struct("us", "id")).alias("z"), F.count("*").alias("n"),
    ).withColumn("most", F.max("run").over(cell))
    inner = part.where("run > 1 and run < most").select(*ks, *[f"s{i}" for i in range(len(same))], "a", "z", "n")
    edge = part.where("run = 1 or run = most").select("*", F.col("a.us").alias("us"), F.col("z.us").alias("z_us"))
    along = Window.partitionBy(*ks).orderBy("cell", "run")
    edge = edge.withColumn("new", F.when(F.col("run") > 1, 1).otherwise(starts(along, "z_us")))
    edge = edge.withColumn("whole", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(*ks, "whole").agg(
        *[F.first(f"s{i}").alias(f"s{i}") for i in range(len(same))], F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("n"),
    ).drop("whole")
    return inner.unionByName(joined).select(
        *[F.col(k).alias(n) for k, n in zip(ks, keys)], *[F.col(f"s{i}").alias(n) for i, n in enumerate(same)],
        F.col("a.id").alias("first_id"), F.col("z.id").alias("last_id"), F.col("a.us").alias("first_us"), F.col("z.us").alias("last_us"),
        F.col("n").alias("n_events"), ((F.col("z.us") - F.col("a.us")) / F.lit(1e6)).alias("duration_s"),
    )
