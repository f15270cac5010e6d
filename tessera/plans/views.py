"""The driver's tables in the roles that the operators need, for Spark and, as text, for SQL.

Whole-number arithmetic only, so that both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def people(spark: SparkSession, d: str) -> DataFrame:
    """Person detections: eight boxes a frame from orders; boxes 5, 6, 7 are shifted copies that overlap in a chain."""
    k = F.col("o_orderkey")
    df = table(spark, d, "orders").select(k.alias("k"), F.col("o_custkey").alias("track_id"), F.greatest(k % 8 - 5, F.lit(0)).alias("e"))
    df = df.withColumn("b", F.col("k") - F.col("e")).withColumn("w", 24 + F.expr("(b * 7) % 140")).withColumn("h", 48 + F.expr("(b * 29) % 180"))
    df = df.withColumn("ix", F.expr("(b * 37 + (b div 8) * 11) % 560 + e * (w div 12)")).withColumn("iy", F.expr("(b * 53) % 300"))
    return df.select(
        F.expr("(k div 8) % 4").alias("stream_id"), F.expr("k div 8").alias("frame_id"), (F.col("k") % 8).alias("det_id"), "track_id", "k",
        F.col("ix").cast("double").alias("x1"), F.col("iy").cast("double").alias("y1"), (F.col("ix") + F.col("w")).cast("double").alias("x2"), (F.col("iy") + F.col("h")).cast("double").alias("y2"),
        ((20 + F.expr("(k * 13) % 80")) / F.lit(100)).alias("conf"), (F.col("k") % 7 != 0).alias("matched"),
    )


PEOPLE = """people AS (SELECT (k // 8) % 4 AS stream_id, k // 8 AS frame_id, k % 8 AS det_id, track_id, k, CAST(ix AS DOUBLE) AS x1, CAST(iy AS DOUBLE) AS y1,
 CAST(ix + w AS DOUBLE) AS x2, CAST(iy + h AS DOUBLE) AS y2, (20 + (k * 13) % 80) / 100 AS conf, k % 7 <> 0 AS matched FROM (
 SELECT *, (b * 37 + (b // 8) * 11) % 560 + e * (w // 12) AS ix, (b * 53) % 300 AS iy FROM (SELECT *, 24 + (b * 7) % 140 AS w, 48 + (b * 29) % 180 AS h FROM (
 SELECT o_orderkey AS k, o_custkey AS track_id, greatest(o_orderkey % 8 - 5, 0) AS e, o_orderkey - greatest(o_orderkey % 8 - 5, 0) AS b FROM orders))))"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Object candidates from lineitem, one per order and line."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_returnflag").alias("f"))
    li = li.withColumn("x", F.expr("(pk * 31) % 600")).withColumn("y", F.expr("(sk * 47) % 440")).withColumn("w", F.expr("8 + (pk * 5) % 70")).withColumn("h", F.expr("8 + (sk * 3 + l_orderkey) % 70"))
    label = F.when(F.col("f") == "A", "guns").when(F.col("f") == "N", "knife").otherwise("long_gun")
    return li.select(
        F.expr("l_orderkey div 8").alias("frame_id"), ((F.col("l_orderkey") % 8) * 8 + F.col("l_linenumber")).cast("long").alias("cand_id"), label.alias("label"),
        F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), (F.col("x") + F.col("w")).cast("double").alias("x2"), (F.col("y") + F.col("h")).cast("double").alias("y2"),
        (F.expr("15 + (pk * 17 + sk) % 85") / F.lit(100)).alias("conf"),
    )


CANDIDATES = """cand AS (SELECT l_orderkey // 8 AS frame_id, CAST((l_orderkey % 8) * 8 + l_linenumber AS BIGINT) AS cand_id, CASE f WHEN 'A' THEN 'guns' WHEN 'N' THEN 'knife' ELSE 'long_gun' END AS label,
 CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, CAST(x + w AS DOUBLE) AS x2, CAST(y + h AS DOUBLE) AS y2, (15 + (pk * 17 + sk) % 85) / 100 AS conf FROM (
 SELECT *, (pk * 31) % 600 AS x, (sk * 47) % 440 AS y, 8 + (pk * 5) % 70 AS w, 8 + (sk * 3 + l_orderkey) % 70 AS h FROM (
 SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber)))"""

#: Landmark, x and y in a box, and the factor of its visibility.
LANDMARKS = {
    11: ("x1 + (x2 - x1) / 4", "y1 + (y2 - y1) * 2 / 5"), 12: ("x2 - (x2 - x1) / 4", "y1 + (y2 - y1) * 2 / 5"),
    15: ("x1 + (x2 - x1) / 4", "y1 + (y2 - y1) / 2"), 16: ("x2 - (x2 - x1) / 4", "y1 + (y2 - y1) / 3"),
    23: ("x1 + (x2 - x1) / 4", "y1 + (y2 - y1) * 3 / 5"), 24: ("x2 - (x2 - x1) / 4", "y1 + (y2 - y1) * 3 / 5"),
    27: ("x1 + (x2 - x1) / 4", "y2"), 28: ("x2 - (x2 - x1) / 4", "y2"),
}


def posed(spark: SparkSession, d: str) -> DataFrame:
    """People with landmarks; every fifth has none."""
    pts = ", ".join(f"{i}, struct(cast({x} as double) as x, cast({y} as double) as y, (k * {i}) % 101 / 100 as v)" for i, (x, y) in LANDMARKS.items())
    empty = "cast(map() as map<int, struct<x: double, y: double, v: double>>)"
    return people(spark, d).withColumn("kp", F.expr(f"CASE WHEN k % 5 = 0 THEN {empty} ELSE map({pts}) END"))


#: The same as columns px<i>, py<i>, null where the landmark is not visible, and kp_count.
POSED = PEOPLE + ", posed AS (SELECT *, " + ", ".join(
    f"CASE WHEN k % 5 <> 0 AND (k * {i}) % 101 >= 50 THEN {x} END AS px{i}, CASE WHEN k % 5 <> 0 AND (k * {i}) % 101 >= 50 THEN {y} END AS py{i}" for i, (x, y) in LANDMARKS.items()
) + ", CASE WHEN k % 5 <> 0 THEN " + " + ".join(f"CAST((k * {i}) % 101 >= 50 AS INT)" for i in LANDMARKS) + " END AS kp_count FROM people)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Appearance samples from embeddings; the queries are the ids divisible by 100."""
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        v.alias("vec_id"), F.col("label").cast("long").alias("person"), F.when(v % 41 == 0, F.lit(-1)).otherwise(F.col("label")).cast("long").alias("pid"),
        (v % 3).alias("cam"), F.expr("vec_id div 10").alias("frame_id"), (v % 100 == 0).alias("is_query"), F.col("embedding").cast("array<double>").alias("feat"))


SAMPLES = """samples AS (SELECT vec_id, CAST(label AS BIGINT) AS person, CAST(CASE WHEN vec_id % 41 = 0 THEN -1 ELSE label END AS BIGINT) AS pid, vec_id % 3 AS cam, vec_id // 10 AS frame_id,
 vec_id % 100 = 0 AS is_query, CAST(embedding AS DOUBLE[]) AS feat FROM embeddings)"""


def presence(spark: SparkSession, d: str) -> DataFrame:
    """Presence log from events, with marks and levels."""
    e = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").alias("person"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), e.alias("event_type"), F.col("value").alias("value"),
        F.when(e == "signup", "exit").when(e == "click", "return").alias("mark"),
        F.when(e == "view", 0).when(e == "click", 1).when(e.isin("purchase", "signup"), 2).otherwise(3).alias("level"))


PRESENCE = """presence AS (SELECT user_id AS person, event_id, epoch_us(ts) AS t_us, event_type, value, CASE event_type WHEN 'signup' THEN 'exit' WHEN 'click' THEN 'return' END AS mark,
 CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 2 ELSE 3 END AS level FROM events)"""


def pool(spark: SparkSession, d: str) -> DataFrame:
    """The curation pool, each picture once."""
    return table(spark, d, "build_dataset").dropDuplicates(["image_id"])


POOL = "pool AS (SELECT * FROM build_dataset QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY ingested_at) = 1)"


def walk(spark: SparkSession, d: str) -> DataFrame:
    """Long presences with a few missing frames: one person per 400 orders."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").where(k % 37 != 0).select(
        F.expr("o_orderkey div 400").alias("person"), (k % 400).alias("frame_id"), (100 + F.expr("(o_orderkey * 31) % 300") + (k % 400)).cast("double").alias("area"),
        F.expr("(o_orderkey * 13) % 600").cast("double").alias("x"), F.expr("(o_orderkey * 7) % 400").cast("double").alias("y"), F.when(k % 3 != 0, F.expr("(o_orderkey * 5) % 90")).alias("value"))


WALK = """walk AS (SELECT o_orderkey // 400 AS person, o_orderkey % 400 AS frame_id, CAST(100 + (o_orderkey * 31) % 300 + o_orderkey % 400 AS DOUBLE) AS area, CAST((o_orderkey * 13) % 600 AS DOUBLE) AS x,
 CAST((o_orderkey * 7) % 400 AS DOUBLE) AS y, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey * 5) % 90 END AS value FROM orders WHERE o_orderkey % 37 <> 0)"""


_STEP = """s{0} AS (SELECT s.frame_id, s.mask | (1 << mc.j) AS mask, min(s.cost + mc.cost) AS cost, min_by(list_append(s.path, mc.j), s.cost + mc.cost) AS path FROM s{1} s JOIN mc ON mc.frame_id = s.frame_id AND mc.i = {0} AND (s.mask >> mc.j) & 1 = 0 GROUP BY ALL
 UNION ALL SELECT s.* FROM s{1} s WHERE s.frame_id NOT IN (SELECT frame_id FROM mc WHERE i = {0}))"""
#: The assignment of least cost without its algorithm: for each set of columns the least cost of the rows so far, row by
#: row. From mc (frame_id, i from 1 to 8, j from 0 to 7, cost) to solved (frame_id, i, j).
LEAST_COST = f"""s0 AS (SELECT DISTINCT frame_id, 0 AS mask, CAST(0 AS DOUBLE) AS cost, CAST([] AS INT[]) AS path FROM mc), {', '.join(_STEP.format(n, n - 1) for n in range(1, 9))},
 solved AS (SELECT frame_id, generate_subscripts(path, 1) AS i, unnest(path) AS j FROM (SELECT frame_id, min_by(path, cost) AS path FROM s8 GROUP BY frame_id))"""
