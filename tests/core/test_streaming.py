import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import alerting, identity
from tessera.plans.frames import _tracks
from tessera.plans.views import presence, walk
from tessera.streaming import stateful


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.table(name)


def as_stream(spark, df, path, order, parts=3):
    """The rows as files of rising event time, and a last row far ahead that moves the watermark past all others."""
    split = df.withColumn("_part", F.ntile(parts).over(Window.orderBy(*order)))
    for i in range(parts):
        split.where(F.col("_part") == i + 1).drop("_part").coalesce(1).write.mode("append").parquet(str(path))
    return stateful.frames_stream(spark, str(path), df.schema)


def beyond(df, **values):
    """One more row a day later under a key of its own."""
    last = df.orderBy(F.col("at").desc()).limit(1)
    for c, v in values.items():
        last = last.withColumn(c, F.lit(v).cast(df.schema[c].dataType))
    return df.unionByName(last.withColumn("at", F.col("at") + F.expr("interval 1 day")))


def same(a, b, keys):
    a, b = (x.sort_values(keys).reset_index(drop=True)[sorted(x.columns)] for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_identities_of_a_stream_are_those_of_the_batch(spark, data, tmp_path):
    t = _tracks(spark, data).where("frame_id < 60").withColumn("at", F.timestamp_seconds(F.col("ts") + 1_000_000))
    whole = identity.resolve_streams(t).toPandas()
    s = as_stream(spark, beyond(t, stream_id=99), tmp_path / "in", ["frame_id", "track_id"])
    got = run(stateful.identities(s, "at"), "identities").where("stream_id <> 99").toPandas()
    same(got, whole, ["stream_id", "frame_id", "track_id"])


def test_levels_of_a_stream_are_those_of_the_batch(spark, data, tmp_path):
    w = walk(spark, data).where("frame_id < 150").select(F.lit(0).cast("long").alias("stream_id"), "person", "frame_id", F.when(F.col("value") > 60, F.col("value") % 4).cast("int").alias("desired"))
    w = w.withColumn("at", F.timestamp_seconds(F.col("frame_id") / 10 + 1_000_000))
    whole = alerting.levels(w).toPandas()
    s = as_stream(spark, beyond(w, stream_id=99), tmp_path / "in", ["frame_id", "person"])
    got = run(stateful.levels(s, "at"), "levels").where("stream_id <> 99").toPandas()
    same(got, whole, ["stream_id", "person", "frame_id"])


def test_log_dedup_of_a_stream_is_that_of_the_batch(spark, data, tmp_path):
    p = presence(spark, data).select("person", "level", "event_id", "t_us", F.timestamp_micros("t_us").alias("at"))
    every = 24 * 3_600_000_000
    whole = alerting.deduplicated(p, ["person", "level"], "t_us", every, "event_id").toPandas()
    s = as_stream(spark, beyond(p, person=-1), tmp_path / "in", ["t_us"])
    got = run(stateful.deduplicated(s, ["person", "level"], "at", "t_us", "event_id", every), "dedup").where("person <> -1").toPandas()
    same(got, whole, ["event_id"])


def test_sessions_of_a_stream(spark, data, tmp_path):
    p = presence(spark, data).select("person", "event_id", F.timestamp_micros("t_us").alias("at"))
    s = as_stream(spark, beyond(p, person=-1), tmp_path / "in", ["at"])
    got = run(stateful.visits_per_person(s, "at", "person", "6 hours", "1 second"), "visits").where("person <> -1")
    assert got.agg(F.sum("n")).first()[0] == p.count()


def test_the_alert_sink_repeats_nothing(spark, data, tmp_path):
    p = presence(spark, data).select("person", "event_id", F.timestamp_micros("t_us").alias("at"))
    s = as_stream(spark, p, tmp_path / "in", ["at"])
    q = stateful.append_alerts(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == p.count()


@pytest.mark.parametrize("seconds", [0])
def test_an_empty_key_range_gives_nothing(spark, data, seconds):
    assert identity.resolve_streams(_tracks(spark, data).where("false").withColumn("at", F.timestamp_seconds(F.col("ts") + 1_000_000))).count() == 0
