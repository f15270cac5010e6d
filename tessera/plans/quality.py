"""Queries of metrics, curation, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.functions.geometry import Box
from tessera.operators import assignment, curation, metrics, ordered
from tessera.plans.frames import _ASOF, _CLEAN, _HOUR, _NEAR, _PAIRS, _PERSON, _SCORED, _SPLIT, _VISITS, _asof_events, _person_scores, _reentries, _scored, _split_pool, _timeline
from tessera.plans.registry import query
from tessera.plans.scalar import _IOU
from tessera.plans.views import CANDIDATES, LEAST_COST, PEOPLE, POOL, PRESENCE, SAMPLES, WALK, candidates, people, pool, presence, samples, table, walk
from tessera.sources import tables
from tessera.sources.workspace import Workspace
from tessera.streaming import stateful


@query("a1_dominant_identity", f"""WITH {_ASOF}, w AS (SELECT event_id, ident, frame_id, det_id FROM ev JOIN tl USING (clip) WHERE frame_id >= t0 AND frame_id < t0 + 20)
 SELECT event_id, ident FROM (SELECT event_id, ident, count(*) AS n, min((frame_id, det_id)) AS f FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, f) = 1""")
def a1(spark, d):
    t = _timeline(spark, d).withColumn("cell", F.floor(F.col("frame_id") / 20))
    e = _asof_events(spark, d).withColumn("cell", F.explode(F.array(F.floor(F.col("at") / 20), F.floor(F.col("at") / 20) + 1)))
    j = e.join(t, ["clip", "cell"]).where("frame_id >= at AND frame_id < at + 20")
    return metrics.dominant(j, ["event_id"], "ident", ["frame_id", "det_id"])


def _events(spark, d):
    """Exit and return with what was seen on either side: the event's amount in whole tens stands for an identity."""
    e = _reentries(spark, d)
    ident = F.when(F.col("return_at") % 7 != 0, F.col("return_at") % 3)
    return e.select("person", "exit_at", "return_at", (F.col("exit_at") % 3).alias("before"), ident.alias("after"), F.floor((F.col("return_at") - F.col("exit_at")) / F.lit(60_000_000)).alias("gap"))


_EV = f"{_PAIRS}, e AS (SELECT *, exit_at % 3 AS before, CASE WHEN return_at % 7 <> 0 THEN return_at % 3 END AS after, (return_at - exit_at) // 60000000 AS gap FROM pairs)"
_BUCKET = "CASE WHEN gap < 30 THEN '[0,30)' WHEN gap < 90 THEN '[30,90)' WHEN gap < 300 THEN '[90,300)' WHEN gap < 900 THEN '[300,900)' ELSE '[900,inf)' END"


@query("a2_reentry_score", f"WITH {_EV} SELECT count(*) AS n, count(*) FILTER (before = after) AS correct, count(*) FILTER (after IS NULL) AS undecided, count(*) FILTER (before <> after) AS split, round(avg(CAST(coalesce(before = after, false) AS INT)), 4) AS accuracy FROM e")
def a2(spark, d):
    return metrics.reentry_scores(_events(spark, d))


@query("a3_shared_identities", f"WITH {PRESENCE} SELECT ident, count(DISTINCT person) AS persons FROM (SELECT t_us % 97 AS ident, person FROM presence) GROUP BY ident HAVING count(DISTINCT person) > 1")
def a3(spark, d):
    return metrics.shared_identities(presence(spark, d).withColumn("ident", F.col("t_us") % 97), "ident", "person")


@query("a4_duplicate_id_frames", f"WITH {PEOPLE} SELECT frame_id FROM people GROUP BY frame_id HAVING count(track_id) <> count(DISTINCT track_id)")
def a4(spark, d):
    return metrics.duplicate_id_frames(people(spark, d), ["frame_id"], "track_id")


@query("a5_retention_by_gap", f"WITH {_EV} SELECT {_BUCKET} AS bucket, count(*) AS n, round(avg(CAST(coalesce(before = after, false) AS INT)), 4) AS kept FROM e GROUP BY bucket")
def a5(spark, d):
    return metrics.retention(_events(spark, d).withColumn("correct", F.coalesce(F.col("before") == F.col("after"), F.lit(False))))


@query("a28_annotated_accuracy", f"WITH {_EV} SELECT count(*) AS n, count(*) FILTER (before = after) AS correct, count(*) FILTER (after IS NULL) AS undecided, count(*) FILTER (before <> after) AS split, round(avg(CAST(coalesce(before = after, false) AS INT)), 4) AS accuracy FROM e WHERE person % 3 = 0")
def a28(spark, d):
    e = _events(spark, d).withColumn("note", F.when(F.col("person") % 3 == 0, F.lit("other coat")).otherwise(F.lit("")))
    return metrics.reentry_scores(e.where("note <> ''"))


@query("a30_identities_per_person", f"WITH {PRESENCE} SELECT person, count(DISTINCT t_us % 97) AS identities FROM presence GROUP BY person")
def a30(spark, d):
    return metrics.identities_per_person(presence(spark, d).withColumn("ident", F.col("t_us") % 97), "person", "ident")


def _mot(spark, d):
    """Truth, predictions and matches of a sequence. Predictions are the boxes a few pixels off, every ninth missing and
    every eleventh elsewhere, and change their number in the last three of ten frames; J-6 matches them."""
    k = F.col("k")
    one = people(spark, d).groupBy("frame_id", F.col("track_id").alias("id")).agg(F.min(F.struct("k", "x1", "y1", "x2", "y2")).alias("b")).select("frame_id", "id", "b.*")
    dx, dy = F.when(k % 11 == 0, 200.3).otherwise(3.3), F.when(k % 11 == 0, 150).otherwise(2)
    cid = F.col("id") + F.when(F.col("frame_id") % 10 < 7, 0).otherwise(1_000_000)
    pred = one.where(k % 9 != 0).select("frame_id", cid.alias("cid"), (k % 8).alias("pk"), *[(F.col(c) + (dx if c[0] == "x" else dy)).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    gt = one.select("frame_id", F.col("id").alias("gid"), (k % 8).alias("gk"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = gt.join(pred, "frame_id").select("frame_id", "gk", "pk", geometry.iou(Box.of("a_"), Box.of("b_")).alias("iou"))
    got = assignment.assign_overlaps(pairs, ["frame_id"], "gk", "pk")
    m = got.join(gt.select("frame_id", "gk", "gid"), ["frame_id", "gk"]).join(pred.select("frame_id", "pk", "cid"), ["frame_id", "pk"]).select("frame_id", "gid", "cid")
    return one.select("frame_id", "id"), pred.select("frame_id", F.col("cid").alias("id")), m


_MIOU = _IOU.replace("a.", "g.").replace("b.", "p.")
_MOT = f"""{PEOPLE}, one AS (SELECT frame_id, track_id AS id, min(k) AS k FROM people GROUP BY ALL), gtb AS (SELECT one.*, x1, y1, x2, y2 FROM one JOIN people USING (k)),
 prb AS (SELECT frame_id, id + CASE WHEN frame_id % 10 < 7 THEN 0 ELSE 1000000 END AS cid, row_number() OVER (PARTITION BY frame_id ORDER BY k) AS i, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2
  FROM (SELECT *, CAST(CASE WHEN k % 11 = 0 THEN 200.3 ELSE 3.3 END AS DOUBLE) AS dx, CASE WHEN k % 11 = 0 THEN 150 ELSE 2 END AS dy FROM gtb WHERE k % 9 <> 0)),
 mc AS (SELECT frame_id, p.i, CAST(g.k % 8 AS INT) AS j, 1 - {_MIOU} AS cost FROM gtb g JOIN prb p USING (frame_id)),
 {LEAST_COST}, m AS (SELECT g.frame_id, g.id AS gid, p.cid FROM solved x
  JOIN prb p ON p.frame_id = x.frame_id AND p.i = x.i JOIN gtb g ON g.frame_id = x.frame_id AND g.k % 8 = x.j WHERE {_MIOU} >= 0.5),
 pred AS (SELECT count(*) AS n FROM prb)"""


@query("a6_mota", f"""WITH {_MOT}, s AS (SELECT count(*) AS matched, count(*) FILTER (b <> cid) AS switches FROM (SELECT *, lag(cid) OVER (PARTITION BY gid ORDER BY frame_id) AS b FROM m)), g AS (SELECT count(*) AS gt FROM one)
 SELECT gt, n AS pred, matched, switches, gt - matched AS misses, n - matched AS false_positives, round(1 - (gt - matched + n - matched + switches) / gt, 4) AS mota FROM g, s, pred""")
def a6(spark, d):
    return metrics.mot_counts(*_mot(spark, d))


@query("a7_idf1_dominant", f"""WITH {_MOT}, t AS (SELECT CAST(sum(n) AS BIGINT) AS idtp FROM (SELECT gid, max(n) AS n FROM (SELECT gid, cid, count(*) AS n FROM m GROUP BY ALL) GROUP BY gid)), c AS (SELECT idtp, idtp / (SELECT n FROM pred) AS p, idtp / (SELECT count(*) FROM one) AS r FROM t)
 SELECT idtp, round(p, 4) AS idp, round(r, 4) AS idr, round(2 * p * r / (p + r), 4) AS idf1 FROM c""")
def a7(spark, d):
    return metrics.idf1_dominant(*_mot(spark, d))


@query("a8_id_switches", f"WITH {_MOT} SELECT gid, frame_id, b AS before, cid AS after FROM (SELECT *, lag(cid) OVER (PARTITION BY gid ORDER BY frame_id) AS b FROM m) WHERE b <> cid")
def a8(spark, d):
    m = ordered.one_behind(_mot(spark, d)[2], ["gid"], "frame_id", "cid", "before")
    return m.where("before <> cid").select("gid", "frame_id", "before", F.col("cid").alias("after"))


@query("a9_coverage", f"WITH {_MOT}, h AS (SELECT gid, count(*) AS hits FROM m GROUP BY gid), c AS (SELECT id, count(*) AS frames, any_value(coalesce(hits, 0)) AS hits FROM one LEFT JOIN h ON gid = id GROUP BY id) SELECT *, CASE WHEN hits / frames >= 0.8 THEN 'mostly_tracked' WHEN hits / frames < 0.2 THEN 'mostly_lost' ELSE 'partly' END AS grade FROM c")
def a9(spark, d):
    gt, _, m = _mot(spark, d)
    return metrics.coverage(gt, m)


@query("a10_merges_and_splits", f"WITH {_MOT} SELECT (SELECT count(*) FROM (SELECT cid FROM m GROUP BY cid HAVING count(DISTINCT gid) > 1)) AS false_merges, (SELECT count(*) FROM (SELECT gid FROM m GROUP BY gid HAVING count(DISTINCT cid) > 1)) AS false_splits")
def a10(spark, d):
    return metrics.merges_and_splits(_mot(spark, d)[2])


@query("a11_mot_reentries", f"""WITH {_MOT}, g AS (SELECT id, frame_id AS gone, lead(frame_id) OVER (PARTITION BY id ORDER BY frame_id) AS back FROM one)
 SELECT id, gone, back, a.cid AS before, b.cid AS after FROM g JOIN m a ON a.gid = id AND a.frame_id = gone JOIN m b ON b.gid = id AND b.frame_id = back WHERE back - gone >= 30""")
def a11(spark, d):
    gt, _, m = _mot(spark, d)
    return metrics.mot_reentries(gt, m)


@query("a12_cmc_map", f"""WITH {_SCORED}, {_CLEAN}, r AS (SELECT *, q_pid = g_pid AS hit, row_number() OVER w AS k, sum(CAST(q_pid = g_pid AS INT)) OVER (PARTITION BY q_id ORDER BY sim DESC, g_id ROWS UNBOUNDED PRECEDING) AS h FROM clean WINDOW w AS (PARTITION BY q_id ORDER BY sim DESC, g_id)),
 p AS (SELECT q_id, avg(h / k) AS ap, min(k) AS f FROM r WHERE hit GROUP BY q_id) SELECT count(*) AS queries, round(avg(ap), 4) AS map, round(avg(CAST(f <= 1 AS INT)), 4) AS rank1, round(avg(CAST(f <= 5 AS INT)), 4) AS rank5, round(avg(CAST(f <= 10 AS INT)), 4) AS rank10 FROM p""")
def a12(spark, d):
    from tessera.operators.matching import without_junk

    return metrics.retrieval(without_junk(_scored(spark, d)).withColumn("hit", F.col("q_pid") == F.col("g_pid")))


def _same_other(spark, d):
    return _scored(spark, d).where("q_pid >= 0 AND g_pid >= 0").select("q_id", "g_pid", (F.col("q_pid") == F.col("g_pid")).alias("same"), "sim", (F.abs(F.col("q_id") - F.col("g_id")) >= 300).alias("hard"))


_SO = f"{_SCORED}, so AS (SELECT q_id, g_pid, q_pid = g_pid AS same, sim, abs(q_id - g_id) >= 300 AS hard FROM scored WHERE q_pid >= 0 AND g_pid >= 0)"


def _gaps(spark, d):
    s = _same_other(spark, d).where("not same").select(F.col("q_id").alias("query_id"), F.col("g_pid").alias("track"), "sim")
    return metrics.runner_up_gap(s)


_GAPS = "tg AS (SELECT q_id, g_pid, max(sim) AS s FROM so WHERE NOT same GROUP BY ALL), gp AS (SELECT q_id AS query_id, round(s - lead(s) OVER w, 6) AS gap FROM tg WINDOW w AS (PARTITION BY q_id ORDER BY s DESC, g_pid) QUALIFY row_number() OVER w = 1)"


@query("a13_calibration", f"""WITH {_SO}, {_GAPS}, q AS (SELECT quantile_cont(sim, 0.99) FILTER (NOT same) AS i99, quantile_cont(sim, 0.25) FILTER (same AND hard) AS h25, quantile_cont(sim, 0.02) FILTER (same AND hard) AS h02, quantile_cont(sim, 0.1) FILTER (same AND hard) AS h10, quantile_cont(sim, 0.05) FILTER (same) AS a05 FROM so)
 SELECT round(least(i99, h25), 4) AS t_match, round(least(h02, least(i99, h25) - 0.05), 4) AS t_new, round((SELECT quantile_cont(gap, 0.75) FROM gp WHERE gap IS NOT NULL), 4) AS margin, round(h10, 4) AS veto, round(1 - a05, 4) AS max_distance FROM q""")
def a13(spark, d):
    s = _same_other(spark, d)
    return metrics.calibrated(s.where("same"), s.where("same and hard"), s.where("not same"), _gaps(spark, d))


_RATES = "th AS (SELECT i, round(-0.5 + i * 0.0025, 6) AS t FROM range(0, 401) r(i)), n AS (SELECT count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS q FROM so), rt AS (SELECT t, (count(*) FILTER (same AND sim >= t - 1e-9) / any_value(p)) AS tpr, 1 - (count(*) FILTER (NOT same AND sim >= t - 1e-9) / any_value(q)) AS tnr FROM so, th, n GROUP BY t)"


@query("a14_best_balanced_accuracy", f"WITH {_SO}, {_RATES} SELECT t AS threshold, round((tpr + tnr) / 2, 6) AS accuracy FROM rt ORDER BY accuracy DESC, t LIMIT 1")
def a14(spark, d):
    return metrics.best_balanced(metrics.rates_by_threshold(_same_other(spark, d), 401, -0.5, 0.5))


@query("a15_operating_points", f"""WITH {_SO}, b AS (SELECT * FROM (VALUES (0.001), (0.01), (0.05)) v(budget)), t AS (SELECT budget::DOUBLE AS budget, CASE budget WHEN 0.001 THEN quantile_cont(sim, 0.999) WHEN 0.01 THEN quantile_cont(sim, 0.99) ELSE quantile_cont(sim, 0.95) END AS th FROM so, b WHERE NOT same GROUP BY budget)
 SELECT budget, round(th, 4) AS threshold, round(avg(CAST(sim >= th AS INT)), 4) AS easy_recall, round(avg(CAST(sim >= th AS INT)) FILTER (hard), 4) AS hard_recall FROM so, t WHERE same GROUP BY budget, th""")
def a15(spark, d):
    s = _same_other(spark, d)
    return metrics.operating_points(s.where("same"), s.where("same and hard"), s.where("not same"), [0.001, 0.01, 0.05])


@query("a16_separability", f"WITH {_SO}, p AS (SELECT quantile_cont(sim, 0.05) AS p5, avg(sim) AS ms FROM so WHERE same) SELECT round(any_value(ms) - avg(sim), 6) AS separation, round(avg(CAST(sim >= p5 AS INT)), 6) AS overlap FROM so, p WHERE NOT same")
def a16(spark, d):
    return metrics.separability(_same_other(spark, d))


@query("a17_runner_up_gap", f"WITH {_SO}, {_GAPS} SELECT query_id, gap FROM gp WHERE gap IS NOT NULL")
def a17(spark, d):
    return _gaps(spark, d).withColumn("gap", F.round("gap", 6))


@query("a18_threshold_sweep", f"""WITH {PEOPLE}, f AS (SELECT frame_id, max(conf) AS c FROM people GROUP BY frame_id), t AS (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS threshold)
 SELECT threshold, count(*) FILTER (frame_id % 3 = 0 AND coalesce(c, 0) >= threshold) AS hits, count(*) FILTER (frame_id % 3 = 0 AND coalesce(c, 0) < threshold) AS misses, count(*) FILTER (frame_id % 3 <> 0 AND coalesce(c, 0) >= threshold) AS false_alarms FROM f, t GROUP BY threshold""")
def a18(spark, d):
    f = people(spark, d).groupBy("frame_id").agg(F.max("conf").alias("conf"))
    return metrics.frame_sweep(f.select((F.col("frame_id") % 3 == 0).alias("positive"), "conf"), [0.25, 0.5, 0.75])


@query("a19_nearest_operating_point", f"WITH {_SO}, {_RATES} SELECT t AS conf, round(tnr, 6) AS precision, round(tpr, 6) AS recall, CAST(round_even(200 * (1 - tpr), 0) AS BIGINT) AS missed FROM rt ORDER BY abs(t - 0.101), t LIMIT 1")
def a19(spark, d):
    curve = metrics.rates_by_threshold(_same_other(spark, d), 401, -0.5, 0.5).select(F.col("threshold").alias("conf"), F.col("tnr").alias("precision"), F.col("tpr").alias("recall"))
    return metrics.nearest_point(curve, 0.101, F.lit(200.0)).select("conf", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "missed")


def _models(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("model"), (F.col("p_partkey") * 7 % 40).alias("missed"), (F.col("p_partkey") * 3 % 20).alias("fp"), ((F.col("p_partkey") * 11 % 100) / F.lit(100)).alias("map"))
    return p


@query("a20_promotion_rule", "SELECT p_partkey AS model, p_partkey * 7 % 40 AS missed, p_partkey * 3 % 20 AS fp, (p_partkey * 11 % 100) / 100 AS map FROM part WHERE p_partkey * 7 % 40 < 19 AND p_partkey * 3 % 20 <= 8 AND (p_partkey * 11 % 100) / 100 >= 0.57 ORDER BY missed, model LIMIT 1")
def a20(spark, d):
    return metrics.promoted(_models(spark, d), F.lit(19), F.lit(8))


@query("a21_crop_stats", f"WITH {PEOPLE} SELECT count(*) AS n, quantile_cont(y2 - y1, 0.5) AS median, quantile_cont(y2 - y1, 0.1) AS p10, round(avg(CAST(y2 - y1 >= 64 AS INT)), 4) AS usable FROM people")
def a21(spark, d):
    return metrics.crop_stats(people(spark, d).withColumn("height", F.col("y2") - F.col("y1")), "height")


@query("a22_median_of_rounds", f"WITH {PRESENCE} SELECT event_type, quantile_cont(value, 0.5) AS median FROM presence GROUP BY event_type")
def a22(spark, d):
    return presence(spark, d).groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("median"))


@query("a23_identity_log", f"WITH {_VISITS}, p AS (SELECT person, visit, count(*) AS frames FROM v GROUP BY ALL) SELECT person, count(*) AS visits, count(*) - 1 AS re_entries, round(sum(frames) / 20, 1) AS visible_s, max(frames) AS longest FROM p GROUP BY person")
def a23(spark, d):
    log = metrics.identity_log(ordered.visits(presence(spark, d), "person", "t_us", 6 * _HOUR, "event_id"), "person", "t_us", 20.0)
    return log.select("person", "visits", "re_entries", "visible_s", F.array_max(F.transform("segments", lambda s: s["frames"])).alias("longest"))


@query("a25_group_class_counts", f"""WITH {POOL}, u AS (SELECT image_id % 50 AS group_id, src, bg, unnest(CASE WHEN len(labels) > 0 THEN labels ELSE [NULL] END).cls AS cls, image_id FROM pool)
 SELECT group_id, count(DISTINCT image_id) AS n, count(DISTINCT src) AS n_sources, count(DISTINCT image_id) FILTER (bg) AS background, count(*) FILTER (cls = 0) AS class_0, count(*) FILTER (cls = 1) AS class_1, count(*) FILTER (cls = 2) AS class_2 FROM u GROUP BY group_id""")
def a25(spark, d):
    rows = pool(spark, d).select((F.col("image_id") % 50).alias("group_id"), F.col("src").alias("source"), "bg", F.transform("labels", lambda b: b["cls"]).alias("cls"))
    return metrics_group(rows)


def metrics_group(rows):
    return curation.group_counts(rows)


@query("a27_degenerate_embeddings", f"WITH {SAMPLES}, n AS (SELECT sqrt(list_dot_product(feat, feat)) AS n FROM samples) SELECT round(median(n), 6) AS median, median(n) < 0.5 AS broken FROM n")
def a27(spark, d):
    from tessera.functions import vectors as v

    return metrics.degenerate(samples(spark, d).select(v.norm(F.col("feat")).alias("norm")))


@query("a29_verdict", f"WITH {_PERSON}, x AS (SELECT q_id, avg(cen) FILTER (q_pid = g_pid) - avg(cen) FILTER (q_pid <> g_pid) AS s FROM ps WHERE q_pid >= 0 GROUP BY q_id) SELECT q_id, CASE WHEN s < 0.15 THEN 'poor' WHEN s < 0.25 THEN 'marginal' WHEN s < 0.35 THEN 'usable' ELSE 'good' END AS band, CASE WHEN (q_id // 100) % 2 = 0 THEN 'insufficient' WHEN s < 0.25 THEN 'weak' WHEN s < 0.35 THEN 'fair' ELSE 'strong' END AS verdict FROM x")
def a29(spark, d):
    p = _person_scores(spark, d).where("q_pid >= 0")
    same = F.col("q_pid") == F.col("g_pid")
    x = p.groupBy("q_id").agg((F.avg(F.when(same, F.col("cen"))) - F.avg(F.when(~same, F.col("cen")))).alias("s"))
    n = F.expr("q_id div 100") % 2 * 60
    return x.select("q_id", metrics.separation_band(F.col("s")).alias("band"), metrics.verdict(F.col("s"), F.lit(0.9), n, n).alias("verdict"))


@query("c1_detection_stream", f"WITH {CANDIDATES} SELECT frame_id % 4 AS stream_id, label, count(*) AS n, max(conf) AS best FROM cand GROUP BY ALL")
def c1(spark, d):
    """The files of a folder as a bounded stream of detections, written on as they come and then counted."""
    ws = Workspace(spark)
    landing, log = f"{ws.root}/in", f"{ws.root}/out"
    candidates(spark, d).withColumn("stream_id", F.col("frame_id") % 4).repartition(4, "frame_id").write.parquet(landing)
    rows = stateful.frames_stream(spark, landing, spark.read.parquet(landing).schema, per_batch=2).where("cand_id is not null")
    rows.writeStream.format("parquet").option("path", log).option("checkpointLocation", f"{ws.root}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(log).groupBy("stream_id", "label").agg(F.count("*").alias("n"), F.max("conf").alias("best"))


@query("c15_alert_log", "SELECT threat_name, CAST(sum(2) AS BIGINT) AS n, count(DISTINCT person_id) AS persons, round(max(confidence), 9) AS best FROM alerts GROUP BY threat_name")
def c15(spark, d):
    """The log appended to twice, and read back."""
    path = f"{Workspace(spark).root}/log"
    a = table(spark, d, "alerts").withColumn("timestamp", F.col("timestamp").cast("string"))
    tables.append_alerts(a, path)
    tables.append_alerts(a, path)
    back = spark.read.csv(path, header=True, schema="timestamp string, person_id long, threat_level int, threat_name string, weapons string, confidence double, bbox string, arm_raised boolean, approaching boolean", multiLine=True, **tables.EXACT_CSV)
    return back.groupBy("threat_name").agg(F.count("*").alias("n"), F.countDistinct("person_id").alias("persons"), F.round(F.max("confidence"), 9).alias("best"))


@query("c16_json_result", f"WITH {PRESENCE} SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM presence GROUP BY event_type")
def c16(spark, d):
    path = f"{Workspace(spark).root}/result"
    tables.write_result(presence(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median")), path)
    return spark.read.schema("event_type string, n long, median double").json(path)


@query("c17_dataset_emit", f"WITH {POOL} SELECT {_SPLIT} AS split, coalesce(src, '?') || '__' || regexp_replace(regexp_extract(img, '([^/]*)$', 1), '\\.[^.]*$', '') AS name, count(*) AS n FROM pool WHERE split IS NOT NULL GROUP BY ALL")
def c17(spark, d):
    path = f"{Workspace(spark).root}/dataset"
    rows = _split_pool(spark, d).where("split is not null").select("split", F.coalesce("src", F.lit("?")).alias("source"), curation.stem(F.col("img")).alias("stem"))
    tables.write_dataset(rows, path)
    return spark.read.parquet(path).groupBy("split", "name").agg(F.count("*").alias("n"))


@query("c2_first_frames", f"WITH {PEOPLE} SELECT frame_id, count(*) AS n FROM people WHERE frame_id < 100 GROUP BY frame_id")
def c2(spark, d):
    return tables.first_frames(people(spark, d), 100).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("c3_stride", f"WITH {PEOPLE} SELECT DISTINCT frame_id FROM people WHERE frame_id % 5 = 0")
def c3(spark, d):
    return tables.every_nth(people(spark, d), 5).select("frame_id").distinct()


@query("c4_mot_boxes", f"WITH {PEOPLE} SELECT frame_id AS frame, track_id AS id, x1, y1, x2, y2, conf AS visibility FROM people WHERE k % 4 <> 0 AND k % 5 <> 0")
def c4(spark, d):
    raw = people(spark, d).select(
        F.col("frame_id").alias("frame"), F.col("track_id").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"),
        F.when(F.col("k") % 4 == 0, 0.0).otherwise(1.0).alias("conf"), F.when(F.col("k") % 5 == 0, 7).otherwise(1).alias("class"), F.col("conf").alias("visibility"))
    return tables.mot_boxes(raw)


@query("c5_event_documents", f"WITH {_PAIRS} SELECT CAST(person AS VARCHAR) AS clip, exit_at AS exit_frame, return_at AS return_frame FROM pairs")
def c5(spark, d):
    docs = _reentries(spark, d).groupBy(F.col("person").cast("string").alias("clip")).agg(F.lit(20.0).alias("fps"), F.collect_list(F.struct(F.lit("p").alias("person"), F.col("exit_at").alias("exit_frame"), F.col("return_at").alias("return_frame"), F.lit("").alias("note"))).alias("events"))
    parsed = docs.select(F.from_json(F.to_json(F.struct("*")), tables.EVENTS_SCHEMA).alias("j")).select("j.*")
    return tables.reentry_events(parsed).select("clip", "exit_frame", "return_frame")


@query("c6_gallery_file_names", f"WITH {SAMPLES} SELECT vec_id, pid, cam + 1 AS cam FROM samples")
def c6(spark, d):
    s = samples(spark, d).select("vec_id", F.format_string("%s_c%ds1_%06d_00.jpg", F.when(F.col("pid") < 0, "-1").otherwise(F.lpad(F.col("pid").cast("string"), 4, "0")), F.col("cam") + 1, F.col("vec_id")).alias("name"))
    pid, cam = tables.gallery_key(F.col("name"))
    return s.select("vec_id", pid.alias("pid"), cam.alias("cam"))


@query("c7_list_lines", f"WITH {SAMPLES} SELECT vec_id, printf('%d/%04d_000_%02d_img %d.jpg', person, person, cam + 1, vec_id) AS path, person AS pid, cam FROM samples")
def c7(spark, d):
    line = F.format_string("%d/%04d_000_%02d_img %d.jpg %d", "person", "person", F.col("cam") + 1, "vec_id", "person")
    path, pid, cam = tables.list_entry(line)
    return samples(spark, d).select("vec_id", path.alias("path"), pid.alias("pid"), cam.alias("cam"))


@query("c8_random_subsample", "SELECT image_id FROM (SELECT DISTINCT image_id FROM build_dataset) ORDER BY md5(image_id || '/0'), image_id LIMIT 100")
def c8(spark, d):
    return curation.keep_random(pool(spark, d).select("image_id"), "image_id", 100)


_LINES = f"""{POOL}, lb AS (SELECT image_id, unnest(labels) AS b FROM pool)"""


@query("c9_label_lines", f"WITH {_LINES} SELECT image_id, b.cls AS cls, round(b.cx, 4) AS cx, round(b.w, 4) AS w FROM lb")
def c9(spark, d):
    text = pool(spark, d).select("image_id", F.explode("labels").alias("b")).select("image_id", F.concat_ws(" ", "b.cls", "b.cx", "b.cy", "b.w", "b.h").alias("line"))
    bad = text.select("image_id", F.explode(F.array("line", F.lit("1 0.5 0.5"), F.lit("x 0 0 0 0"))).alias("line")).distinct()
    n = text.groupBy("image_id", "line").agg(F.count("*").alias("n"))
    parsed = bad.join(n, ["image_id", "line"], "left").select("image_id", tables.label_line(F.col("line")).alias("l"), F.explode(F.sequence(F.lit(1), F.coalesce(F.col("n"), F.lit(1)).cast("int"))))
    return parsed.where("l is not null").select("image_id", "l.cls", F.round("l.cx", 4).alias("cx"), F.round("l.w", 4).alias("w"))


@query("c11_person_labels", f"WITH {PEOPLE} SELECT k AS image_id, 0 AS cls, round((x1 + x2) / 2 / 640, 9) AS cx, round((y1 + y2) / 2 / 480, 9) AS cy, round((x2 - x1) / 640, 9) AS w, round((y2 - y1) / 480, 9) AS h FROM people WHERE k % 3 = 1 AND k % 5 <> 0")
def c11(spark, d):
    p = people(spark, d)
    images = p.select(F.col("k").alias("id"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    ann = p.select(F.col("k").alias("image_id"), (F.col("k") % 3).alias("category_id"), F.when(F.col("k") % 5 == 0, 1).otherwise(0).alias("iscrowd"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"))
    return tables.person_labels(images, ann).select("image_id", "cls", *[F.round(c, 9).alias(c) for c in ("cx", "cy", "w", "h")])


@query("c13_class_report", f"WITH {_LINES}, s AS (SELECT coalesce(src, '?') AS source, b.cls AS cls FROM lb JOIN pool USING (image_id)) SELECT source, cls, CASE cls WHEN 0 THEN 'guns' WHEN 1 THEN 'knife' WHEN 2 THEN 'long_gun' END AS name, count(*) AS n, cls NOT BETWEEN 0 AND 2 AS stray FROM s GROUP BY source, cls")
def c13(spark, d):
    labels = pool(spark, d).select(F.coalesce("src", F.lit("?")).alias("source"), F.explode(F.transform("labels", lambda b: b["cls"])).alias("cls"))
    names = spark.createDataFrame([(0, "guns"), (1, "knife"), (2, "long_gun")], "cls int, name string")
    return tables.class_report(labels, names)


def _targets(spark, d):
    p = pool(spark, d)
    images = p.select("image_id", (F.size("labels") == 0).alias("explicit_empty"))
    target = F.when(F.col("cls").isin(0, 1, 2), "kept").when(F.col("cls") % 2 == 0, curation.DROP).otherwise(curation.BACKGROUND)
    return images, p.select("image_id", F.explode(F.transform("labels", lambda b: b["cls"])).alias("cls")).select("image_id", target.alias("target"))


@query("d1_harmonise", f"""WITH {_LINES}, f AS (SELECT image_id, bool_or(b.cls IN (0, 1, 2)) AS kept, bool_or(b.cls NOT IN (0, 1, 2) AND b.cls % 2 = 0) AS dropped FROM lb GROUP BY image_id)
 SELECT image_id, CASE WHEN kept THEN 'positive' WHEN dropped THEN 'discarded' WHEN kept IS NOT NULL THEN 'negative' WHEN len(labels) = 0 THEN 'negative' ELSE 'dropped' END AS verdict FROM pool LEFT JOIN f USING (image_id)""")
def d1(spark, d):
    return curation.harmonise(*_targets(spark, d))


def _keyed(spark, d):
    p = _split_pool(spark, d)
    return p.withColumn("name", curation.build_key(F.coalesce("src", F.lit("?")), curation.stem(F.col("img"))))


_KEYED = f"{POOL}, kp AS (SELECT image_id, CASE WHEN hash <> 0 THEN hash END AS h, coalesce(src, '?') || ':' || regexp_replace(regexp_replace(regexp_extract(img, '([^/]*)$', 1), '\\.[^.]*$', ''), '\\.rf\\.[0-9a-f]+$', '') AS nm FROM pool)"
_EDGES = _NEAR.format("kp") + ", ed AS (SELECT a, b FROM near UNION SELECT (SELECT min(x.image_id) FROM kp x WHERE x.nm = b.nm), b.image_id FROM kp b WHERE (SELECT min(x.image_id) FROM kp x WHERE x.nm = b.nm) < b.image_id)"


def _edges(spark, d):
    return curation.group_edges(_keyed(spark, d), "image_id", "bits", "name", 6)


@query("d2_group_edges", f"WITH {_KEYED}, {_EDGES} SELECT a, b FROM ed")
def d2(spark, d):
    return _edges(spark, d)


def _groups(spark, d):
    c = curation.components(_edges(spark, d), tables.cutter(spark))
    return _keyed(spark, d).join(c, F.col("image_id") == F.col("id"), "left").withColumn("group_id", F.coalesce("root", "image_id"))


_GROUPS = f"{_KEYED}, {_EDGES}, bw AS (SELECT a AS x, b AS y FROM ed UNION SELECT b, a FROM ed), rc(v, u) AS (SELECT x, y FROM bw UNION SELECT rc.v, bw.y FROM rc JOIN bw ON rc.u = bw.x), gr AS (SELECT image_id, coalesce(least(image_id, min(u)), image_id) AS group_id FROM kp LEFT JOIN rc ON v = image_id GROUP BY image_id)"


@query("d3_transitive_groups", f"WITH RECURSIVE {_GROUPS} SELECT image_id, group_id FROM gr")
def d3(spark, d):
    return _groups(spark, d).select("image_id", "group_id")


def _group_rows(spark, d):
    return _groups(spark, d).select("image_id", "group_id", F.coalesce("src", F.lit("?")).alias("source"), "bg", F.transform("labels", lambda b: b["cls"]).alias("cls"))


@query("d4_group_aggregates", f"WITH RECURSIVE {_GROUPS}, s AS (SELECT group_id, count(*) AS n, count(DISTINCT coalesce(src, '?')) AS ns FROM gr JOIN pool USING (image_id) GROUP BY group_id) SELECT CAST(sum(n) AS BIGINT) AS images, count(*) AS groups, CAST(sum(n) - count(*) AS BIGINT) AS absorbed, count(*) FILTER (ns > 1) AS cross_source FROM s")
def d4(spark, d):
    g = curation.group_counts(_group_rows(spark, d))
    return g.agg(F.sum("n").alias("images"), F.count("*").alias("groups"), (F.sum("n") - F.count("*")).alias("absorbed"), F.count_if(F.col("n_sources") > 1).alias("cross_source"))


_CLS = ["class_0", "class_1", "class_2", "background"]


_COUNTS = """gc AS (SELECT group_id, count(*) FILTER (c = 0) AS c0, count(*) FILTER (c = 1) AS c1, count(*) FILTER (c = 2) AS c2, count(DISTINCT image_id) FILTER (bg) AS c3
 FROM (SELECT group_id, image_id, bg, unnest(CASE WHEN len(labels) > 0 THEN labels ELSE [NULL] END).cls AS c FROM gr JOIN pool USING (image_id)) GROUP BY group_id),
 tg AS (SELECT round_even(sum(c0) * 0.15, 0) AS t0, round_even(sum(c1) * 0.15, 0) AS t1, round_even(sum(c2) * 0.15, 0) AS t2, round_even(sum(c3) * 0.15, 0) AS t3 FROM gc),
 od AS (SELECT *, row_number() OVER (ORDER BY md5(group_id || '/0'), group_id) AS n FROM gc)"""


@query("d5_stratified_holdout", f"""WITH RECURSIVE {_GROUPS}, {_COUNTS}, f(n, group_id, take, h0, h1, h2, h3) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT)
 UNION ALL SELECT n, group_id, take, h0 + CASE WHEN take THEN c0 ELSE 0 END, h1 + CASE WHEN take THEN c1 ELSE 0 END, h2 + CASE WHEN take THEN c2 ELSE 0 END, h3 + CASE WHEN take THEN c3 ELSE 0 END FROM (
  SELECT od.*, h0, h1, h2, h3, NOT (h0 >= t0 AND h1 >= t1 AND h2 >= t2 AND h3 >= t3) AND NOT ((h0 >= t0 AND c0 > 0) OR (h1 >= t1 AND c1 > 0) OR (h2 >= t2 AND c2 > 0) OR (h3 >= t3 AND c3 > 0)) AS take FROM f JOIN od ON od.n = f.n + 1, tg))
 SELECT group_id, CASE WHEN take THEN 'val' ELSE 'train' END AS split FROM f WHERE n > 0""")
def d5(spark, d):
    return curation.choose_holdout(curation.group_counts(_group_rows(spark, d)), 0.15, _CLS)


@query("d6_forced_holdout", "SELECT DISTINCT group_id FROM (SELECT group_id, unnest(clips) AS clip FROM resplit_dataset) WHERE clip = (SELECT min(c) FROM (SELECT unnest(clips) AS c FROM resplit_dataset) WHERE c LIKE 'cctv%')")
def d6(spark, d):
    clips = table(spark, d, "resplit_dataset").select("group_id", F.explode("clips").alias("clip"))
    named = clips.where("clip like 'cctv%'").agg(F.min("clip").alias("c")).first()["c"]
    return curation.forced_holdout(clips, [named])


@query("d7_split_manifest", f"WITH {POOL} SELECT {_SPLIT} AS split, coalesce(src, '?') AS source, count(*) AS n, count(DISTINCT image_id % 50) AS n_groups FROM pool GROUP BY ALL")
def d7(spark, d):
    return curation.split_manifest(_split_pool(spark, d).select("split", F.coalesce("src", F.lit("?")).alias("source"), (F.col("image_id") % 50).alias("group_id")))


@query("d8_leakage_gate", f"""WITH {POOL}, s AS (SELECT image_id, {_SPLIT} AS split, hash FROM pool WHERE hash <> 0), b AS (SELECT a.image_id, min(bit_count(xor(a.hash, b.hash))) AS best FROM s a JOIN s b ON a.split = 'val' AND b.split = 'train' GROUP BY a.image_id)
 SELECT max_bits, count(*) FILTER (best <= max_bits) AS leaks, count(*) FILTER (best <= max_bits) > 0 AS failed FROM b, (VALUES (4), (6), (10)) l(max_bits) GROUP BY max_bits""")
def d8(spark, d):
    p = _split_pool(spark, d)
    return curation.leakage_gate(curation.nearest_across(p.where("split = 'val'"), p.where("split = 'train'"), "image_id", "bits"))


@query("d9_occlusion_retention", f"""WITH {WALK}, t AS (SELECT person, frame_id, value % 3 AS ident FROM walk WHERE value IS NOT NULL AND NOT frame_id BETWEEN 190 AND 210), b AS (SELECT person, ident FROM (SELECT person, ident, count(*) AS n, min(frame_id) AS f FROM t WHERE frame_id >= 175 AND frame_id < 190 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY person ORDER BY n DESC, f) = 1),
 a AS (SELECT person, ident FROM (SELECT person, ident, count(*) AS n, min(frame_id) AS f FROM t WHERE frame_id >= 213 AND frame_id < 236 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY person ORDER BY n DESC, f) = 1) SELECT person, b.ident AS before, a.ident AS after, b.ident = a.ident AS kept FROM b JOIN a USING (person)""")
def d9(spark, d):
    t = walk(spark, d).where("value is not null AND NOT frame_id BETWEEN 190 AND 210").select("person", "frame_id", (F.col("value") % 3).alias("ident"))
    b = metrics.dominant(t.where("frame_id >= 175 AND frame_id < 190"), ["person"], "ident", ["frame_id"]).withColumnRenamed("ident", "before")
    a = metrics.dominant(t.where("frame_id >= 213 AND frame_id < 236"), ["person"], "ident", ["frame_id"]).withColumnRenamed("ident", "after")
    return b.join(a, "person").withColumn("kept", F.col("before") == F.col("after"))
