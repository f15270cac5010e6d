"""Queries of matching, ordered analytics, identity and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import vectors as v
from tessera.functions.geometry import Box
from tessera.operators import alerting, assignment, curation, gates, identity, matching, metrics, ordered, suppression, tracking, trials
from tessera.plans.registry import query
from tessera.plans.scalar import _AREA, _CW, _IOU, _IOU_C, _TP, _W
from tessera.plans.views import CANDIDATES, LEAST_COST, PEOPLE, POOL, POSED, PRESENCE, SAMPLES, WALK, candidates, people, pool, posed, presence, samples, table, walk

_HOUR = 3_600_000_000


_LATE = "late AS (SELECT frame_id, det_id, x1 + 3 AS x1, y1 + 2 AS y1, x2 + 3 AS x2, y2 + 2 AS y2 FROM people)"


@query("j1_feature_attach", f"""WITH {PEOPLE}, {_LATE}, j AS (SELECT a.frame_id, a.det_id AS l_det_id, b.det_id AS r_det_id, {_IOU} AS iou FROM late a JOIN people b ON a.frame_id = b.frame_id)
 SELECT frame_id, l_det_id, r_det_id, round(iou, 6) AS iou FROM j WHERE iou > 0.5 QUALIFY row_number() OVER (PARTITION BY frame_id, l_det_id ORDER BY iou DESC, r_det_id) = 1""")
def j1(spark, d):
    """Tracks stand a few pixels beside the detections whose vectors they take."""
    p = people(spark, d).select("frame_id", "det_id", "x1", "y1", "x2", "y2")
    late = p.select("frame_id", "det_id", (F.col("x1") + 3).alias("x1"), (F.col("y1") + 2).alias("y1"), (F.col("x2") + 3).alias("x2"), (F.col("y2") + 2).alias("y2"))
    return matching.best_overlap(late, p, "frame_id", "det_id", "det_id").withColumn("iou", F.round("iou", 6))


def _holders(spark, d):
    p = posed(spark, d).withColumn("person", F.when(F.col("k") % 9 != 0, F.col("track_id"))).withColumnRenamed("det_id", "pos")
    return matching.tiered_association(candidates(spark, d), p)


_PART = _W.replace("a.", "c.").replace("b.", "p.") + " / greatest(1, " + _AREA.format("c") + ")"
_OVER = _IOU_C.replace("a.", "c.").replace("b.", "p.")
_ASSOC = f"""{POSED}, {CANDIDATES}, j AS (SELECT c.frame_id, c.cand_id, c.label, c.conf, p.track_id AS person, p.det_id, p.k, coalesce(p.py15 < p.py11, false) OR coalesce(p.py16 < p.py12, false) AS raised,
 coalesce({_CW.format(15)}, false) OR coalesce({_CW.format(16)}, false) AS wrist, {_PART} AS part, {_OVER} AS over FROM cand c JOIN posed p ON c.frame_id = p.frame_id WHERE p.k % 9 <> 0),
 assoc AS (SELECT *, CASE WHEN wrist THEN 'wrist' WHEN part >= 0.3 THEN 'containment' ELSE 'iou' END AS method, CASE WHEN wrist THEN 1.0 WHEN part >= 0.3 THEN part ELSE over END AS score FROM j WHERE wrist OR part >= 0.3 OR over >= 0.2
 QUALIFY row_number() OVER (PARTITION BY frame_id, cand_id ORDER BY wrist DESC, CASE WHEN wrist THEN 0.0 ELSE -(CASE WHEN part >= 0.3 THEN part ELSE over END) END, det_id) = 1)"""


@query("j2_tiered_association", f"WITH {_ASSOC} SELECT frame_id, cand_id, person, method, round(score, 6) AS score FROM assoc")
def j2(spark, d):
    return _holders(spark, d).withColumn("score", F.round("score", 6))


@query("j3_attached_to_person", f"WITH {PEOPLE}, {CANDIDATES} SELECT c.frame_id, c.cand_id FROM cand c WHERE EXISTS (SELECT 1 FROM people p WHERE p.frame_id = c.frame_id AND ({_OVER} >= 0.2 OR {_PART} >= 0.3))")
def j3(spark, d):
    return matching.attached(candidates(spark, d), people(spark, d)).select("frame_id", "cand_id")


_CXY = "sqrt(power(q.cx - (p.x1 + p.x2) / 2, 2) + power(q.cy - (p.y1 + p.y2) / 2, 2))"
_INSIDE = "q.cx BETWEEN p.x1 AND p.x2 AND q.cy BETWEEN p.y1 AND p.y2"
_POSES = f"""{POSED}, q AS (SELECT frame_id, det_id, {_TP.format('px')} AS cx, {_TP.format('py')} AS cy FROM posed), qs AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY det_id) AS i FROM q WHERE cx IS NOT NULL),
 mc AS (SELECT q.frame_id, q.i, q.det_id AS pose, CAST(p.det_id AS INT) AS j, CASE WHEN {_INSIDE} THEN {_CXY} WHEN {_CXY} <= 120 THEN {_CXY} + 120 ELSE 1e6 END AS cost FROM qs q JOIN (SELECT frame_id, det_id, x1 + 3.3::DOUBLE AS x1, y1 + 2.7::DOUBLE AS y1, x2 + 3.3::DOUBLE AS x2, y2 + 2.7::DOUBLE AS y2 FROM people) p USING (frame_id)),
 {LEAST_COST}, pa AS (SELECT mc.frame_id, mc.pose, CAST(mc.j AS BIGINT) AS track, mc.cost FROM solved s JOIN mc ON mc.frame_id = s.frame_id AND mc.i = s.i AND mc.j = s.j WHERE mc.cost < 1e6)"""


@query("j4_pose_assignment", f"WITH {_POSES} SELECT frame_id, pose, track, round(cost, 6) AS cost FROM pa")
def j4(spark, d):
    return _pose_assignment(spark, d).withColumn("cost", F.round("cost", 6))


def _pose_assignment(spark, d):
    """Tracks stand a little beside the boxes, so that no two pairings cost the same."""
    c = g.torso_centre(F.col("kp"))
    poses = posed(spark, d).select("frame_id", F.col("det_id").alias("pose"), c.alias("c")).where("c is not null")
    tracks = people(spark, d).select("frame_id", F.col("det_id").alias("track"), *[(F.col(c) + (3.3 if c[0] == "x" else 2.7)).alias(c) for c in matching.BOX])
    cx, cy = g.centre(Box.of())
    j = poses.join(tracks, "frame_id").withColumn("dist", g.distance(F.col("c.x"), F.col("c.y"), cx, cy))
    inside = F.col("c.x").between(F.col("x1"), F.col("x2")) & F.col("c.y").between(F.col("y1"), F.col("y2"))
    return assignment.assign_poses(j.select("frame_id", "pose", "track", "dist", inside.alias("inside")), ["frame_id"], "pose", "track")


@query("j6_truth_assignment", f"WITH {PEOPLE} SELECT frame_id, det_id AS truth, det_id AS pred, 1.0 AS iou FROM people")
def j6(spark, d):
    a = people(spark, d).select("frame_id", F.col("det_id").alias("truth"), *[F.col(c).alias(f"a_{c}") for c in matching.BOX])
    b = people(spark, d).select("frame_id", F.col("det_id").alias("pred"), *[F.col(c).alias(f"b_{c}") for c in matching.BOX])
    j = a.join(b, "frame_id").select("frame_id", "truth", "pred", g.iou(Box.of("a_"), Box.of("b_")).alias("iou"))
    return assignment.assign_overlaps(j, ["frame_id"], "truth", "pred").withColumn("iou", F.round("iou", 6))


@query("j7_chain_tracks", f"""WITH {WALK}, b AS (SELECT person, frame_id, CAST(frame_id * 3 % 40 AS DOUBLE) AS x FROM walk),
 l AS (SELECT *, CASE WHEN lag(frame_id) OVER w = frame_id - 1 AND (30 - abs(x - lag(x) OVER w)) / (30 + abs(x - lag(x) OVER w)) >= 0.5 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY person ORDER BY frame_id)),
 t AS (SELECT person, frame_id, CAST(sum(new) OVER (PARTITION BY person ORDER BY frame_id) AS BIGINT) AS track FROM l)
 SELECT person, frame_id, CAST(0 AS BIGINT) AS det_id, track FROM t QUALIFY count(*) OVER (PARTITION BY person, track) >= 3""")
def j7(spark, d):
    w = walk(spark, d).select("person", "frame_id", F.lit(0).cast("long").alias("det_id"), (F.col("frame_id") * 3 % 40).cast("double").alias("x1"), F.lit(0.0).alias("y1"))
    w = w.withColumn("x2", F.col("x1") + 30).withColumn("y2", F.lit(60.0))
    return suppression.chain_tracks(w, "person", "frame_id", "det_id")


_SPLIT = "CASE WHEN split = 'valid' THEN 'val' ELSE split END"


def _split_pool(spark, d):
    return pool(spark, d).withColumn("split", F.when(F.col("split") == "valid", "val").otherwise(F.col("split"))).withColumn("bits", F.when(F.col("hash") != 0, F.col("hash")))


@query("j8_cross_split_nearest", f"""WITH {POOL}, s AS (SELECT image_id, {_SPLIT} AS split, hash FROM pool WHERE hash <> 0)
 SELECT a.image_id AS val_id, CAST(min(bit_count(xor(a.hash, b.hash))) AS INT) AS best FROM s a JOIN s b ON a.split = 'val' AND b.split = 'train' GROUP BY a.image_id""")
def j8(spark, d):
    p = _split_pool(spark, d)
    return curation.nearest_across(p.where("split = 'val'"), p.where("split = 'train'"), "image_id", "bits")


_NEAR = """nb AS (SELECT h, min(image_id) AS first FROM {0} WHERE h IS NOT NULL GROUP BY h), near AS (SELECT first AS a, image_id AS b FROM {0} JOIN nb USING (h) WHERE image_id > first
 UNION SELECT least(x.first, y.first), greatest(x.first, y.first) FROM nb x JOIN nb y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= 6)"""


@query("j9_near_duplicate_pairs", f"WITH {POOL}, s AS (SELECT image_id, nullif(hash, 0) AS h FROM pool), {_NEAR.format('s')} SELECT a, b FROM near")
def j9(spark, d):
    return curation.near_pairs(_split_pool(spark, d), "image_id", "bits", 6)


def _typed_labels(spark, d):
    labels = table(spark, d, "class_map").where("classes is not null").select("entry_id", F.lit("all").alias("source"), F.col("classes").alias("class"))
    refs = table(spark, d, "class_ref").select(F.lit("all").alias("source"), F.col("class_name").alias("src_class"), "target")
    return labels, refs


@query("j10_class_map_lookup", "SELECT entry_id, classes AS class, target FROM class_map LEFT JOIN class_ref ON classes = class_name WHERE classes IS NOT NULL")
def j10(spark, d):
    return curation.mapped(*_typed_labels(spark, d)).select("entry_id", "class", "target")


@query("g15_forbidden_class", "SELECT class_name AS src_class, target FROM class_ref WHERE class_name IN ('person_with_weapon', 'handgun') AND target IN ('guns', 'knife', 'long_gun')")
def p15(spark, d):
    return curation.forbidden(_typed_labels(spark, d)[1], ["person_with_weapon", "handgun"], ["guns", "knife", "long_gun"]).select("src_class", "target")


@query("g16_unmapped_class", "SELECT classes AS class, count(*) AS n FROM class_map WHERE classes IS NOT NULL AND classes NOT IN (SELECT class_name FROM class_ref) GROUP BY classes")
def p16(spark, d):
    return curation.unmapped(*_typed_labels(spark, d)).select("class", "n")


@query("j11_same_frame_negatives", f"WITH {SAMPLES} SELECT frame_id, a.person AS a, b.person AS b, round(list_dot_product(a.feat, b.feat), 6) AS sim FROM samples a JOIN samples b USING (frame_id) WHERE a.person < b.person")
def j11(spark, d):
    s = samples(spark, d).withColumn("clip", F.lit(0))
    return matching.same_frame_negatives(s, "clip", "frame_id", "person").select("frame_id", "a", "b", F.round(v.dot(F.col("a_feat"), F.col("b_feat")), 6).alias("sim"))


@query("j12_same_identity_pairs", f"WITH {SAMPLES} SELECT person, b.frame_id - a.frame_id >= 30 AS is_long, count(*) AS n, round(avg(list_dot_product(a.feat, b.feat)), 6) AS mean FROM samples a JOIN samples b USING (person) WHERE a.frame_id < b.frame_id GROUP BY ALL")
def j12(spark, d):
    p = matching.same_identity_likeness(samples(spark, d), "person", "frame_id")
    return p.select("person", "is_long", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"))


@query("j13_apart_samples", f"WITH {SAMPLES} SELECT q.vec_id AS query_id, count(*) AS n FROM samples q JOIN samples g ON q.person = g.person AND abs(q.frame_id - g.frame_id) >= 30 WHERE q.is_query GROUP BY q.vec_id HAVING count(*) >= 3")
def j13(spark, d):
    s = samples(spark, d)
    q = s.where("is_query").select(F.col("vec_id").alias("query_id"), "person", "frame_id")
    return matching.apart_samples(q, s, "person", "frame_id").select("query_id", "n")


def _scored(spark, d):
    s = samples(spark, d)
    q = s.where("is_query").select(F.col("vec_id").alias("q_id"), F.col("pid").alias("q_pid"), F.col("cam").alias("q_cam"), "feat")
    t = s.where("not is_query").select(F.col("vec_id").alias("g_id"), F.col("pid").alias("g_pid"), F.col("cam").alias("g_cam"), "feat")
    return matching.pair_scores(q, t)


_SCORED = f"{SAMPLES}, scored AS (SELECT q.vec_id AS q_id, q.pid AS q_pid, q.cam AS q_cam, g.vec_id AS g_id, g.pid AS g_pid, g.cam AS g_cam, round(list_dot_product(q.feat, g.feat), 6) AS sim FROM samples q, samples g WHERE q.is_query AND NOT g.is_query)"
_CLEAN = "clean AS (SELECT * FROM scored WHERE g_pid <> -1 AND NOT (q_pid = g_pid AND q_cam = g_cam))"


@query("j14_query_gallery", f"WITH {_SCORED}, {_CLEAN} SELECT q_id, count(*) AS n, max(sim) AS best FROM clean GROUP BY q_id")
def j14(spark, d):
    return matching.without_junk(_scored(spark, d)).groupBy("q_id").agg(F.count("*").alias("n"), F.max("sim").alias("best"))


def _timeline(spark, d):
    return people(spark, d).select((F.col("frame_id") % 4).alias("clip"), "frame_id", "det_id", F.when(F.col("k") % 5 != 0, F.col("track_id")).alias("ident"))


def _asof_events(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("clip"), (F.col("event_id") % 1500).alias("at"))


_ASOF = f"{PEOPLE}, tl AS (SELECT frame_id % 4 AS clip, frame_id, det_id, track_id AS ident FROM people WHERE k % 5 <> 0), ev AS (SELECT event_id, event_id % 4 AS clip, event_id % 1500 AS t0 FROM events), fr AS (SELECT DISTINCT clip, frame_id FROM tl)"


@query("j15_nearest_decided", f"""WITH {_ASOF}, b AS (SELECT event_id, max(frame_id) AS before FROM ev JOIN fr USING (clip) WHERE t0 - frame_id BETWEEN 0 AND 240 GROUP BY event_id), a AS (SELECT event_id, min(frame_id) AS after FROM ev JOIN fr USING (clip) WHERE frame_id - t0 BETWEEN 0 AND 240 GROUP BY event_id)
 SELECT event_id, before, after FROM ev LEFT JOIN b USING (event_id) LEFT JOIN a USING (event_id)""")
def j15(spark, d):
    e, t = _asof_events(spark, d), _timeline(spark, d)
    b = matching.as_of(e, t, "event_id", "clip", "at", 240, "before").withColumnRenamed("frame", "before")
    a = matching.as_of(e, t, "event_id", "clip", "at", 240, "after").withColumnRenamed("frame", "after")
    return e.select("event_id").join(b, "event_id", "left").join(a, "event_id", "left")


_PAIRS = f"{PRESENCE}, m AS (SELECT *, lag(mark) OVER w AS pm, lag(t_us) OVER w AS pt FROM presence WHERE mark IS NOT NULL WINDOW w AS (PARTITION BY person ORDER BY t_us, event_id)), pairs AS (SELECT person, pt AS exit_at, t_us AS return_at FROM m WHERE mark = 'return' AND pm = 'exit')"


def _reentries(spark, d):
    return matching.exit_return_pairs(presence(spark, d), "person", ["t_us", "event_id"])


@query("j16_exit_return_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def j16(spark, d):
    return _reentries(spark, d)


@query("j17_unmatched_candidates", f"WITH {_ASSOC} SELECT frame_id, cand_id FROM cand WHERE (frame_id, cand_id) NOT IN (SELECT (frame_id, cand_id) FROM assoc)")
def j17(spark, d):
    return matching.unmatched(candidates(spark, d), _holders(spark, d), ["frame_id", "cand_id"]).select("frame_id", "cand_id")


@query("j18_last_known", f"WITH {WALK} SELECT person, frame_id, last_value(value IGNORE NULLS) OVER (PARTITION BY person ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM walk")
def j18(spark, d):
    return matching.last_known(walk(spark, d), "person", "frame_id", "value", "known").select("person", "frame_id", "known")


def _person_scores(spark, d):
    """sim of each query to each person: best of centroid and weighted best sample."""
    s = samples(spark, d)
    stored = s.where("not is_query AND pid >= 0")
    long = stored.select("person", F.posexplode("feat").alias("i", "x")).groupBy("person", "i").agg(F.avg("x").alias("m"))
    cen = long.groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c")).select(F.col("person").alias("g_id"), F.col("person").alias("g_pid"), F.lit(0).cast("long").alias("g_cam"), v.unit(F.col("c")).alias("feat"))
    q = s.where("is_query").select(F.col("vec_id").alias("q_id"), F.col("pid").alias("q_pid"), F.col("cam").alias("q_cam"), "feat")
    best = matching.pair_scores(q, stored.select(F.col("vec_id").alias("g_id"), F.col("person").alias("g_pid"), F.col("cam").alias("g_cam"), "feat"), best=True).select("q_id", "g_pid", F.col("sim").alias("best"))
    return matching.pair_scores(q, cen).select("q_id", "q_pid", "g_pid", F.col("sim").alias("cen")).join(best, ["q_id", "g_pid"])


_PERSON = f"""{_SCORED}, cm AS (SELECT person, i, avg(feat[i]) AS m FROM samples, range(1, 65) t(i) WHERE NOT is_query AND pid >= 0 GROUP BY person, i),
 cv AS (SELECT person, list(m ORDER BY i) AS c FROM cm GROUP BY person), cs AS (SELECT q.vec_id AS q_id, q.pid AS q_pid, cv.person AS g_pid, round(list_dot_product(q.feat, c) / sqrt(list_dot_product(c, c)), 6) AS cen FROM samples q, cv WHERE q.is_query),
 bs AS (SELECT q_id, g_pid, max(sim) AS best FROM scored WHERE g_pid >= 0 GROUP BY q_id, g_pid), ps AS (SELECT q_id, q_pid, g_pid, cen, best FROM cs JOIN bs USING (q_id, g_pid))"""


@query("f15_centroid", f"WITH {_PERSON} SELECT person, CAST(i - 1 AS INT) AS dim, round(c[i] / sqrt(list_dot_product(c, c)), 6) + 0 AS x FROM cv, range(1, 65) t(i)")
def f15(spark, d):
    long = samples(spark, d).where("not is_query AND pid >= 0").select("person", F.posexplode("feat").alias("i", "x")).groupBy("person", "i").agg(F.avg("x").alias("m"))
    c = long.groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c"))
    return c.select("person", F.posexplode(v.unit(F.col("c"))).alias("dim", "x")).select("person", "dim", (F.round("x", 6) + 0).alias("x"))


@query("f16_identity_similarity", f"WITH {_PERSON} SELECT q_id, g_pid, round(greatest(cen, 0.9 * best), 7) AS sim FROM ps")
def f16(spark, d):
    return _person_scores(spark, d).select("q_id", "g_pid", F.round(v.identity_similarity(F.col("cen"), F.col("best")), 7).alias("sim"))


@query("f17_fused_score", f"WITH {_PERSON} SELECT q_id, g_pid, round(CASE WHEN q_id % 300 = 0 THEN greatest(cen, 0.9 * best) ELSE 0.85 * greatest(cen, 0.9 * best) + 0.15 * cen END, 9) AS score FROM ps")
def f17(spark, d):
    ratio = F.when(F.col("q_id") % 300 != 0, F.col("cen"))
    return _person_scores(spark, d).select("q_id", "g_pid", F.round(v.fused(v.identity_similarity(F.col("cen"), F.col("best")), ratio), 9).alias("score"))


@query("f18_score_variants", f"""WITH {_PERSON}, x AS (SELECT q_pid = g_pid AS same, cen AS centroid, best, greatest(cen, 0.9 * best) AS hybrid, 0.85 * greatest(cen, 0.9 * best) + 0.15 * cen AS hybrid_ratio FROM ps WHERE q_pid >= 0)
 SELECT variant, round(avg(score) FILTER (same) - avg(score) FILTER (NOT same), 6) AS separation FROM (UNPIVOT x ON centroid, best, hybrid, hybrid_ratio INTO NAME variant VALUE score) GROUP BY variant""")
def f18(spark, d):
    hybrid = v.identity_similarity(F.col("cen"), F.col("best"))
    x = _person_scores(spark, d).where("q_pid >= 0").select((F.col("q_pid") == F.col("g_pid")).alias("same"), F.col("cen").alias("centroid"), "best", hybrid.alias("hybrid"), v.fused(hybrid, F.col("cen")).alias("hybrid_ratio"))
    long = x.unpivot("same", ["centroid", "best", "hybrid", "hybrid_ratio"], "variant", "score")
    return long.groupBy("variant").agg(F.round(F.avg(F.when(F.col("same"), F.col("score"))) - F.avg(F.when(~F.col("same"), F.col("score"))), 6).alias("separation"))


@query("w1_ranking_runner_up", f"WITH {_PERSON}, r AS (SELECT q_id, g_pid, round(greatest(cen, 0.9 * best), 7) AS s FROM ps) SELECT q_id, g_pid AS best, s AS s1, coalesce(lead(s) OVER w, 0) AS s2 FROM r WINDOW w AS (PARTITION BY q_id ORDER BY s DESC, g_pid) QUALIFY row_number() OVER w = 1")
def w1(spark, d):
    return identity_ranking(spark, d).select("q_id", F.col("g_pid").alias("best"), "s1", "s2")


def identity_ranking(spark, d):
    from pyspark.sql import Window

    s = _person_scores(spark, d).withColumn("s", F.round(v.identity_similarity(F.col("cen"), F.col("best")), 7))
    w = Window.partitionBy("q_id").orderBy(F.col("s").desc(), "g_pid")
    return s.withColumn("s2", F.coalesce(F.lead("s").over(w), F.lit(0.0))).withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumnRenamed("s", "s1")


@query("w2_decision", f"WITH {_PERSON}, r AS (SELECT q_id, g_pid, round(greatest(cen, 0.9 * best), 7) AS s FROM ps), t AS (SELECT q_id, g_pid, s, coalesce(lead(s) OVER w, 0) AS s2 FROM r WINDOW w AS (PARTITION BY q_id ORDER BY s DESC, g_pid) QUALIFY row_number() OVER w = 1) SELECT q_id, CASE WHEN s < 0.2 THEN 'new' WHEN s >= 0.3 AND s - s2 >= 0.02 THEN 'matched' ELSE 'provisional' END AS outcome FROM t")
def w2(spark, d):
    gap = F.col("s1") - F.col("s2")
    return identity_ranking(spark, d).select("q_id", F.when(F.col("s1") < 0.2, "new").when((F.col("s1") >= 0.3) & (gap >= 0.02), "matched").otherwise("provisional").alias("outcome"))


_VISITS = f"{PRESENCE}, v AS (SELECT *, sum(new) OVER (PARTITION BY person ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY person ORDER BY t_us, event_id) <= {6 * _HOUR} THEN 0 ELSE 1 END AS new FROM presence))"


@query("w3_visits", f"WITH {_VISITS} SELECT person, CAST(visit AS BIGINT) AS visit, count(*) AS n FROM v GROUP BY person, visit")
def w3(spark, d):
    return ordered.visits(presence(spark, d), "person", "t_us", 6 * _HOUR, "event_id").groupBy("person", "visit").agg(F.count("*").alias("n"))


_ISLAND = f"{WALK}, isl AS (SELECT *, frame_id - row_number() OVER (PARTITION BY person ORDER BY frame_id) AS island FROM walk)"


@query("w4_longest_run", f"WITH {_ISLAND} SELECT person, start, n FROM (SELECT person, island, min(frame_id) AS start, count(*) AS n FROM isl GROUP BY person, island) WHERE n >= 10 QUALIFY row_number() OVER (PARTITION BY person ORDER BY n DESC, start) = 1")
def w4(spark, d):
    return ordered.longest_run(walk(spark, d), ["person"], "frame_id", 10)


@query("w5_approaching", f"WITH {_ISLAND} SELECT person, frame_id, coalesce(area >= lag(area, 9) OVER (PARTITION BY person, island ORDER BY frame_id) * 1.5, false) AS approaching FROM isl")
def w5(spark, d):
    return ordered.approaching(walk(spark, d), ["person"], "frame_id", "area").select("person", "frame_id", "approaching")


@query("w6_trail", f"WITH {_ISLAND} SELECT person, frame_id, count(*) OVER w AS n, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM isl WINDOW w AS (PARTITION BY person, island ORDER BY frame_id ROWS 29 PRECEDING)")
def w6(spark, d):
    t = ordered.trail(walk(spark, d), ["person"], "frame_id", F.struct("x", "y"))
    return t.select("person", "frame_id", F.size("trail").cast("long").alias("n"), F.col("trail")[0]["x"].alias("x0"), F.col("trail")[0]["y"].alias("y0"))


@query("w7_hold_last_cycle", f"WITH {PEOPLE}, {CANDIDATES}, f AS (SELECT DISTINCT frame_id FROM people), c AS (SELECT frame_id, count(*) AS n FROM cand GROUP BY frame_id) SELECT f.frame_id, c.n AS held FROM f LEFT JOIN c ON c.frame_id = f.frame_id - f.frame_id % 3")
def w7(spark, d):
    frames = people(spark, d).select("frame_id").distinct()
    cycle = candidates(spark, d).groupBy("frame_id").agg(F.count("*").alias("held"))
    return ordered.held(frames, cycle, "frame_id", 3, []).select("frame_id", "held")


@query("o22_pose_cache", f"""WITH {_POSES}, fr AS (SELECT stream_id, frame_id, n, frame_id % 13 <> 0 AS t, p FROM (SELECT stream_id, frame_id, row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) AS n FROM (SELECT DISTINCT stream_id, frame_id FROM people))
  LEFT JOIN (SELECT frame_id, count(*) AS p FROM pa GROUP BY frame_id) USING (frame_id)),
 em AS (SELECT *, coalesce(last_value(CASE WHEN NOT t THEN true WHEN p > 0 THEN false WHEN n % 4 = 1 THEN true END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS bare FROM fr),
 sr AS (SELECT *, max(CASE WHEN t AND (n % 4 = 1 OR bare) THEN frame_id END) OVER (PARTITION BY stream_id ORDER BY frame_id) AS src FROM em)
 SELECT s.stream_id, s.frame_id, q.det_id AS track, pa.pose, coalesce(pa.pose IS NOT NULL AND src < s.frame_id, false) AS stale FROM sr s JOIN people q USING (frame_id) LEFT JOIN pa ON pa.frame_id = s.src AND pa.track = q.det_id WHERE t""")
def o22(spark, d):
    """Frames divisible by 13 have no tracks."""
    p = people(spark, d).select("stream_id", "frame_id", F.when(F.col("frame_id") % 13 != 0, F.col("det_id")).alias("track"))
    poses = _pose_assignment(spark, d).select("frame_id", "track", "pose").join(p.select("stream_id", "frame_id").distinct(), "frame_id")
    return ordered.pose_cache(p, poses, "stream_id", "frame_id", "track", "pose")


@query("w8_one_frame_lag", f"WITH {WALK} SELECT person, frame_id, lag(value) OVER (PARTITION BY person ORDER BY frame_id) AS before FROM walk")
def w8(spark, d):
    return ordered.one_behind(walk(spark, d), ["person"], "frame_id", "value", "before").select("person", "frame_id", "before")


@query("w9_farthest_points", f"""WITH RECURSIVE {SAMPLES}, f(person, rank, vec_id, ids, feats) AS (SELECT person, 0, vec_id, [vec_id], [feat] FROM samples QUALIFY row_number() OVER (PARTITION BY person ORDER BY vec_id) = 1
 UNION ALL SELECT f.person, f.rank + 1, n.vec_id, list_append(f.ids, n.vec_id), list_append(f.feats, n.feat) FROM f, LATERAL (SELECT s.vec_id, s.feat FROM samples s WHERE s.person = f.person AND NOT list_contains(f.ids, s.vec_id)
  ORDER BY list_max(list_transform(f.feats, lambda c: list_dot_product(c, s.feat))), s.vec_id LIMIT 1) n WHERE f.rank < 15) SELECT person, vec_id, rank FROM f""")
def w9(spark, d):
    return suppression.spread_samples(samples(spark, d), "person", "vec_id", 16)


@query("w10_temporal_plausibility", f"WITH {WALK} SELECT person, frame_id, coalesce((frame_id - pf) * 0.1 > 3 OR sqrt(power(x - px, 2) + power(y - py, 2)) <= 200 + 800 * ((frame_id - pf) * 0.1), true) AS plausible FROM (SELECT *, lag(frame_id) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py FROM walk WINDOW w AS (PARTITION BY person ORDER BY frame_id))")
def w10(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("person").orderBy("frame_id")
    x = walk(spark, d).withColumn("gap", (F.col("frame_id") - F.lag("frame_id").over(w)) * F.lit(0.1)).withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))
    return x.select("person", "frame_id", matching.plausible(F.col("gap"), g.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).alias("plausible"))


@query("w11_escalations", f"WITH {PRESENCE} SELECT person, event_id, level FROM (SELECT *, coalesce(lag(level) OVER (PARTITION BY person ORDER BY t_us, event_id), 0) AS b FROM presence) WHERE level >= 2 AND level > b")
def w11(spark, d):
    return ordered.escalations(presence(spark, d), ["person"], ["t_us", "event_id"], "level").select("person", "event_id", "level")


_BOXES = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
_HIT = "greatest(least(o.x2, c.x2) - greatest(o.x1, c.x1), 0) * greatest(least(o.y2, c.y2) - greatest(o.y1, c.y1), 0)"


@query("o20_suppress_duplicates", f"""WITH RECURSIVE {PEOPLE}, c AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY matched DESC, conf DESC, det_id) AS r FROM people),
 f(frame_id, r, kept) AS (SELECT frame_id, CAST(1 AS BIGINT), [struct_pack(det_id := det_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] FROM c WHERE r = 1
 UNION ALL SELECT f.frame_id, c.r, CASE WHEN len(list_filter(f.kept, lambda o: {_HIT} > 0.8 * ({_BOXES.format('o')} + {_BOXES.format('c')} - {_HIT}))) > 0 THEN f.kept
  ELSE list_append(f.kept, struct_pack(det_id := c.det_id, x1 := c.x1, y1 := c.y1, x2 := c.x2, y2 := c.y2)) END FROM f JOIN c ON c.frame_id = f.frame_id AND c.r = f.r + 1)
 SELECT frame_id, unnest(kept).det_id AS det_id FROM (SELECT frame_id, kept FROM f QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY r DESC) = 1)""")
def o20(spark, d):
    df = people(spark, d).select("frame_id", "det_id", "conf", "matched", "x1", "y1", "x2", "y2")
    return suppression.suppress_duplicates(df, ["frame_id"], "det_id").select("frame_id", "det_id")


def _tracks(spark, d):
    """Every detection with its own track, and the track's vector: that of its number, counted round the embeddings."""
    s = samples(spark, d)
    n = s.agg(F.count("*").alias("n"))
    looks = s.select(F.col("vec_id").alias("look"), "feat")
    p = posed(spark, d).join(F.broadcast(n)).withColumn("look", F.col("track_id") % F.col("n"))
    admit = gates.admission_reason(Box.of(), F.col("conf"), F.col("matched"), F.lit(None).cast("int"), F.lit(True)) == "ok"
    return p.join(looks, "look").select("stream_id", "frame_id", (F.col("frame_id") / 30.0).alias("ts"), "track_id", "x1", "y1", "x2", "y2", "feat", admit.alias("admit"))


@query("o26_identity_resolution")
def o26(spark, d):
    return identity.resolve_streams(_tracks(spark, d)).withColumn("score", F.round("score", 6))


@query("o28_gallery_counters")
def o28(spark, d):
    return o26(spark, d).groupBy("stream_id", "outcome").agg(F.count("*").alias("n"), F.countDistinct("canonical_id").alias("identities"))


def _seen(spark, d):
    c = candidates(spark, d).withColumn("stream_id", F.col("frame_id") % 4)
    return alerting.persistence(c.withColumn("frame_id", F.expr("frame_id div 4"))).withColumn("frame_id", F.col("frame_id") * 4 + F.col("stream_id"))


@query("o35_detection_persistence")
def o35(spark, d):
    return _seen(spark, d).select("stream_id", "frame_id", "cand_id", "seen")


@query("o36_verification")
def o36(spark, d):
    return alerting.verified(_seen(spark, d), people(spark, d)).select("frame_id", "cand_id", "label", "verdict")


@query("a26_verifier_counters")
def a26(spark, d):
    return o36(spark, d).groupBy("label", "verdict").agg(F.count("*").alias("n"))


def _held_items(spark, d):
    a = _holders(spark, d).join(candidates(spark, d).select("frame_id", "cand_id", "label", "conf"), ["frame_id", "cand_id"])
    arms = posed(spark, d).where("k % 9 <> 0").groupBy("frame_id", F.col("track_id").alias("person")).agg(F.bool_or(gates.arm_raised(F.col("kp"))).alias("raised"))
    return a.join(arms, ["frame_id", "person"]).withColumn("approaching", F.col("person") % 5 == 0)


_LEVELS = f"""{_ASSOC}, arms AS (SELECT frame_id, track_id AS person, bool_or(coalesce(py15 < py11, false) OR coalesce(py16 < py12, false)) AS raised FROM posed WHERE k % 9 <> 0 GROUP BY ALL),
 li AS (SELECT a.frame_id, a.person, a.label, a.conf, CASE WHEN method = 'iou' THEN greatest(0, b - 1) WHEN arms.raised THEN least(b + 1, 3) ELSE b END AS l FROM (SELECT *, CASE label WHEN 'knife' THEN 1 WHEN 'guns' THEN 2 ELSE 3 END AS b FROM assoc) a JOIN arms USING (frame_id, person)),
 lp AS (SELECT frame_id, person, CASE WHEN (count(DISTINCT label) > 1 AND bool_or(label = 'guns')) OR (count(*) > 1 AND max(l) >= 2) THEN 3 ELSE max(l) END AS d, count(*) AS n, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels, max(conf) AS conf FROM li GROUP BY frame_id, person)"""


@query("o37_threat_level", f"WITH {_LEVELS} SELECT frame_id, person, CASE WHEN person % 5 = 0 AND d >= 1 THEN least(d + 1, 3) ELSE d END AS desired, n FROM lp")
def o37(spark, d):
    return alerting.desired_levels(_held_items(spark, d), ["frame_id", "person"])


@query("a24_alert_rollup", f"WITH {_LEVELS} SELECT frame_id, max(l) AS level, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels, max(conf) AS confidence FROM li GROUP BY frame_id")
def a24(spark, d):
    h = _held_items(spark, d)
    return metrics.rollup_alert(h.withColumn("level", alerting.item_level(F.col("label"), F.col("method"), F.col("raised"))), ["frame_id"])


@query("o38_hysteresis", f"""WITH RECURSIVE {_ISLAND}, s AS (SELECT person, island, frame_id, row_number() OVER (PARTITION BY person, island ORDER BY frame_id) AS n, CASE WHEN value % 90 > 60 THEN CAST(value % 4 AS INT) END AS d FROM isl),
 f(person, island, n, frame_id, level, streak) AS (SELECT person, island, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, 45 FROM s WHERE n = 1
 UNION ALL SELECT person, island, n, frame_id, CASE WHEN want > level THEN want WHEN want < level AND calm >= 45 THEN level - 1 ELSE level END, CASE WHEN want < level AND calm >= 45 THEN 0 ELSE calm END
 FROM (SELECT s.person, s.island, s.n, s.frame_id, f.level, CASE WHEN d IS NULL THEN f.streak + 1 ELSE 0 END AS calm, CASE WHEN d IS NOT NULL THEN d WHEN f.streak + 1 >= 45 THEN 0 ELSE f.level END AS want
  FROM f JOIN s ON s.person = f.person AND s.island = f.island AND s.n = f.n + 1))
 SELECT CAST(0 AS BIGINT) AS stream_id, person, frame_id, level FROM f WHERE n > 0""")
def o38(spark, d):
    w = walk(spark, d).select(F.lit(0).cast("long").alias("stream_id"), "person", "frame_id", F.when(F.col("value") % 90 > 60, F.col("value") % 4).cast("int").alias("desired"))
    return alerting.levels(w)


_DEDUP = f"""WITH RECURSIVE {PRESENCE}, s AS (SELECT *, row_number() OVER (PARTITION BY person, level ORDER BY t_us, event_id) AS i FROM presence),
 f(person, level, i, t_us, event_id) AS (SELECT person, level, i, t_us, event_id FROM s WHERE i = 1 UNION ALL
 SELECT f.person, f.level, n.i, n.t_us, n.event_id FROM f, LATERAL (SELECT s.i, s.t_us, s.event_id FROM s WHERE s.person = f.person AND s.level = f.level AND s.t_us - f.t_us >= {24 * _HOUR} ORDER BY s.i LIMIT 1) n)
 SELECT person, level, event_id FROM f"""


@query("o39_log_dedup", _DEDUP)
def o39(spark, d):
    p = presence(spark, d).select("person", "level", "event_id", "t_us")
    return alerting.deduplicated(p, ["person", "level"], "t_us", 24 * _HOUR, "event_id").select("person", "level", "event_id")


@query("o40_recordings", f"""WITH RECURSIVE {WALK}, s AS (SELECT person, frame_id, row_number() OVER w AS n, lead(frame_id) OVER w IS NULL AS final, CASE WHEN frame_id % 20 < 3 THEN coalesce(value, 0) % 3 ELSE 0 END >= 2 AS hot FROM walk WINDOW w AS (PARTITION BY person ORDER BY frame_id)),
 f(person, n, frame_id, final, start, calm, done) AS (SELECT person, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM s WHERE n = 1
 UNION ALL SELECT person, n, frame_id, final, CASE WHEN hot THEN coalesce(old, frame_id) WHEN frame_id - since >= 5 THEN NULL ELSE old END, CASE WHEN hot OR frame_id - since >= 5 THEN NULL ELSE since END, CASE WHEN NOT hot AND frame_id - since >= 5 THEN old END
 FROM (SELECT s.*, f.start AS old, CASE WHEN f.start IS NOT NULL THEN coalesce(f.calm, s.frame_id) END AS since FROM f JOIN s ON s.person = f.person AND s.n = f.n + 1))
 SELECT person, done AS start, frame_id AS stop FROM f WHERE done IS NOT NULL UNION ALL SELECT person, start, frame_id FROM f WHERE final AND start IS NOT NULL""")
def o40(spark, d):
    w = walk(spark, d).select("person", "frame_id", (F.coalesce("value", F.lit(0)) % 3).cast("int").alias("level"))
    return ordered.recordings(w.withColumn("level", F.when(F.col("frame_id") % 20 < 3, F.col("level")).otherwise(0)), "person", "frame_id", "level", 5)


@query("o41_alarm_cooldown", f"""WITH RECURSIVE {PRESENCE}, s AS (SELECT *, row_number() OVER (PARTITION BY person % 4 ORDER BY t_us, event_id) AS i, person % 4 AS stream_id FROM presence WHERE level >= 2),
 f(stream_id, i, t_us, event_id) AS (SELECT stream_id, i, t_us, event_id FROM s WHERE i = 1 UNION ALL SELECT f.stream_id, n.i, n.t_us, n.event_id FROM f, LATERAL (SELECT s.i, s.t_us, s.event_id FROM s WHERE s.stream_id = f.stream_id AND s.t_us - f.t_us >= {12 * _HOUR} ORDER BY s.i LIMIT 1) n)
 SELECT stream_id, event_id FROM f""")
def o41(spark, d):
    p = presence(spark, d).where("level >= 2").select((F.col("person") % 4).alias("stream_id"), "event_id", "t_us")
    return alerting.deduplicated(p, ["stream_id"], "t_us", 12 * _HOUR, "event_id").select("stream_id", "event_id")


def _walkers(spark, d):
    """Four walkers a stream, each with the vector of its number counted round the samples."""
    s = samples(spark, d)
    n = s.agg(F.count("*").alias("n"))
    w = walk(spark, d).join(F.broadcast(n)).withColumn("look", F.col("person") % F.col("n"))
    w = w.join(s.select(F.col("vec_id").alias("look"), "feat"), "look")
    return w.select(
        F.expr("person div 4").alias("stream_id"), "frame_id", (F.col("person") % 4).alias("det_id"), "person",
        F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 40).alias("x2"), (F.col("y") + 110).alias("y2"), "feat")


@query("o21_short_term_tracker")
def o21(spark, d):
    t = tracking.track_streams(_walkers(spark, d))
    return t.select("stream_id", "frame_id", "track_id", "det_id", "matched", "since")


@query("e1_reid_of_tracks")
def e1(spark, d):
    """Detections, short-term tracks, identities and re-entry scores as one chain: each walker leaves for 21 frames."""
    there = _walkers(spark, d).where("NOT frame_id BETWEEN 190 AND 210")
    t = tracking.track_streams(there).where("matched")
    t = t.join(there.select("stream_id", "frame_id", "det_id", "person", "feat"), ["stream_id", "frame_id", "det_id"])
    ids = identity.resolve_streams(t.select("stream_id", "frame_id", (F.col("frame_id") / 10.0).alias("ts"), "track_id", "x1", "y1", "x2", "y2", "feat", F.lit(True).alias("admit")))
    told = ids.join(t.select("stream_id", "frame_id", "track_id", "person"), ["stream_id", "frame_id", "track_id"]).where("canonical_id is not null")
    b = metrics.dominant(told.where("frame_id BETWEEN 170 AND 189"), ["person"], "canonical_id", ["frame_id"]).withColumnRenamed("canonical_id", "before")
    a = metrics.dominant(told.where("frame_id BETWEEN 213 AND 235"), ["person"], "canonical_id", ["frame_id"]).withColumnRenamed("canonical_id", "after")
    return metrics.reentry_scores(b.join(a, "person", "left"))


@query("d10_occlusion_trials")
def d10(spark, d):
    """Every walker hidden for 10, 20 and 40 frames in the middle of its longest run, identities resolved anew."""
    w = _walkers(spark, d)
    tracks = w.select("stream_id", "frame_id", (F.col("frame_id") / 10.0).alias("ts"), F.col("det_id").alias("track_id"), "x1", "y1", "x2", "y2", "feat", F.lit(True).alias("admit"))
    return trials.occluded(tracks, [10, 20, 40])


@query("o23_diversity_reservoir", f"""WITH RECURSIVE {SAMPLES}, s AS (SELECT person, vec_id, feat, row_number() OVER (PARTITION BY person ORDER BY vec_id) AS n FROM samples),
 f(person, n, kept) AS (SELECT person, n, [struct_pack(id := vec_id, v := feat)] FROM s WHERE n = 1
 UNION ALL SELECT person, n, CASE WHEN len(kept) < 16 THEN list_append(kept, struct_pack(id := vec_id, v := feat)) WHEN newest >= list_max(crowd) THEN kept
  ELSE list_concat(list_concat(kept[1 : list_position(crowd, list_max(crowd)) - 1], [struct_pack(id := vec_id, v := feat)]), kept[list_position(crowd, list_max(crowd)) + 1 :]) END
 FROM (SELECT s.person, s.n, s.vec_id, s.feat, f.kept, list_max(list_transform(f.kept, lambda a: list_dot_product(a.v, s.feat))) AS newest,
  list_transform(f.kept, lambda a: coalesce(list_max(list_transform(list_filter(f.kept, lambda b: b.id <> a.id), lambda b: list_dot_product(a.v, b.v))), -1.0)) AS crowd FROM f JOIN s ON s.person = f.person AND s.n = f.n + 1))
 SELECT person, unnest(kept).id AS vec_id FROM (SELECT person, kept FROM f QUALIFY row_number() OVER (PARTITION BY person ORDER BY n DESC) = 1)""")
def o23(spark, d):
    return suppression.diverse_reservoir(samples(spark, d), "person", "vec_id", 16)


@query("o27_reid_veto", f"WITH {_PERSON} SELECT q_id, g_pid FROM ps WHERE q_pid = g_pid AND (q_id // 100) % 4 >= 2 AND round(greatest(cen, 0.9 * best), 7) < 0.2")
def o27(spark, d):
    sim = F.round(v.identity_similarity(F.col("cen"), F.col("best")), 7)
    return _person_scores(spark, d).where("q_pid = g_pid").where(gates.vetoed(sim, F.expr("q_id div 100") % 4, 0.2)).select("q_id", "g_pid")


_LAST = f"{PRESENCE}, l AS (SELECT person, max(t_us) AS seen, person % 3 = 0 AS active FROM presence GROUP BY person), n AS (SELECT max(t_us) AS now FROM presence)"


def _last_seen(spark, d):
    return presence(spark, d).groupBy("person").agg(F.max("t_us").alias("seen")).withColumn("active", F.col("person") % 3 == 0)


@query("o32_ttl_expiry", f"WITH {_LAST} SELECT person FROM l, n WHERE NOT active AND now - seen > {4 * _HOUR}")
def o32(spark, d):
    now = presence(spark, d).agg(F.max("t_us").alias("now"))
    return _last_seen(spark, d).crossJoin(F.broadcast(now)).where(gates.expired(F.col("active"), F.col("seen"), F.col("now"), 4 * _HOUR)).select("person")


@query("o33_capacity_eviction", f"WITH {_LAST}, k AS (SELECT greatest(0, count(*) - 10) AS k FROM l) SELECT person FROM (SELECT person, row_number() OVER (ORDER BY seen, person) AS r FROM l WHERE NOT active), k WHERE r <= k")
def o33(spark, d):
    return matching.evicted(_last_seen(spark, d), "person", "seen", "active", 10).select("person")
