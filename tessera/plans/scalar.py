"""Queries of the geometry, vector and gate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import vectors as v
from tessera.functions.geometry import Box
from tessera.operators import gates
from tessera.operators.ordered import ema_per
from tessera.plans.registry import query
from tessera.plans.views import CANDIDATES, PEOPLE, POSED, PRESENCE, SAMPLES, candidates, people, posed, presence, samples

_KEY = ["frame_id", "det_id"]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a = people(spark, d).select("frame_id", F.col("det_id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = people(spark, d).select("frame_id", F.col("det_id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    return a.join(b, "frame_id").where("a_id < b_id")


_W = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
_IOU = f"CASE WHEN {_W} > 0 THEN {_W} / ({_AREA.format('a')} + {_AREA.format('b')} - {_W}) ELSE 0 END"
_IOU_C = f"CASE WHEN {_W} > 0 THEN {_W} / (greatest(1, {_AREA.format('a')}) + greatest(1, {_AREA.format('b')}) - {_W}) ELSE 0 END"
_PAIR = "FROM people a JOIN people b ON a.frame_id = b.frame_id AND a.det_id < b.det_id"


@query("f1_iou", f"WITH {PEOPLE} SELECT a.frame_id, a.det_id AS a_id, b.det_id AS b_id, round({_IOU}, 6) AS iou {_PAIR}")
def f1(spark, d):
    return _pairs(spark, d).select("frame_id", "a_id", "b_id", F.round(g.iou(Box.of("a_"), Box.of("b_")), 6).alias("iou"))


@query("f2_iou_clamped", f"WITH {PEOPLE} SELECT a.frame_id, a.det_id AS a_id, b.det_id AS b_id, round({_IOU_C}, 6) AS iou {_PAIR}")
def f2(spark, d):
    return _pairs(spark, d).select("frame_id", "a_id", "b_id", F.round(g.iou_clamped(Box.of("a_"), Box.of("b_")), 6).alias("iou"))


@query("f3_iou_matrix", f"WITH {PEOPLE} SELECT a.frame_id, a.det_id AS row_id, b.det_id AS col_id, round({_IOU}, 6) AS iou FROM people a JOIN people b ON a.frame_id = b.frame_id")
def f3(spark, d):
    up = _pairs(spark, d).select("frame_id", "a_id", "b_id", F.round(g.iou(Box.of("a_"), Box.of("b_")), 6).alias("iou"))
    one = people(spark, d).select("frame_id", F.col("det_id").alias("row_id"), F.col("det_id").alias("col_id"), F.lit(1.0).alias("iou"))
    both = up.select("frame_id", F.explode(F.array(F.struct("a_id", "b_id"), F.struct(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id")))).alias("p"), "iou")
    return both.select("frame_id", F.col("p.a_id").alias("row_id"), F.col("p.b_id").alias("col_id"), "iou").unionByName(one)


@query("f4_containment", f"WITH {PEOPLE} SELECT a.frame_id, a.det_id AS a_id, b.det_id AS b_id, round({_W} / greatest(1, {_AREA.format('a')}), 6) AS share {_PAIR}")
def f4(spark, d):
    return _pairs(spark, d).select("frame_id", "a_id", "b_id", F.round(g.containment(Box.of("a_"), Box.of("b_")), 6).alias("share"))


@query("f5_centre_and_foot", f"WITH {PEOPLE} SELECT frame_id, det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x1 + x2) / 2 AS foot_x, y2 AS foot_y FROM people")
def f5(spark, d):
    b = Box.of()
    (cx, cy), (fx, fy) = g.centre(b), g.foot_point(b)
    return people(spark, d).select(*_KEY, cx.alias("cx"), cy.alias("cy"), fx.alias("foot_x"), fy.alias("foot_y"))


@query("f6_distance", f"WITH {PEOPLE} SELECT a.frame_id, a.det_id AS a_id, b.det_id AS b_id, round(sqrt(power((a.x1 + a.x2 - b.x1 - b.x2) / 2, 2) + power((a.y1 + a.y2 - b.y1 - b.y2) / 2, 2)), 6) AS dist {_PAIR}")
def f6(spark, d):
    (ax, ay), (bx, by) = g.centre(Box.of("a_")), g.centre(Box.of("b_"))
    return _pairs(spark, d).select("frame_id", "a_id", "b_id", F.round(g.distance(ax, ay, bx, by), 6).alias("dist"))


@query("f7_area", f"WITH {PEOPLE} SELECT frame_id, det_id, greatest(1, (x2 - x1) * (y2 - y1)) AS area FROM people")
def f7(spark, d):
    return people(spark, d).select(*_KEY, g.clamped_area(Box.of()).alias("area"))


@query("f8_l2_normalise", f"WITH {SAMPLES}, n AS (SELECT vec_id, feat, sqrt(list_dot_product(feat, feat)) AS n FROM samples) SELECT vec_id, CAST(i - 1 AS INT) AS dim, round(feat[i] / n, 6) + 0 AS x FROM n, range(1, 65) t(i)")
def f8(spark, d):
    u = v.unit(F.transform("feat", lambda x: x * 3))
    return samples(spark, d).select("vec_id", F.posexplode(u).alias("dim", "x")).select("vec_id", "dim", (F.round("x", 6) + 0).alias("x"))


_CROSS = "samples q JOIN samples t ON q.frame_id = t.frame_id AND q.vec_id < t.vec_id"


def _sample_pairs(spark, d):
    q = samples(spark, d).select("frame_id", F.col("vec_id").alias("q_id"), F.col("feat").alias("q"), F.col("person").alias("q_person"))
    t = samples(spark, d).select("frame_id", F.col("vec_id").alias("t_id"), F.col("feat").alias("t"), F.col("person").alias("t_person"))
    return q.join(t, "frame_id").where("q_id < t_id")


@query("f9_cosine", f"WITH {SAMPLES} SELECT q.vec_id AS q_id, t.vec_id AS t_id, round(list_dot_product(q.feat, t.feat), 6) AS sim FROM {_CROSS}")
def f9(spark, d):
    return _sample_pairs(spark, d).select("q_id", "t_id", F.round(v.dot(F.col("q"), F.col("t")), 6).alias("sim"))


_R = "[q.feat[1], q.feat[2], q.feat[3], q.feat[4]]"
_T = "[t.feat[1], t.feat[2], t.feat[3], t.feat[4]]"


@query("f10_ratio_similarity", f"WITH {SAMPLES} SELECT q.vec_id AS q_id, t.vec_id AS t_id, CASE WHEN q.vec_id % 7 = 0 THEN NULL ELSE round(list_dot_product({_R}, {_T}) / sqrt(list_dot_product({_R}, {_R}) * list_dot_product({_T}, {_T})), 6) END AS sim FROM {_CROSS}")
def f10(spark, d):
    q = F.when(F.col("q_id") % 7 != 0, F.slice("q", 1, 4))
    return _sample_pairs(spark, d).select("q_id", "t_id", F.round(v.cosine(q, F.slice("t", 1, 4)), 6).alias("sim"))


_HYP = "sqrt(power({0}, 2) + power({1}, 2))"
_SH, _HP = _HYP.format("px11 - px12", "py11 - py12"), _HYP.format("px23 - px24", "py23 - py24")
_TO = _HYP.format("(px11 + px12) / 2 - (px23 + px24) / 2", "(py11 + py12) / 2 - (py23 + py24) / 2")
_L1, _L2, _WR = _HYP.format("px23 - px27", "py23 - py27"), _HYP.format("px24 - px28", "py24 - py28"), _HYP.format("px15 - px16", "py15 - py16")


@query("f11_body_ratios", f"""WITH {POSED}, r AS (SELECT frame_id, det_id, [{_SH} / nullif({_TO}, 0), {_HP} / nullif({_SH}, 0), list_avg(list_filter([{_L1}, {_L2}], lambda x: x IS NOT NULL)) / nullif({_TO}, 0), {_WR} / nullif({_SH}, 0)] AS r
 FROM posed WHERE {_SH} >= 1e-3 AND {_TO} >= 1e-3 AND {_HP} IS NOT NULL) SELECT frame_id, det_id, round(r[1], 6) AS r1, round(r[2], 6) AS r2, round(coalesce(r[3], list_avg(list_filter(r, lambda x: x IS NOT NULL))), 6) AS r3,
 round(coalesce(r[4], list_avg(list_filter(r, lambda x: x IS NOT NULL))), 6) AS r4 FROM r""")
def f11(spark, d):
    r = posed(spark, d).select(*_KEY, g.body_ratios(F.col("kp")).alias("r")).where("r is not null")
    return r.select(*_KEY, *[F.round(F.col("r")[i], 6).alias(f"r{i + 1}") for i in range(4)])


_TP = "list_avg(list_filter([{0}11, {0}12, {0}23, {0}24], lambda x: x IS NOT NULL))"


@query("f12_torso_centre", f"WITH {POSED} SELECT frame_id, det_id, round({_TP.format('px')}, 6) AS x, round({_TP.format('py')}, 6) AS y FROM posed")
def f12(spark, d):
    c = posed(spark, d).select(*_KEY, g.torso_centre(F.col("kp")).alias("c"))
    return c.select(*_KEY, F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


_IDX = (11, 12, 15, 16, 23, 24, 27, 28)
_XS, _YS = ", ".join(f"px{i}" for i in _IDX), ", ".join(f"py{i}" for i in _IDX)


@query("f13_keypoint_hull", f"WITH {POSED} SELECT frame_id, det_id, CASE WHEN kp_count >= 4 THEN round(least({_XS}), 6) END AS x1, CASE WHEN kp_count >= 4 THEN round(least({_YS}), 6) END AS y1, CASE WHEN kp_count >= 4 THEN round(greatest({_XS}), 6) END AS x2, CASE WHEN kp_count >= 4 THEN round(greatest({_YS}), 6) END AS y2 FROM posed")
def f13(spark, d):
    h = posed(spark, d).select(*_KEY, g.hull(F.col("kp")).alias("h"))
    return h.select(*_KEY, *[F.round(f"h.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("f14_refine_box", f"""WITH {POSED}, r AS (SELECT *, 0.7 * x1 + 0.3 * least({_XS}) AS a, 0.7 * x2 + 0.3 * greatest({_XS}) AS b, 0.7 * y2 + 0.3 * greatest({_YS}) AS c FROM posed),
 o AS (SELECT *, coalesce(kp_count >= 4 AND b - a >= 4 AND c - y1 >= 4, false) AS ok FROM r)
 SELECT frame_id, det_id, round(CASE WHEN ok THEN a ELSE x1 END, 6) AS x1, y1, round(CASE WHEN ok THEN b ELSE x2 END, 6) AS x2, round(CASE WHEN ok THEN c ELSE y2 END, 6) AS y2 FROM o""")
def f14(spark, d):
    r = posed(spark, d).select(*_KEY, g.refined(Box.of(), F.col("kp")).alias("r"))
    return r.select(*_KEY, *[F.round(f"r.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("f20_hamming", "WITH p AS (SELECT DISTINCT image_id, hash, image_id // 16 AS cell FROM build_dataset WHERE hash IS NOT NULL) SELECT a.image_id AS a_id, b.image_id AS b_id, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS bits FROM p a JOIN p b ON a.cell = b.cell AND a.image_id < b.image_id")
def f20(spark, d):
    p = spark.read.parquet(f"{d}/build_dataset.parquet").select("image_id", "hash", F.expr("image_id div 16").alias("cell")).where("hash is not null").distinct()
    a, b = p.select("cell", F.col("image_id").alias("a_id"), F.col("hash").alias("ah")), p.select("cell", F.col("image_id").alias("b_id"), F.col("hash").alias("bh"))
    return a.join(b, "cell").where("a_id < b_id").select("a_id", "b_id", v.hamming(F.col("ah"), F.col("bh")).alias("bits"))


@query("f19_gradient_hash", f"""WITH {SAMPLES}, g AS (SELECT vec_id, list_transform(range(0, 72), lambda i: CAST(round((feat[i % 64 + 1] + 1) * 127) AS INT)) AS px FROM samples),
 h AS (SELECT vec_id, CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN px[i + i // 8 + 2] > px[i + i // 8 + 1] THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INT) ELSE 0 END)) AS HUGEINT) AS h FROM g)
 SELECT vec_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash FROM h""")
def f19(spark, d):
    """Vectors stand for grey values."""
    px = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.round((F.get("feat", i % 64) + 1) * 127).cast("int"))
    return samples(spark, d).select("vec_id", v.gradient_hash(px).alias("hash"))


@query("f21_ema", f"WITH {PRESENCE}, l AS (SELECT person, list(value ORDER BY t_us, event_id) AS vs FROM presence GROUP BY person) SELECT person, round(list_reduce(vs, lambda s, x: 0.9 * s + 0.1 * x), 6) AS ema FROM l")
def f21(spark, d):
    return ema_per(presence(spark, d), ["person"], ["t_us", "event_id"], "value", "ema").withColumn("ema", F.round("ema", 6))


@query("f22_ema_vector", f"""WITH {SAMPLES}, c AS (SELECT person, i, list(feat[i] ORDER BY vec_id) AS vs FROM samples, range(1, 65) t(i) GROUP BY person, i)
 SELECT person, CAST(i - 1 AS INT) AS dim, round(list_reduce(vs, lambda s, x: 0.9 * s + 0.1 * x), 6) + 0 AS ema FROM c""")
def f22(spark, d):
    long = samples(spark, d).select("person", "vec_id", F.posexplode("feat").alias("dim", "x"))
    return ema_per(long, ["person", "dim"], ["vec_id"], "x", "ema").withColumn("ema", F.round("ema", 6) + 0)


@query("f23_rounding", f"WITH {SAMPLES} SELECT vec_id, CAST(i - 1 AS INT) AS dim, round(feat[i], 4) + 0 AS dp4, round(feat[i], 3) + 0 AS dp3 FROM samples, range(1, 65) t(i)")
def f23(spark, d):
    return samples(spark, d).select("vec_id", F.posexplode("feat").alias("dim", "x")).select("vec_id", "dim", (F.round("x", 4) + 0).alias("dp4"), (F.round("x", 3) + 0).alias("dp3"))


@query("f24_stem_keys", r"""SELECT DISTINCT image_id, src || ':' || regexp_replace(s, '\.rf\.[0-9a-f]+$', '') AS build_key, nullif(regexp_extract(lower(regexp_replace(s, '_jpg\.rf\.[0-9a-f]+$', '')), '^(frame-[0-9]+)', 1), '') AS clip_key
 FROM (SELECT image_id, src, regexp_replace(regexp_extract(img, '([^/]*)$', 1), '\.[^.]*$', '') AS s FROM build_dataset)""")
def f24(spark, d):
    from tessera.operators.curation import build_key, clip_key, stem

    s = stem(F.col("img"))
    return spark.read.parquet(f"{d}/build_dataset.parquet").select("image_id", build_key(F.col("src"), s).alias("build_key"), clip_key(s, r"^(frame-[0-9]+)").alias("clip_key")).distinct()


@query("g1_person_box", f"WITH {PEOPLE} SELECT frame_id, det_id FROM people WHERE conf >= 0.3 AND x2 - x1 > 1 AND y2 - y1 > 1 AND k % 3 = 0")
def p1(spark, d):
    return people(spark, d).where(gates.person_box(Box.of(), F.col("k") % 3, F.col("conf"))).select(*_KEY)


@query("g2_weapon_shape", f"WITH {CANDIDATES} SELECT frame_id, cand_id FROM cand WHERE x2 - x1 >= 20 AND y2 - y1 >= 20 AND (label <> 'knife' OR greatest(x2 - x1, y2 - y1) / greatest(least(x2 - x1, y2 - y1), 1) >= 1.5)")
def p2(spark, d):
    return candidates(spark, d).where(gates.weapon_shape(Box.of(), F.col("label"))).select("frame_id", "cand_id")


@query("g3_embeddable", f"WITH {PEOPLE} SELECT frame_id, det_id, least(640, CAST(x2 AS INT)) - greatest(0, CAST(x1 AS INT)) >= 8 AND least(480, CAST(y2 AS INT)) - greatest(0, CAST(y1 AS INT)) >= 16 AS ok FROM people")
def p3(spark, d):
    return people(spark, d).select(*_KEY, gates.embeddable(Box.of()).alias("ok"))


@query("g4_admission", f"""WITH {POSED} SELECT frame_id, det_id, CASE WHEN k % 11 = 0 THEN 'invalid_embedding' WHEN NOT matched THEN 'not_matched' WHEN conf < 0.5 THEN 'low_confidence' WHEN y2 - y1 < 64 THEN 'crop_too_small'
 WHEN x1 <= 5 OR x2 >= 635 THEN 'side_truncated' WHEN (y1 <= 5 OR y2 >= 475) AND (y2 - y1) / greatest(x2 - x1, 1) < 1.2 THEN 'clipped_and_implausible_shape' WHEN kp_count < 5 THEN 'insufficient_keypoints' ELSE 'ok' END AS reason FROM posed""")
def p4(spark, d):
    reason = gates.admission_reason(Box.of(), F.col("conf"), F.col("matched"), g.visible_count(F.col("kp")), F.col("k") % 11 != 0)
    return posed(spark, d).select(*_KEY, reason.alias("reason"))


@query("g5_touches_border", f"WITH {PEOPLE} SELECT frame_id, det_id FROM people WHERE x1 <= 15 OR y1 <= 15 OR x2 >= 625 OR y2 >= 465")
def p5(spark, d):
    return people(spark, d).where(gates.touches_border(Box.of())).select(*_KEY)


@query("g6_render_decision", f"""WITH {POSED}, t AS (SELECT *, k % 4 AS tsu, x1 <= 15 OR y1 <= 15 OR x2 >= 625 OR y2 >= 465 AS edge FROM posed)
 SELECT frame_id, det_id, CASE WHEN matched THEN true WHEN tsu > 2 OR edge THEN false WHEN kp_count IS NULL THEN tsu <= 1 ELSE kp_count >= 5 END AS render, NOT (matched OR tsu > 2 OR edge) AS coasting FROM t""")
def p6(spark, d):
    r = gates.render_decision(F.col("matched"), F.col("k") % 4, gates.touches_border(Box.of()), g.visible_count(F.col("kp")))
    return posed(spark, d).select(*_KEY, r.alias("r")).select(*_KEY, "r.render", "r.coasting")


@query("g7_keypoint_count", f"WITH {POSED} SELECT frame_id, det_id, kp_count FROM posed")
def p7(spark, d):
    return posed(spark, d).select(*_KEY, g.visible_count(F.col("kp")).alias("kp_count"))


@query("g8_class_conf_gate", f"WITH {CANDIDATES} SELECT frame_id, cand_id FROM cand WHERE conf >= CASE label WHEN 'guns' THEN 0.29 WHEN 'knife' THEN 0.23 WHEN 'long_gun' THEN 0.56 ELSE 0.5 END")
def p8(spark, d):
    return candidates(spark, d).where(gates.class_conf_ok(F.col("label"), F.col("conf"))).select("frame_id", "cand_id")


@query("g9_arm_raised", f"WITH {POSED} SELECT frame_id, det_id, coalesce(py15 < py11, false) OR coalesce(py16 < py12, false) AS raised FROM posed")
def p9(spark, d):
    return posed(spark, d).select(*_KEY, gates.arm_raised(F.col("kp")).alias("raised"))


@query("g10_track_colour", f"WITH {PEOPLE} SELECT frame_id, det_id, CASE WHEN k % 10 > 6 THEN 'level_' || (k % 10 - 6) WHEN k % 5 = 0 THEN 'provisional' WHEN NOT matched THEN 'coasting' ELSE 'tracked' END AS colour FROM people")
def p10(spark, d):
    return people(spark, d).select(*_KEY, gates.track_colour(F.col("k") % 5 == 0, ~F.col("matched"), F.greatest(F.col("k") % 10 - 6, F.lit(0))).alias("colour"))


_CW = "sqrt(power((c.x1 + c.x2) / 2 - p.px{0}, 2) + power((c.y1 + c.y2) / 2 - p.py{0}, 2)) <= 60"


@query("g11_near_wrist", f"WITH {POSED}, {CANDIDATES} SELECT c.frame_id, c.cand_id, p.det_id FROM cand c JOIN posed p ON c.frame_id = p.frame_id AND (coalesce({_CW.format(15)}, false) OR coalesce({_CW.format(16)}, false))")
def p11(spark, d):
    p = posed(spark, d).select("frame_id", "det_id", "kp")
    return candidates(spark, d).join(p, "frame_id").where(gates.near_wrist(Box.of(), F.col("kp"))).select("frame_id", "cand_id", "det_id")


@query("g12_resolved_only", f"WITH {PEOPLE} SELECT frame_id, count(*) AS n FROM people WHERE k % 9 <> 0 GROUP BY frame_id")
def p12(spark, d):
    return people(spark, d).withColumn("canonical_id", F.when(F.col("k") % 9 != 0, F.col("track_id"))).where("canonical_id is not null").groupBy("frame_id").agg(F.count("*").alias("n"))


@query("g13_visible_and_known", f"WITH {PEOPLE} SELECT frame_id, det_id FROM people WHERE conf >= 0.25 AND k % 9 <> 0")
def p13(spark, d):
    return people(spark, d).withColumn("id", F.when(F.col("k") % 9 != 0, F.col("track_id"))).where((F.col("conf") >= 0.25) & F.col("id").isNotNull()).select(*_KEY)


@query("g14_invalid_masked", f"WITH {SAMPLES} SELECT q.vec_id AS q_id, t.vec_id AS t_id, CASE WHEN q.vec_id % 6 = 0 THEN 0 ELSE round(list_dot_product(q.feat, t.feat), 6) END AS sim FROM {_CROSS}")
def p14(spark, d):
    return _sample_pairs(spark, d).select("q_id", "t_id", F.round(v.masked_similarity(F.col("q"), F.col("t"), F.col("q_id") % 6 != 0), 6).alias("sim"))


@query("g17_time_holdout", f"WITH {PRESENCE} SELECT person, event_id FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY person) AS n FROM presence) WHERE i >= floor(n * 0.7)")
def p17(spark, d):
    return gates.time_holdout(presence(spark, d).select("person", "event_id"), "person", "event_id").select("person", "event_id")


@query("g18_under_delivery", f"WITH {PRESENCE} SELECT person FROM presence GROUP BY person HAVING coalesce(count(*) / nullif((max(t_us) - min(t_us)) / 1e6, 0), 0) < 0.00006 * 0.5")
def p18(spark, d):
    per = presence(spark, d).groupBy("person").agg(F.count("*").alias("n"), ((F.max("t_us") - F.min("t_us")) / F.lit(1e6)).alias("s"))
    return per.where(gates.under_delivered(F.col("n"), F.col("s"), F.lit(0.00006))).select("person")
