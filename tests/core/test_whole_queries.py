"""Registered queries without SQL against naive folds over the whole of their small tables, and operators that chain others."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera.plans  # noqa: F401
from tessera.operators import trials
from tessera.operators.matching import as_of, evicted, pair_scores
from tessera.operators.ordered import ema_per, pose_cache
from tessera.functions.vectors import gradient_hash
from tessera.plans.registry import QUERIES
from tessera.plans.views import candidates, people


def over(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    area = [max(1.0, (x[2] - x[0]) * (x[3] - x[1])) for x in (a, b)]
    return inter / (sum(area) - inter) if inter > 0 else 0.0


def naive_seen(rows):
    """seen by (frame, candidate): cycles of a stream are every fourth frame."""
    out = {}
    for stream in {f % 4 for f, *_ in rows}:
        cycles = {}
        for f, c, label, *b in rows:
            if f % 4 == stream:
                cycles.setdefault(f // 4, []).append((c, label, b))
        tracks = []
        for n in range(min(cycles), max(cycles) + 1):
            now = sorted(cycles.get(n, []))
            free = list(now)
            for t in tracks:
                hit = next((x for x in free if x[1] == t["label"] and over(t["box"], x[2]) >= 0.25), None)
                if hit:
                    free.remove(hit)
                    t.update(box=hit[2], seen=t["seen"] + 1, missed=0)
                else:
                    t["missed"] += 1
            tracks += [{"label": x[1], "box": x[2], "seen": 1, "missed": 0} for x in free]
            tracks = [t for t in tracks if t["missed"] < 2]
            for c, label, b in now:
                out[n * 4 + stream, c] = next((t["seen"] for t in tracks if t["label"] == label and over(t["box"], b) >= 0.25), 0)
    return out


def test_persistence_and_verdicts_are_those_of_a_naive_fold(spark, data):
    rows = [tuple(r) for r in candidates(spark, data).select("frame_id", "cand_id", "label", "x1", "y1", "x2", "y2").collect()]
    conf = {(r["frame_id"], r["cand_id"]): (r["label"], r["conf"]) for r in candidates(spark, data).collect()}
    seen = naive_seen(rows)
    got = {(r["frame_id"], r["cand_id"]): r["seen"] for r in QUERIES["o35_detection_persistence"](spark, data).collect()}
    assert got == seen and max(seen.values()) > 1
    boxes = {}
    for r in people(spark, data).collect():
        boxes.setdefault(r["frame_id"], []).append([r["x1"], r["y1"], r["x2"], r["y2"]])

    def near(b, q):
        w, h = min(b[2], q[2]) - max(b[0], q[0]), min(b[3], q[3]) - max(b[1], q[1])
        return over(b, q) >= 0.2 or max(w, 0) * max(h, 0) / max(1.0, (b[2] - b[0]) * (b[3] - b[1])) >= 0.3

    gate, want = {"guns": 0.29, "knife": 0.23, "long_gun": 0.56}, {}
    for f, c, label, *b in rows:
        v = conf[f, c][1]
        want[f, c] = "conf" if v < gate[label] else "transient" if seen[f, c] < 2 and v < 0.85 else "confirmed" if any(near(b, q) for q in boxes.get(f, [])) else "no person"
    got = {(r["frame_id"], r["cand_id"]): r["verdict"] for r in QUERIES["o36_verification"](spark, data).collect()}
    assert got == want
    tally = {(r["label"], r["verdict"]): r["n"] for r in QUERIES["a26_verifier_counters"](spark, data).collect()}
    assert sum(tally.values()) == len(want) and all(n == sum(v == k[1] and conf[i][0] == k[0] for i, v in want.items()) for k, n in tally.items())


def test_identities_hold_every_detection_once(spark, data):
    got = QUERIES["o26_identity_resolution"](spark, data).collect()
    one = {(r["frame_id"], r["track_id"]) for r in people(spark, data).collect()}
    assert {(r["frame_id"], r["track_id"]) for r in got} == one and len(got) == len(one)
    given = [(r["frame_id"], r["canonical_id"]) for r in got if r["canonical_id"] is not None]
    assert len(given) == len(set(given))


def test_tracks_hold_their_walkers(spark, data):
    got = QUERIES["o21_short_term_tracker"](spark, data).toPandas()
    assert not got.duplicated(["stream_id", "frame_id", "track_id"]).any()
    assert not got[got.matched].duplicated(["stream_id", "frame_id", "det_id"]).any() and got[got.matched].since.eq(0).all() and got[~got.matched].since.ge(1).all()


def test_hidden_people_are_known_again_unless_they_changed(spark):
    look = np.eye(6)
    rows = []
    for f in range(80):
        for t in range(3):
            feat = look[t + 3] if t == 2 and f >= 40 else look[t]
            rows.append((1, f, f / 10, t, 100.0 * t, 50.0, 100.0 * t + 60, 250.0, feat.tolist(), True))
    df = spark.createDataFrame(rows, "stream_id long, frame_id long, ts double, track_id long, x1 double, y1 double, x2 double, y2 double, feat array<double>, admit boolean")
    got = {(r["track_id"], r["n_frames"]): (r["retained"], r["reacquired"]) for r in trials.occluded(df, [10, 30, 70]).collect()}
    assert got == {(t, n): (t < 2, True) for t in range(3) for n in (10, 30)}


@pytest.mark.parametrize("side", ["before", "after"])
def test_as_of_is_the_naive_scan(spark, side):
    r = np.random.default_rng(2)
    ev = [(i, int(r.integers(2)), int(r.integers(300))) for i in range(200)]
    tl = [(int(r.integers(2)), int(f), None if r.random() < 0.2 else 7) for f in r.integers(0, 300, 60)] * 2
    e, t = spark.createDataFrame(ev, "e long, clip long, at long"), spark.createDataFrame(tl, "clip long, frame_id long, ident long")
    got = {x["e"]: x["frame"] for x in as_of(e, t, "e", "clip", "at", 25, side).collect()}
    want = {}
    for i, c, at in ev:
        near = [f for k, f, who in tl if k == c and who is not None and (0 <= at - f <= 25 if side == "before" else 0 <= f - at <= 25)]
        if near:
            want[i] = max(near) if side == "before" else min(near)
    assert got == want
    assert as_of(e.where("false"), t, "e", "clip", "at", 25, side).count() == 0 and as_of(e, t.where("false"), "e", "clip", "at", 25, side).count() == 0


@pytest.mark.parametrize("capacity,cells", [(0, 8), (5, 8), (40, 8), (40, 1), (500, 8)])
def test_evicted_are_the_longest_absent(spark, capacity, cells):
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(1000)), bool(r.random() < 0.3)) for i in range(120)]
    df = spark.createDataFrame(rows, "who long, seen long, active boolean")
    want = [w for _, w in sorted((s, w) for w, s, a in rows if not a)][: max(0, len(rows) - capacity)]
    assert sorted(x["who"] for x in evicted(df, "who", "seen", "active", capacity, cells).collect()) == sorted(want)


def test_moving_averages_of_long_and_short_keys(spark):
    r = np.random.default_rng(6)
    rows = [(k, i, float(r.normal()) if r.random() < 0.9 else None) for k, n in (("long", 900), ("one", 1), ("two", 2)) for i in range(n)]
    got = {x["k"]: x["e"] for x in ema_per(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], ["i"], "v", "e").collect()}
    for k in ("long", "one", "two"):
        s = None
        for v in [v for q, _, v in rows if q == k and v is not None]:
            s = v if s is None else 0.9 * s + 0.1 * v
        assert (k not in got) if s is None else abs(got[k] - s) < 1e-12


def test_pose_cache_is_the_naive_fold(spark):
    r = np.random.default_rng(7)
    tracks, poses, want = [], [], {}
    for s in range(3):
        cache, src = {}, None
        for n in range(1, 60):
            here = sorted(r.choice(4, size=int(r.integers(0, 4)), replace=False).tolist())
            found = {t: f"{s}-{n}-{t}" for t in here if r.random() < 0.5}
            tracks += [(s, 10 * n, t) for t in here] or [(s, 10 * n, None)]
            poses += [(s, 10 * n, t, x) for t, x in found.items()]
            if not here:
                cache = {}
                continue
            if n % 4 == 1 or not cache:
                cache, src = found, n
            want |= {(s, 10 * n, t): (cache.get(t), t in cache and src < n) for t in here}
    got = pose_cache(spark.createDataFrame(tracks, "s long, f long, t long"), spark.createDataFrame(poses, "s long, f long, t long, pose string"), "s", "f", "t", "pose")
    assert {(x["s"], x["f"], x["t"]): (x["pose"], x["stale"]) for x in got.collect()} == want


@pytest.mark.parametrize("block", [3, 1024])
def test_scores_in_blocks_are_the_products(spark, block):
    r = np.random.default_rng(8)
    q, g = r.normal(size=(7, 4)), r.normal(size=(20, 4))
    qs = spark.createDataFrame([(i, i % 3, 1, v.tolist()) for i, v in enumerate(q)] + [(99, 1, 1, None)], "q_id long, q_pid long, q_cam long, feat array<double>")
    gs = spark.createDataFrame([(i, i % 4 if i else None, 2, v.tolist()) for i, v in enumerate(g)], "g_id long, g_pid long, g_cam long, feat array<double>")
    got = {(x["q_id"], x["g_id"]): x["sim"] for x in pair_scores(qs, gs, block).collect()}
    assert got == {(i, j): round(float(q[i] @ g[j]), 6) for i in range(7) for j in range(20)}
    best = {(x["q_id"], x["g_pid"]): x["sim"] for x in pair_scores(qs, gs, block, best=True).collect()}
    assert best == {(i, p): max(round(float(q[i] @ g[j]), 6) for j in range(20) if (j % 4 if j else -1) == p) for i in range(7) for p in (-1, 0, 1, 2, 3)}
    assert pair_scores(qs.where("false"), gs).count() == 0 and pair_scores(qs, gs.where("false")).count() == 0


def test_gradient_hash(spark):
    r = np.random.default_rng(9)
    rows = [(i, r.integers(0, 256, 72).tolist()) for i in range(20)] + [(90, [1] * 71), (91, None), (92, [None] + [1] * 71)]
    got = {x["i"]: x["h"] for x in spark.createDataFrame(rows, "i long, px array<int>").select("i", gradient_hash(F.col("px")).alias("h")).collect()}
    for i, px in rows[:20]:
        bits = "".join("1" if px[9 * y + x + 1] > px[9 * y + x] else "0" for y in range(8) for x in range(8))
        assert got[i] == (int(bits, 2) ^ (1 << 63)) - (1 << 63)
    assert got[90] is None and got[91] is None and got[92] is None


@pytest.mark.parametrize("cell", [1, 7, 1000])
def test_previous_rows_and_visits_in_cells_are_those_of_whole_keys(spark, cell):
    from pyspark.sql import Window

    from tessera.operators.matching import exit_return_pairs
    from tessera.operators.ordered import escalations, visits, with_previous

    r = np.random.default_rng(10)
    rows = [(None if k == 2 else int(k), int(t), i, [None, "exit", "return"][int(r.integers(3))], int(r.integers(4))) for i, (k, t) in enumerate(zip(r.integers(0, 3, 300), r.integers(0, 200, 300)))]
    df = spark.createDataFrame(rows, "who long, at long, id long, mark string, level int")
    w = Window.partitionBy("who").orderBy("at", "id")
    want = {x["id"]: (x["m"], x["v"]) for x in df.withColumn("m", F.lag("mark").over(w)).withColumn("v", F.sum((F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(99)) > 3).cast("int")).over(w)).collect()}
    assert {x["id"]: x["prev_mark"] for x in with_previous(df, ["who"], ["at", "id"], ["mark"], cell).collect()} == {i: m for i, (m, _) in want.items()}
    assert {x["id"]: x["visit"] for x in visits(df, "who", "at", 3, "id", cell).collect()} == {i: v for i, (_, v) in want.items()}
    for fn in (lambda c: exit_return_pairs(df, "who", ["at", "id"], c), lambda c: escalations(df, ["who"], ["at", "id"], "level", 2, c)):
        assert sorted(map(str, fn(cell).collect())) == sorted(map(str, fn(10**9).collect()))
    assert with_previous(df.where("false"), ["who"], ["at"], ["mark"], cell).count() == 0


def test_likeness_of_pairs_without_pairs(spark):
    from tessera.operators.matching import same_identity_likeness

    r = np.random.default_rng(11)
    rows = [(int(r.integers(3)), int(r.integers(80)), r.normal(size=3)) for _ in range(60)] + [(9, 1, np.ones(3))]
    want = {}
    for a, f, v in rows:
        for b, g, u in rows:
            if a == b and f < g:
                n, t = want.get((a, g - f >= 30), (0, 0.0))
                want[a, g - f >= 30] = n + 1, t + float(v @ u)
    df = spark.createDataFrame([(a, f, v.tolist()) for a, f, v in rows] + [(None, 1, [1.0] * 3), (9, None, [1.0] * 3)], "who long, at long, feat array<double>")
    got = {(x["who"], x["is_long"]): (x["n"], x["total"]) for x in same_identity_likeness(df, "who", "at").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
