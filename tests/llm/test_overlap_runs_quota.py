import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import keys, overlap, quota, runs


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_segment_join_is_brute_force(spark, k):
    r = random.Random(k)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(0, 9)))
    e, t = [("s", word()) for _ in range(60)] + [(None, "a"), ("s", None)], [(r.choice("st"), word()) for _ in range(80)]
    schema = "block string, text string"
    got = {tuple(x) for x in overlap.segment_join(spark.createDataFrame(e, schema), spark.createDataFrame(t, schema), k).collect()}
    want = {("s", a, b) for x, a in e if x and a is not None for y, b in t if y == "s" and lev(a, b) <= k}
    assert got == want


@pytest.mark.parametrize("crowded", [4096, 0])
def test_bit_join_is_brute_force(spark, crowded):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    e = [signed(x) for x in base] + [0, -1]
    t = [signed(flip(r.choice(base), r.randint(0, 9))) for _ in range(300)] + [None, 1, 63, 127]
    got = {tuple(x) for x in overlap.bit_segment_join(spark.createDataFrame([(x,) for x in e], "bits long"), spark.createDataFrame([(x,) for x in t], "bits long"), crowded=crowded).collect()}
    want = {(a, b) for a in e for b in t if b is not None and bin((a ^ b) & (1 << 64) - 1).count("1") <= 6}
    assert got == want and any(a != b for a, b in want)


def test_cross_split_pairs_once(spark):
    rows = [(1, "train", 5, "s", "x"), (1, "train", 5, "s", "x"), (2, "val", 5, "s", "x"), (3, "test", None, None, "x"), (4, None, 5, "s", "x"), (5, "val", None, "s", "x"), (6, "train", None, "s", "y")]
    df = spark.createDataFrame(rows, "id long, split string, bits long, block string, name string").withColumn("eval_id", F.lit(0))
    pairs = overlap.cross_split(df)
    assert sorted(tuple(x) for x in pairs.collect()) == [(1, 2), (1, 5)]
    rep = {(x["split"], x["source"]): (x["n_pairs"], x["n_records"]) for x in overlap.overlap_report(df).collect()}
    assert rep == {("train", "s"): (2, 1), ("val", "s"): (2, 2)}
    assert overlap.cross_split(df.where("false")).count() == 0 and overlap.linked(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_links_are_those_of_the_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["train", "val", "test", None]), r.choice([None, 0, 1, 3, 1 << 40, -1]), r.choice(["s", "t", None]), r.choice(["x", "y", "xy", None])) for i in range(80)]
    df = spark.createDataFrame(rows + rows[:9], "id long, split string, bits long, block string, name string").withColumn("n_links", F.lit(0))
    want = {}
    for x in overlap.cross_split(df).collect():
        for i in x:
            want[i] = want.get(i, 0) + 1
    got = overlap.linked(df).collect()
    assert {x["id"]: x["n_links"] for x in got if x["n_links"]} == want and len(got) == sum(x[1] is not None for x in rows)
    side = lambda x: (x[1] == "train", *x[2:])
    assert all(x["class_id"] == min(y[0] for y in rows if y[1] and side(y) == side(rows[x["id"]])) for x in got)


def test_near_names(spark):
    rows = [(1, "train", 1, "s", "gate_one"), (2, "val", 2, "s", "gate_on"), (3, "test", 3, "s", "gate_one"), (4, "val", 4, "t", "gate_one"), (5, "val", 5, "s", "gate_other"), (6, None, 6, "s", "gate_onx"), (7, "val", 2, "s", "gate_on")]
    df = spark.createDataFrame(rows, "id long, split string, bits long, block string, name string")
    assert [tuple(x) for x in overlap.near_names(df, 2).collect()] == [("s", "gate_on", "gate_one", 1)]


def naive_runs(rows, gap):
    seen, out, last = set(), [], {}
    for key, at, i, lab in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        if (key, at, i) in seen:
            continue
        seen.add((key, at, i))
        if key in last and last[key][3] == lab and at - last[key][4] <= gap:
            last[key][1:] = [i, last[key][2] + 1, lab, at]
        else:
            last[key] = [i, i, 1, lab, at]
            out.append(last[key])
    return sorted((a, z, n) for a, z, n, *_ in out)


@pytest.mark.parametrize("cell_s", [1, 7, 600])
def test_runs_are_the_naive_scan(spark, cell_s):
    r = random.Random(9)
    rows, at = [], 0
    for i in range(900):
        at += r.choice([0, 1, 2, 3, 5, 6, 9])
        rows.append((r.choice(["a", "a", None]), at, i, r.choice(["x", "x", "x", None, "y"])))
    rows += rows[::5] + [("a", None, 5000, "x"), ("a", 3, None, "x")]
    df = spark.createDataFrame([(*x, j) for j, x in enumerate(rows)], "k string, s long, id long, lab string, re long").withColumn("at", F.timestamp_seconds("s")).withColumn("us", F.lit(0)).withColumn("cell", F.lit(0))
    got = runs.collapse_runs(df, ["k"], "at", "id", {"lab": F.col("lab")}, "re", 5.0, cell_s)
    assert sorted((x["first_id"], x["last_id"], x["n_events"]) for x in got.collect()) == naive_runs(rows, 5)
    assert runs.collapse_runs(df.where("false"), ["k"], "at", "id", {"lab": F.col("lab")}, "re").count() == 0


@pytest.mark.parametrize("text,want", [(None, ""), (" ", ""), ("Knife; guns,", "guns,knife"), ("guns , GUNS", "guns")])
def test_label_set(spark, text, want):
    assert spark.createDataFrame([(text,)], "w string").select(keys.label_set(F.col("w"))).first()[0] == want


PLAN = "plan_id long, category string, share double, min_rows long, sample_size long"


def test_sample_is_exact_and_deficits_are_told(spark):
    rec = spark.createDataFrame([(i, "a" if i < 9000 else "b" if i < 9040 else None) for i in range(9100)], "record_id long, category string").withColumn("plan_id", F.lit(3))
    plan = spark.createDataFrame([(1, "a", 0.9, 10, 1000), (1, "b", 0.1, 60, 1000), (1, "b", 0.1, 60, 1000), (1, "c", 0.0, 5, 1000), (2, "a", 1.0, None, 9000), (2, None, 0.1, 1, 10), (3, "b", None, None, None)], PLAN)
    got = quota.proportional_sample(plan, rec).collect()
    n = {}
    for x in got:
        n[x["plan_id"], x["category"]] = n.get((x["plan_id"], x["category"]), 0) + 1
    assert n == {(1, "a"): 900, (1, "b"): 40, (2, "a"): 9000} and len({tuple(x) for x in got}) == len(got)
    report = {(x["plan_id"], x["category"]): (x["need"], x["drawn"], x["lacking"], round(x["drawn_share"], 4) if x["drawn_share"] is not None else None) for x in quota.sample_report(plan, rec).collect()}
    assert report == {(1, "a"): (900, 900, 0, 0.9574), (1, "b"): (100, 40, 60, 0.0426), (1, "c"): (5, 0, 5, 0.0), (2, "a"): (9000, 9000, 0, 1.0), (3, "b"): (0, 0, 0, None)}
    assert quota.proportional_sample(plan, rec.where("false")).count() == 0 and quota.sample_report(plan.where("false"), rec).count() == 0


def test_sample_does_not_favour_small_ids(spark):
    rec = spark.range(20000).select(F.col("id").alias("record_id"), F.lit("a").alias("category"))
    plan = spark.createDataFrame([(1, "a", 1.0, 0, 2000)], PLAN)
    mean = quota.proportional_sample(plan, rec).agg(F.avg("record_id")).first()[0]
    assert abs(mean - 10000) < 600


def test_categories(spark):
    df = spark.createDataFrame([([0, 1, 1],), ([1, 0],), ([9],), ([],), (None,), ([9, 2],)], "c array<int>").select(F.transform("c", lambda x: F.struct(x.alias("cls"))).alias("labels"))
    got = [r[0] for r in df.select(quota.category_of_picture("labels", ["guns", "knife", "long_gun"], "__background__")).collect()]
    assert got == ["knife", "guns", None, "__background__", None, "long_gun"]
