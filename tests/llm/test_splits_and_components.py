import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import components, keys, splits
from tessera.llm.workspace import Workspace

REC = "record_id long, split string, keys array<string>, unit_id long"
SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def naive_heads(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {v: find(v) for v in up}


@pytest.mark.parametrize("seed", range(4))
def test_components_are_those_of_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(None, 3), (5, None), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").withColumn("v", F.lit("clash")).withColumn("head", F.lit(None))
    got = {x["v"]: x["head"] for x in components.connected(df, Workspace(spark)).collect()}
    assert got == naive_heads(edges)


def test_long_chain_hub_and_empty(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    chain = list(zip(ids, ids[1:]))
    hub = [(1000, 1001 + i) for i in range(500)]
    got = {x["v"]: x["head"] for x in components.connected(spark.createDataFrame(chain + hub + chain, "a long, b long"), Workspace(spark)).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 801
    assert components.connected(spark.createDataFrame([], "a long, b long"), Workspace(spark)).count() == 0


def test_star_edges_are_no_pairs(spark):
    m = spark.createDataFrame([("x", i) for i in range(100)] + [("x", 5), (None, 7), ("y", None), ("z", 1)], "clip string, id long")
    assert components.star_edges(m.distinct(), "clip", "id").count() == 99


def test_ends_that_name_no_record_tie_nothing(spark):
    pairs = spark.createDataFrame([("./raw/a.jpg", "raw\\b.jpg"), ("raw/a.jpg", None), ("raw/a.jpg", " "), ("raw//a.jpg", "datasets/_raw/a.jpg"), ("gone.jpg", "raw/a.jpg")], "l string, r string")
    records = spark.createDataFrame([("raw/a.jpg", 1), ("raw/b.jpg", 2), (None, 3)], "img string, id long").select(keys.path_key(F.col("img")).alias("name"), "id")
    got = components.tied_pairs(pairs, keys.path_key(F.col("l")), keys.path_key(F.col("r")), records)
    assert [tuple(x) for x in got.collect()] == [(1, 2)]


@pytest.mark.parametrize("text,want", [
    ("raw/blades_chapel-b0kx12", "bladeschapelb0kx12"), ("Datasets\\_raw\\blades_chapel-b0kx12", "bladeschapelb0kx12"), ("BladesChapel_b0kx12", "bladeschapelb0kx12"), (" blades chapel b0kx12  ", "bladeschapelb0kx12"),
    ("blades_chapel" + chr(0xA0) + "B0KX12", "bladeschapelb0kx12"), ("blades_chapel-b0kx12.v2i.yolov8", "bladeschapelb0kx12"), ("blades_chapel-b0kx12.zip", "bladeschapelb0kx12"), ("blades_chapel-b0kx12/", "bladeschapelb0kx12"), ("", None), (None, None), ("  / ", None),
])
def test_source_key(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(keys.source_key(F.col("s"))).first()[0] == want


def test_clip_keys(spark):
    clips = ["cctv-2001-01-01-at-06_22_38_mp4", " CCTV Video 2001-01-01-at-06_22_38.MP4", "clips/x-2001-01-01 at 06.22.38.mp4", None, "", "n/a"]
    df = spark.createDataFrame([(clips,), (None,), ([],)], "c array<string>")
    assert [r[0] for r in df.select(keys.clip_keys(F.col("c"))).collect()] == [["20010101062238"], [], []]


def records(spark, rows):
    return spark.createDataFrame([(*r, -1) for r in rows], REC)


def test_units_conflicts_and_deficits(spark):
    rows = [(1, "train", ["a"]), (2, "val", ["a"]), (2, "val", ["a"]), (3, "train", ["b", "c"]), (4, None, ["c", "d"]), (5, None, ["d"]), (6, "test", None), (7, None, []), (None, "val", ["a"])]
    got, table = splits.update(spark, records(spark, rows), None, SHARES)
    out = {r["record_id"]: (r["unit_id"], r["split"], r["state"]) for r in got.collect()}
    assert out[1] == out[2] == (1, None, "quarantined")
    assert out[3] == out[4] == out[5] == (3, "train", "kept")
    assert out[6] == (6, "test", "kept") and out[7][2] == "new" and out[7][1] is not None
    assert {r["key"]: r["unit_id"] for r in table.collect() if not r["key"].startswith("#")} == {"a": 1, "b": 3, "c": 3, "d": 3}


def test_an_increment_keeps_grows_and_quarantines(spark):
    ws = Workspace(spark)
    _, known = splits.update(spark, records(spark, [(1, "train", ["a"]), (2, "val", ["b"]), (3, "train", ["c"]), (4, "test", ["z"])]), None, SHARES)
    known = ws.table(known)
    got, table = splits.update(spark, records(spark, [(10, None, ["a"]), (11, None, ["b", "c"]), (12, None, ["new"])]), known, SHARES)
    out = {r["record_id"]: (r["unit_id"], r["split"], r["state"]) for r in got.collect()}
    assert out[10] == (1, "train", "kept") and out[11] == (2, None, "quarantined") and out[12][2] == "new"
    held = {r["key"]: (r["unit_id"], r["split"]) for r in table.collect()}
    assert held["z"] == (4, "test") and held["b"] == held["c"] == (2, None) and held["a"] == (1, "train")
    assert {r["key"]: r["n"] for r in table.collect() if r["key"] in "abcz"} == {"a": 2, "b": 3, "c": 3, "z": 1}


def test_a_quarantined_unit_stays_so_until_someone_decides(spark):
    ws = Workspace(spark)
    _, known = splits.update(spark, records(spark, [(1, "train", ["a"]), (2, "val", ["a"]), (3, "train", ["b"])]), None, SHARES, ws)
    got, known = splits.update(spark, records(spark, [(10, None, ["a"]), (11, None, ["a", "b"])]), known, SHARES, ws)
    assert {tuple(x)[1:] for x in got.collect()} == {(1, None, "quarantined")}
    assert {(r["key"], r["unit_id"], r["state"], r["n"]) for r in known.collect()} == {("a", 1, "quarantined", 5), ("b", 1, "quarantined", 5)}
    got, known = splits.update(spark, records(spark, [(12, None, ["b"])]), known, SHARES, ws, reassign=True)
    placed = got.first()
    assert placed["state"] == "reassigned" and placed["split"] is not None
    got, known = splits.update(spark, records(spark, [(13, "test", ["a"])]), known, SHARES, ws)
    assert tuple(got.first()) == (13, 1, placed["split"], "reassigned") and known.first()["n"] == 7


def test_deficits_are_those_of_all_batches(spark):
    ws = Workspace(spark)
    _, known = splits.update(spark, records(spark, [(i, "train", [f"t{i % 90}"]) for i in range(900)]), None, SHARES, ws)
    got, known = splits.update(spark, records(spark, [(1000 + i, None, [f"n{i}"]) for i in range(100)]), known, SHARES, ws)
    assert {x["split"]: x["n"] for x in got.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"val": 50, "test": 50}
    again, known = splits.update(spark, records(spark, [(1000, None, ["n0"]), (2000, None, ["n0"])]), known, SHARES, ws, seen=got)
    assert known.where("key = 'n0'").first()["n"] == 2 and {x["state"] for x in again.collect()} == {"new"}


@pytest.mark.parametrize("seed,cut", [(s, c) for s in range(3) for c in (0, 20, 60)])
def test_batches_give_the_units_of_one_graph(spark, seed, cut):
    r = random.Random(seed)
    ids = list(range(60))
    r.shuffle(ids)
    rows = [(i, r.choice(["train", "train", "val", None]), r.sample([f"k{x}" for x in range(45)], r.choice([0, 1, 1, 2]))) for i in ids]
    heads = naive_heads([(a, b) for k in {k for _, _, ks in rows for k in ks} for a, b in zip([i for i, _, ks in rows if k in ks], [i for i, _, ks in rows if k in ks][1:])])
    held = {}
    for i, s, _ in rows:
        held.setdefault(heads.get(i, i), set()).add(s)
    want = {(i, heads.get(i, i), "quarantined" if len(held[heads.get(i, i)] - {None}) > 1 else "kept" if held[heads.get(i, i)] - {None} else "open") for i, _, _ in rows}
    got = splits.in_batches(spark, [records(spark, rows[:cut]), records(spark, rows[cut:] + rows[:5])], None)
    assert {(x["record_id"], x["unit_id"], x["state"]) for x in got.collect()} == want


def test_shares_hold_as_nearly_as_whole_units_allow(spark):
    r = random.Random(2)
    rows, n = [], 0
    for unit in range(400):
        for _ in range(2000 if unit == 0 else r.randint(1, 8)):
            rows.append((n, None, [f"k{unit}"]))
            n += 1
    got, _ = splits.update(spark, records(spark, rows), None, SHARES)
    size = {x["split"]: x["n"] for x in got.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got.groupBy("unit_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert all(abs(size[s] / n - p) < 0.01 for s, p in SHARES.items())


def test_empty_tables(spark):
    got, table = splits.update(spark, records(spark, []), None, SHARES)
    assert got.count() == 0 and table.count() == 0
