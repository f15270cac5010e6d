import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import curation, hamming


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def bits(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def patterns(seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 20))) for b in base for _ in range(6)]
    return [signed(x) for x in base] + [0, -1], [signed(x) for x in near] + [1, 63, 127]


def frame(spark, values):
    return spark.createDataFrame([(x,) for x in [*values, None]], "bits long").withColumn("key", F.lit(1))


@pytest.mark.parametrize("most,crowded", [(0, 4096), (3, 4096), (6, 4096), (6, 0)])
def test_near_patterns_are_all_of_them(spark, most, crowded):
    e, t = patterns(most)
    got = {tuple(x) for x in hamming.near_patterns(frame(spark, e), frame(spark, t), most, crowded).collect()}
    assert got == {(a, b) for a in e for b in t if bits(a, b) <= most}


@pytest.mark.parametrize("block", [4096, 16])
def test_nearest_is_the_minimum_of_every_row(spark, block, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", block)
    e, t = patterns(7)
    got = [tuple(x) for x in hamming.nearest_patterns(frame(spark, e), frame(spark, t)).collect()]
    assert len(got) == len(set(e)) and dict(got) == {a: min(bits(a, b) for b in t) for a in e}
    assert hamming.nearest_patterns(frame(spark, e), frame(spark, [])).count() == 0 and hamming.nearest_patterns(frame(spark, []), frame(spark, t)).count() == 0


def test_nearest_broadcasts_no_pairs_of_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", 16)
    e, t = patterns(8)
    assert "Broadcast" not in hamming.nearest_patterns(frame(spark, e), frame(spark, t))._jdf.queryExecution().executedPlan().toString()


def test_nearest_across_is_the_minimum_over_all_chunks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", 16)
    monkeypatch.setattr(hamming, "CHUNK", 16)
    e, t = patterns(9)
    e += e[:20]
    val = spark.createDataFrame([*enumerate(e), (-1, None)], "image_id long, bits long")
    got = [tuple(x) for x in curation.nearest_across(val, frame(spark, t), "image_id", "bits").collect()]
    assert sorted(got) == [(i, min(bits(a, b) for b in t)) for i, a in enumerate(e)]


@pytest.mark.parametrize("n,mask", [(70_000, 2**64 - 1), (70_000, 0xFFFF0000000000FF), (70_000, 0x0101FFFF01010101), (3, 2**64 - 1)])
def test_nearest_of_even_and_crowded_patterns(n, mask):
    r = np.random.default_rng(n)
    t = np.unique(r.integers(0, 2**64, n, np.uint64) & np.uint64(mask))
    e = np.concatenate([t[::1000] ^ np.uint64(37 << 20), r.integers(0, 2**64, 60, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    assert hamming.nearest_of(e, t).tolist() == [int(np.bitwise_count(x ^ t).min()) for x in e]
    assert hamming.nearest_of(e, t[:0]).tolist() == [65] * len(e) and not len(hamming.nearest_of(e[:0], t))


def test_copies_make_stars_and_no_pairs(spark):
    rows = [(i, 5) for i in range(300)] + [(1000, 7), (1001, None), (1002, 1 << 60)]
    got = {tuple(x) for x in curation.near_pairs(spark.createDataFrame(rows, "k long, h long"), "k", "h", 6).collect()}
    assert got == {(0, i) for i in range(1, 300)} | {(0, 1000), (0, 1002), (1000, 1002)}
