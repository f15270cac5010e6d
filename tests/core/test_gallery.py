"""Properties of identity resolution on small vectors with exact angles."""

import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import IDENTITY
from tessera.functions.geometry import Box
from tessera.operators import identity as I
from tessera.operators.gates import admission_reason
from tessera.operators.suppression import diverse_reservoir, spread_samples

LEFT, RIGHT = (30.0, 50.0, 90.0, 250.0), (500.0, 60.0, 560.0, 260.0)


def at(degrees, plane=0):
    """A unit vector turned by so many degrees in one of three planes; vectors of different planes are orthogonal."""
    v = np.zeros(6)
    v[2 * plane], v[2 * plane + 1] = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return v


def seen(track, feat, box=LEFT, admit=True):
    return {"track_id": track, "feat": feat, "box": box, "ratios": None, "admit": admit}


def play(*frames, p=IDENTITY, g=None):
    """Outcome of each (time, rows) by track, and the gallery."""
    g = g or I.Gallery()
    return [{t: (who, how) for t, who, how, _ in I.step(g, rows, now, p)} for now, rows in frames], g


@pytest.mark.parametrize("turn,how", [(0, "matched"), (15, "matched"), (45, "provisional"), (50, "provisional"), (75, "new"), (90, "new")])
def test_likeness_decides_between_old_new_and_doubt(turn, how):
    # cos 45 = 0.707 and cos 50 = 0.643 lie between the two thresholds.
    out, _ = play((0, [seen(1, at(0))]), (1, []), (9, [seen(2, at(turn))]))
    assert out[0][1] == (1, "new") and out[2][2][1] == how and (out[2][2][0] == 1) == (how == "matched")


def test_no_two_tracks_of_a_frame_share_an_identity():
    r = random.Random(4)
    g, p, now = I.Gallery(), replace(IDENTITY, capacity=5), 0.0
    for _ in range(300):
        now += r.choice([0.1, 9.0])
        rows = [seen(r.randrange(9), at(r.uniform(0, 90), r.randrange(3)), r.choice([LEFT, RIGHT]), r.random() < 0.9) for _ in range(4)]
        rows = list({x["track_id"]: x for x in rows}.values())
        given = [who for _, who, _, _ in I.step(g, rows, now, p) if who is not None]
        assert len(set(given)) == len(given) and set(given) <= set(g.people)


def test_a_runner_up_that_another_query_takes_does_not_count():
    # Persons at 0 and 30 degrees are too alike for the margin, unless each query has one of its own.
    start = (0, [seen(1, at(0), LEFT), seen(2, at(30), RIGHT)])
    out, _ = play(start, (1, []), (9, [seen(3, at(1), LEFT), seen(4, at(31), RIGHT)]))
    assert out[2] == {3: (1, "matched"), 4: (2, "matched")}
    near = replace(IDENTITY, margin=0.2)
    assert play(start, (1, []), (9, [seen(3, at(1), LEFT)]), p=near)[0][2] == {3: (None, "provisional")}


def test_doubt_lasts_only_so_long():
    p = replace(IDENTITY, defer=4)
    out, _ = play((0, [seen(1, at(0))]), (1, []), *[(9 + i, [seen(2, at(47))]) for i in range(6)], p=p)
    assert [x[2][1] for x in out[2:]] == ["provisional"] * 4 + ["new", "held"]


@pytest.mark.parametrize("gap,same", [(0.1, False), (0.4, True), (3.5, True)])
def test_nobody_moves_faster_than_possible(gap, same):
    # 470 pixels: 200 and 800 a second are enough from 0.34 seconds on.
    out, _ = play((0, [seen(1, at(0), LEFT)]), (gap / 2, []), (gap, [seen(2, at(2), RIGHT)]))
    assert (out[2][2][0] == 1) == same


def test_the_absent_expire_and_the_longest_absent_go_first():
    _, g = play((0, [seen(1, at(0)), seen(2, at(0, 1), RIGHT)]), (5, [seen(1, None, admit=False)]))
    assert I.expire(g, 604.0) == [2] and sorted(g.people) == [1] and I.expire(g, 1e9) == []
    small = replace(IDENTITY, capacity=2)
    _, g = play(*itertools.chain.from_iterable([(10 * k, [seen(k, at(90 * (k % 2), k // 2))]), (10 * k + 1, [])] for k in range(5)), p=small)
    assert sorted(g.people) == [4, 5]


def test_more_newcomers_than_room_stay_while_they_are_seen():
    small = replace(IDENTITY, capacity=2)
    rows = [seen(k, at(90 * (k % 2), k // 2), (60.0 * k, 0.0, 60.0 * k + 50, 200.0)) for k in range(5)]
    out, g = play((0, rows), (1, rows), p=small)
    assert {how for _, how in out[0].values()} == {"new"} and out[1] == {k: (k + 1, "held") for k in range(5)} and len(g.people) == 5


def test_a_track_that_returns_as_someone_else_is_asked_anew():
    out, g = play((0, [seen(1, at(0)), seen(2, at(0, 1), RIGHT)]))
    g.last_row[1] -= 4
    assert play((20, [seen(1, at(0, 2)), seen(2, at(0, 1), RIGHT)]), g=g)[0][0] == {1: (3, "new"), 2: (2, "held")}


def test_numbers_go_on_after_a_reset():
    _, g = play((0, [seen(1, at(0))]))
    I.reset(g)
    assert not g.people and play((1, [seen(1, at(0))]), g=g)[0][0] == {1: (2, "new")}


def naive_store(vectors, room):
    kept = []
    for k, v in enumerate(vectors):
        if len(kept) < room:
            kept.append(k)
            continue
        crowd = [max(float(vectors[a] @ vectors[b]) for b in kept if b != a) for a in kept]
        worst = max(range(room), key=lambda i: (crowd[i], -i))
        if max(float(vectors[a] @ v) for a in kept) < crowd[worst]:
            kept[worst] = k
    return kept


@pytest.mark.parametrize("seed", range(8))
def test_a_store_keeps_what_the_rule_keeps(seed):
    r = np.random.default_rng(seed)
    vectors = r.normal(size=(120, 5))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    store, ids = I.Reservoir(6), {}
    for k, v in enumerate(vectors):
        place = store.offer(v)
        if place is not None:
            ids[place] = k
        if store.size > 1:
            like = store.vectors @ store.vectors.T - 2 * np.eye(store.size)
            assert np.allclose(like.max(axis=1), store.near[: store.size])
    assert [ids[i] for i in range(6)] == naive_store(vectors, 6)
    mean = store.vectors.mean(axis=0)
    assert np.allclose(store.centre, mean / np.linalg.norm(mean))


def test_stores_and_spread_samples_of_keys(spark):
    r = np.random.default_rng(3)
    vectors = r.normal(size=(90, 5))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = [(k % 3, k, v.tolist()) for k, v in enumerate(vectors)] + [(9, 500, vectors[0].tolist())]
    df = spark.createDataFrame(rows, "key long, id long, feat array<double>")
    got, spread = {}, {}
    for x in diverse_reservoir(df, "key", "id", 6).collect():
        got.setdefault(x["key"], set()).add(x["id"])
    for x in spread_samples(df, "key", "id", 5).collect():
        spread.setdefault(x["key"], {})[x["rank"]] = x["id"]
    assert got == {q: {q + 3 * i for i in naive_store(vectors[q::3], 6)} for q in range(3)} | {9: {500}}
    for q in range(3):
        mine, chosen = vectors[q::3], [0]
        while len(chosen) < 5:
            chosen.append(min((i for i in range(30) if i not in chosen), key=lambda i: (max(mine[i] @ mine[c] for c in chosen), i)))
        assert [spread[q][i] for i in range(5)] == [q + 3 * i for i in chosen]
    assert spread[9] == {0: 500}


@pytest.mark.parametrize("conf,box,matched,kp,want", [
    (0.8, (70, 90, 150, 330), True, 7, "ok"), (0.4, (70, 90, 150, 330), True, None, "low_confidence"), (0.8, (70, 90, 150, 150), True, None, "crop_too_small"),
    (0.8, (3, 90, 150, 330), True, None, "side_truncated"), (0.8, (70, 90, 150, 330), False, None, "not_matched"), (0.8, (70, 90, 150, 330), None, 2, "insufficient_keypoints"),
    (0.8, (70, 2, 290, 92), True, None, "clipped_and_implausible_shape"),
])
def test_admission(spark, conf, box, matched, kp, want):
    df = spark.createDataFrame([(*map(float, box), conf, matched, kp)], "x1 double, y1 double, x2 double, y2 double, conf double, matched boolean, kp int")
    assert df.select(admission_reason(Box.of(), F.col("conf"), F.col("matched"), F.col("kp"), F.lit(True)).alias("r")).first()["r"] == want
