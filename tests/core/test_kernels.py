import itertools

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import alerting as A
from tessera.operators import curation, ordered, suppression
from tessera.operators.assignment import assign
from tessera.operators.folds import ordered_fold, whole_groups
from tessera.sources.tables import cutter


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
@settings(max_examples=150, deadline=None)
def test_assignment_has_the_least_cost(n, m, seed):
    c = np.round(np.random.default_rng(seed).normal(size=(n, m)), 1)
    got = assign(c)
    a = c if n <= m else c.T
    best = min(sum(a[i, j] for i, j in enumerate(q)) for q in itertools.permutations(range(a.shape[1]), a.shape[0]))
    assert len(got) == min(n, m) and abs(sum(c[i, j] for i, j in got) - best) < 1e-9


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


@given(st.integers(0, 10_000))
@settings(max_examples=80, deadline=None)
def test_suppression_is_the_naive_fold(seed):
    r = np.random.default_rng(seed)
    xy = r.integers(0, 20, (8, 2)).astype(float)
    boxes = np.hstack([xy, xy + r.integers(10, 30, (8, 2))])
    order, kept = r.permutation(8), []
    for i in order:
        if all(iou(boxes[i], boxes[k]) <= 0.4 for k in kept):
            kept.append(i)
    assert sorted(np.flatnonzero(suppression.kept_boxes(boxes, order, 0.4))) == sorted(kept)


def test_suppression_of_the_chain_fixture(spark, data):
    from tessera.plans.registry import QUERIES
    import tessera.plans  # noqa: F401

    d = data.replace("sf0.001", "sf0.01")
    assert QUERIES["o20_suppress_duplicates"](spark, d).count() == 12615


@given(st.lists(st.integers(0, 200), max_size=40), st.integers(1, 30))
@settings(max_examples=100, deadline=None)
def test_log_dedup_is_the_naive_fold(times, every):
    times, last, want = sorted(times), None, []
    for t in times:
        keep = last is None or t - last >= every
        want.append(keep)
        last = t if keep else last
    got, _ = A.emitted(np.array(times, float), every)
    assert got.tolist() == want


def test_levels_go_up_at_once_and_down_one_by_one():
    s = A.Calm()
    assert [A.settle(s, x) for x in (1, 3, 2)] == [1, 3, 3]
    down = [A.settle(s, None) for _ in range(46 * 3)]
    assert down[43:45] == [3, 2] and down[89] == 1 and down[-1] == 0


def test_persistence_ages_and_forgets():
    box, none = np.array([[0, 0, 50, 50.0]]), np.zeros((0, 4))
    t = []
    assert A.persist(t, ["knife"], box) == [1]
    assert A.persist(t, ["knife"], box + 5) == [2]
    assert A.persist(t, ["guns"], box) == [1]
    A.persist(t, [], none)
    assert [x.label for x in t] == ["guns"]
    A.persist(t, [], none)
    assert t == []


def naive_recordings(levels, tail):
    out, start, calm, prev = [], None, None, None
    for f, lv in enumerate(levels):
        if lv >= 2:
            start, calm = f if start is None else start, None
        elif start is not None:
            calm = f if calm is None else calm
            if f - calm >= tail:
                out.append((start, f))
                start = calm = None
        prev = f
    if start is not None:
        out.append((start, prev))
    return out


def test_recordings_are_the_naive_fold(spark):
    r = np.random.default_rng(3)
    rows, want = [], []
    for p in range(12):
        lv = np.where(r.random(120) < 0.08, 3, r.integers(0, 2, 120)).tolist()
        rows += [(p, f, int(x)) for f, x in enumerate(lv)]
        want += [(p, a, z) for a, z in naive_recordings(lv, 5)]
    df = spark.createDataFrame(rows, "person long, frame_id long, level int")
    got = [tuple(x) for x in ordered.recordings(df, "person", "frame_id", "level", 5).collect()]
    assert sorted(got) == sorted(want)


def test_folds_see_whole_keys_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(None if k == 2 else k, i) for k in range(5) for i in range(23)], "k long, i long")

        def count(state, pdf):
            state["n"] = state.get("n", 0) + len(pdf)
            return pdf.assign(n=state["n"])

        got = ordered_fold(df, ["k"], ["i"], dict, count, "k long, i long, n long", whole="i").groupBy("k").max("n").collect()
        assert {(r[0], r[1]) for r in got} == {(None if k == 2 else k, 23) for k in range(5)}

        def sizes(b, bounds):
            return pd.DataFrame([(b["k"].iloc[a], z - a) for a, z in bounds], columns=["k", "n"]).astype({"k": "Int64"})

        got = whole_groups(df, ["k"], sizes, "k long, n long").collect()
        assert {(r[0], r[1]) for r in got} == {(None if k == 2 else k, 23) for k in range(5)}
        assert whole_groups(df.where("false"), ["k"], sizes, "k long, n long").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    got = {r["id"]: r["root"] for r in curation.components(edges, cutter(spark)).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_holdout_keeps_groups_whole_and_reaches_its_targets(spark):
    g = spark.createDataFrame([(i, i % 3, (i + 1) % 2, 1) for i in range(300)], "group_id long, a long, b long, c long")
    got = curation.choose_holdout(g, 0.2, ["a", "b", "c"]).collect()
    assert len(got) == 300 and 0 < sum(r["split"] == "val" for r in got) < 120


def test_an_unmapped_class_stops_a_strict_job(spark):
    import pytest

    labels = spark.createDataFrame([("s", "Knife")], "source string, class string")
    m = spark.createDataFrame([("s", "knife", "knife")], "source string, src_class string, target string")
    assert curation.unmapped(labels, m).count() == 1 and curation.require_mapped(labels, m, strict=False).count() == 0
    with pytest.raises(Exception, match="unmapped class s/Knife"):
        curation.require_mapped(labels, m).collect()
