from collections import Counter

import numpy as np
import pytest

from tessera.config import TRACKING
from tessera.operators import suppression
from tessera.operators import tracking as T


def look(k, n=8):
    return np.eye(n)[k]


def box(x, y, w=40, h=120):
    return [x, y, x + w, y + h]


def test_filter_is_the_textbook_one():
    r = np.random.default_rng(1)
    t = T.Tracks()
    t.begin(T.to_state(np.array([box(10, 20), box(300, 80)], float)), TRACKING)
    mean, cov = t.mean.copy(), t.cov.copy()
    for _ in range(6):
        z = mean[:, :4] + r.normal(size=(2, 4)) * [3, 3, 0.01, 2]
        t.predict(TRACKING)
        t.update([0, 1], z, TRACKING)
        for k in range(2):
            a = np.eye(8) + np.eye(8, k=4)
            h = mean[k, 3]
            q = np.diag([h * TRACKING.place, h * TRACKING.place, 1e-2, h * TRACKING.place, h * TRACKING.speed, h * TRACKING.speed, 1e-5, h * TRACKING.speed]) ** 2
            m, c = a @ mean[k], a @ cov[k] @ a.T + q
            s = c[:4, :4] + np.diag([m[3] * TRACKING.place, m[3] * TRACKING.place, 1e-1, m[3] * TRACKING.place]) ** 2
            g = c[:, :4] @ np.linalg.inv(s)
            mean[k], cov[k] = m + g @ (z[k] - m[:4]), c - g @ s @ g.T
        assert np.allclose(t.mean, mean) and np.allclose(t.cov, cov)


def crossing(spark, hide=()):
    rows = []
    for f in range(40):
        for k, x in ((0, 10 + 8 * f), (1, 330 - 8 * f)):
            if (k, f) not in hide:
                rows.append((1, f, k, *map(float, box(x, 100 + 5 * k)), look(k).tolist()))
    return spark.createDataFrame(rows, "stream_id long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, feat array<double>")


@pytest.mark.parametrize("hidden", [0, 3])
def test_people_who_cross_keep_their_tracks(spark, hidden):
    got = T.track_streams(crossing(spark, {(0, 19 + i) for i in range(hidden)})).toPandas()
    seen = got[got.matched].groupby("det_id").track_id.agg(set)
    assert seen[0] != seen[1] and all(len(s) == 1 for s in seen)
    assert got.frame_id.min() == TRACKING.confirm - 1 and len(got[~got.matched]) == hidden
    coasting = got[~got.matched].sort_values("frame_id")
    assert coasting.since.tolist() == list(range(1, hidden + 1)) and coasting.det_id.isna().all()


def test_a_long_absence_and_a_new_look_begin_tracks(spark):
    gone = {(0, f) for f in range(10, 10 + TRACKING.patience + 2)}
    got = T.track_streams(crossing(spark, gone)).toPandas()
    assert got[got.det_id == 0].track_id.nunique() == 2 and got[got.det_id == 1].track_id.nunique() == 1
    assert T.track_streams(crossing(spark).where("false")).count() == 0


def test_unsure_tracks_end_with_a_miss():
    t = T.Tracks()
    T.step(t, np.array([box(0, 0)], float), [None])
    T.step(t, np.zeros((0, 4)), [])
    assert not len(t.ids) and t.looks == []
    for k in range(3):
        T.step(t, np.array([box(2 * k, 0)], float), [None])
    assert t.sure.tolist() == [True] and t.ids.tolist() == [2]


def chained(rows, stride=1, least=3):
    """Box by box: {(key, frame, row): track}."""
    out, keys = {}, {}
    for key, frame, row, *b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:3])):
        if frame % stride:
            continue
        s = keys.setdefault(key, {"frames": {}, "count": 0})
        old = s["frames"].get(frame - stride, [])
        best = max(old, key=lambda x: suppression.overlaps(np.array(b), np.array([x[0]]))[0], default=None)
        if best and suppression.overlaps(np.array(b), np.array([best[0]]))[0] >= 0.5:
            track = best[1]
        else:
            s["count"] += 1
            track = s["count"]
        s["frames"].setdefault(frame, []).append((b, track))
        out[key, frame, row] = track
    n = Counter((k, t) for (k, _, _), t in out.items())
    return {x: t for x, t in out.items() if n[x[0], t] >= least}


@pytest.mark.parametrize("batch,stride,least", [(1, 1, 3), (7, 1, 3), (7, 2, 4), (10_000, 1, 3), (50, 1, 1)])
def test_chains_are_those_of_box_by_box(spark, batch, stride, least):
    r = np.random.default_rng(batch + stride)
    rows = []
    for key in (None, 1, 2, 3, 4):
        for f in range(40):
            if r.random() < 0.9:
                for k in range(r.integers(1, 5)):
                    x, y = (float(v) for v in r.integers(0, 3, 2) * 10)
                    rows.append((key, f, k, x, y, x + 40, y + 40))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "person long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double")
        got = [tuple(x) for x in suppression.chain_tracks(df, "person", "frame_id", "det_id", stride, least=least).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = chained(rows, stride, least)
    assert len(got) == len(want) and {x[:3]: x[3] for x in got} == want
