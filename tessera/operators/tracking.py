"""Short-term tracks from detections: constant-velocity filter, gated appearance, assignment by age, overlap as a fallback."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.config import TRACKING, Tracking
from tessera.operators.assignment import assign
from tessera.operators.folds import ordered_fold
from tessera.operators.suppression import overlap_grid

FAR = 1e5
SCHEMA = "stream_id long, frame_id long, track_id long, det_id long, matched boolean, since int, x1 double, y1 double, x2 double, y2 double"


def to_state(boxes: np.ndarray) -> np.ndarray:
    """Centre, aspect and height of boxes."""
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    return np.stack([(boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2, w / np.maximum(h, 1e-6), h], axis=1)


def to_boxes(mean: np.ndarray) -> np.ndarray:
    w = mean[:, 2] * mean[:, 3]
    return np.stack([mean[:, 0] - w / 2, mean[:, 1] - mean[:, 3] / 2, mean[:, 0] + w / 2, mean[:, 1] + mean[:, 3] / 2], axis=1)


def spreads(height: np.ndarray, place: float, aspect: float) -> np.ndarray:
    """Standard deviations of centre, aspect and height, most of them in shares of the height."""
    s = np.repeat((place * height)[:, None], 4, axis=1)
    s[:, 2] = aspect
    return s


@dataclass
class Tracks:
    """All tracks of a stream, one row per track in every array."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    mean: np.ndarray = field(default_factory=lambda: np.zeros((0, 8)))
    cov: np.ndarray = field(default_factory=lambda: np.zeros((0, 8, 8)))
    hits: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    since: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sure: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    looks: list[np.ndarray] = field(default_factory=list)
    next_id: int = 1
    frame: int | None = None

    def predict(self, p: Tracking) -> None:
        h = np.abs(self.mean[:, 3])
        noise = np.concatenate([spreads(h, p.place, 1e-2), spreads(h, p.speed, 1e-5)], axis=1) ** 2
        move = np.eye(8)
        move[range(4), range(4, 8)] = 1.0
        self.mean = self.mean @ move.T
        self.cov = move @ self.cov @ move.T + noise[:, :, None] * np.eye(8)
        self.since = self.since + 1

    def seen_as(self, p: Tracking) -> np.ndarray:
        """Covariance of what would be measured."""
        return self.cov[:, :4, :4] + (spreads(np.abs(self.mean[:, 3]), p.place, 1e-1) ** 2)[:, :, None] * np.eye(4)

    def off(self, states: np.ndarray, p: Tracking) -> np.ndarray:
        """Squared Mahalanobis distance of every measured state from every track."""
        d = states[None, :, :] - self.mean[:, None, :4]
        return np.einsum("nmi,nij,nmj->nm", d, np.linalg.inv(self.seen_as(p)), d)

    def update(self, rows: list[int], states: np.ndarray, p: Tracking) -> None:
        gain = self.cov[rows][:, :, :4] @ np.linalg.inv(self.seen_as(p)[rows])
        self.mean[rows] += np.einsum("nij,nj->ni", gain, states - self.mean[rows, :4])
        self.cov[rows] -= gain @ self.cov[rows][:, :4, :]
        self.hits[rows] += 1
        self.since[rows] = 0

    def begin(self, states: np.ndarray, p: Tracking) -> None:
        n = len(states)
        std = np.concatenate([spreads(states[:, 3], 2 * p.place, 1e-2), spreads(states[:, 3], 10 * p.speed, 1e-5)], axis=1)
        self.ids = np.concatenate([self.ids, np.arange(self.next_id, self.next_id + n)])
        self.mean = np.concatenate([self.mean, np.concatenate([states, np.zeros((n, 4))], axis=1)])
        self.cov = np.concatenate([self.cov, (std**2)[:, :, None] * np.eye(8)])
        self.hits, self.since = np.concatenate([self.hits, np.ones(n, np.int64)]), np.concatenate([self.since, np.zeros(n, np.int64)])
        self.sure = np.concatenate([self.sure, np.full(n, p.confirm <= 1)])
        self.next_id += n

    def keep(self, alive: np.ndarray) -> None:
        for name in ("ids", "mean", "cov", "hits", "since", "sure"):
            setattr(self, name, getattr(self, name)[alive])
        self.looks = [x for x, a in zip(self.looks, alive) if a]


def paired(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs of least total cost of which each costs at most ``most``."""
    return [(i, j) for i, j in assign(np.where(cost <= most, cost, FAR)) if cost[i, j] <= most]


def step(t: Tracks, boxes: np.ndarray, feats: list[np.ndarray | None], p: Tracking = TRACKING) -> list[int]:
    """One frame: the row of the track that each detection continues or begins; ``t`` is changed in place.

    Sure tracks are matched by likeness to their stored vectors, within the gate of their motion, those seen most
    recently first; then unsure ones, and sure ones missed only now, by overlap. A track is sure after ``confirm``
    detections in a row, an unsure one ends with its first miss, a sure one after ``patience`` frames.
    """
    t.predict(p)
    states = to_state(boxes)
    free = set(range(len(boxes)))
    pairs: list[tuple[int, int]] = []
    with_look = [j for j in range(len(boxes)) if feats[j] is not None]
    if t.sure.any() and with_look:
        off = t.off(states, p)
        look = np.stack([feats[j] for j in with_look])
        for age in range(1, p.patience + 1):
            rows = [i for i in np.flatnonzero(t.sure & (t.since == age)) if len(t.looks[i])]
            cols = [k for k, j in enumerate(with_look) if j in free]
            if not rows or not cols:
                continue
            cost = np.stack([1.0 - (t.looks[i] @ look[cols].T).max(axis=0) for i in rows])
            cost[off[np.ix_(rows, [with_look[k] for k in cols])] > p.gate] = FAR
            for i, k in paired(cost, p.unlike):
                pairs.append((int(rows[i]), with_look[cols[k]]))
                free.discard(with_look[cols[k]])
    taken = {i for i, _ in pairs}
    rows = [i for i in range(len(t.ids)) if i not in taken and (not t.sure[i] or t.since[i] == 1)]
    cols = sorted(free)
    if rows and cols:
        for i, k in paired(1.0 - overlap_grid(to_boxes(t.mean[rows]), boxes[cols]), p.apart):
            pairs.append((rows[i], cols[k]))
            free.discard(cols[k])
    if pairs:
        t.update([i for i, _ in pairs], states[[j for _, j in pairs]], p)
        t.sure |= t.hits >= p.confirm
    alive = np.where(t.sure, t.since <= p.patience, t.since == 0)
    new = sorted(free)
    at = {j: i for i, j in pairs}
    for i, j in pairs:
        if feats[j] is not None:
            t.looks[i] = np.concatenate([t.looks[i], feats[j][None, :]])[-p.budget :] if len(t.looks[i]) else feats[j][None, :]
    place = np.cumsum(alive) - 1
    t.keep(alive)
    n = len(t.ids)
    if new:
        t.begin(states[new], p)
        t.looks += [np.zeros((0, 0)) if feats[j] is None else feats[j][None, :] for j in new]
    return [int(place[at[j]]) if j in at else n + new.index(j) for j in range(len(boxes))]


def run_frames(t: Tracks, pdf: pd.DataFrame, p: Tracking = TRACKING) -> pd.DataFrame:
    """Rows of the sure tracks of each frame; a frame number that is missing is a frame without detections."""
    out = []
    boxes = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
    frames, dets = pdf["frame_id"].to_numpy(), pdf["det_id"].to_numpy()
    feats = [None if f is None else np.asarray(f, float) for f in pdf["feat"]]
    stream = pdf["stream_id"].iloc[0]
    edges = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)]
    for a, z in zip(edges, edges[1:]):
        now = int(frames[a])
        gap = 0 if t.frame is None else now - t.frame - 1
        for k in range(min(gap, p.patience + 1)):
            step(t, np.zeros((0, 4)), [], p)
            out += [(stream, t.frame + 1 + k, int(i), None, False, int(s), *b) for i, s, b, sure in zip(t.ids, t.since, to_boxes(t.mean).tolist(), t.sure) if sure]
        rows = step(t, boxes[a:z], feats[a:z], p)
        det = {r: int(dets[a + j]) for j, r in enumerate(rows)}
        t.frame = now
        out += [(stream, now, int(t.ids[r]), det.get(r), r in det, int(t.since[r]), *b) for r, b in enumerate(to_boxes(t.mean).tolist()) if t.sure[r]]
    got = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    return got.astype({"det_id": "Int64"})


def track_streams(df: DataFrame, p: Tracking = TRACKING) -> DataFrame:
    """stream_id, frame_id, track_id, det_id, matched, since (frames since the last detection) and the filtered box of the
    sure tracks in every frame; a track that coasts has a null det_id.

    ``df``: stream_id, frame_id, det_id, x1..y2, feat (unit vector or null). Rows without frame or box are left out. A
    stream is one ordered state machine: a task's memory is a stream's live tracks and a batch.
    """
    rows = df.where("frame_id is not null AND x1 is not null AND y1 is not null AND x2 is not null AND y2 is not null").select("stream_id", "frame_id", "det_id", "x1", "y1", "x2", "y2", "feat")
    return ordered_fold(rows, ["stream_id"], ["frame_id", "det_id"], Tracks, lambda t, pdf: run_frames(t, pdf, p), SCHEMA, whole="frame_id")
