"""One-to-one assignment of least cost, per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.operators.folds import schema_of, whole_groups


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; the smaller side is matched whole.

    Shortest augmenting paths with row and column potentials: each row is inserted along the path of least reduced
    cost. O(n^2 m) for n rows and m >= n columns.
    """
    if not cost.size:
        return []
    c = np.asarray(cost, float)
    flipped = c.shape[0] > c.shape[1]
    if flipped:
        c = c.T
    n, m = c.shape
    row_pot, col_pot = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, here, last = start, 0.0, -1
        while True:
            reduced = here + c[row] - row_pot[row] - col_pot
            better = ~done & (reduced < dist)
            dist[better], via[better] = reduced[better], last
            open_ = np.where(done, np.inf, dist)
            last = int(open_.argmin())
            here = float(open_[last])
            done[last] = True
            if owner[last] < 0:
                break
            row = int(owner[last])
        seen = np.flatnonzero(done)
        for j in seen:
            if owner[j] >= 0:
                row_pot[owner[j]] += here - dist[j]
            col_pot[j] -= here - dist[j]
        row_pot[start] += here
        while last >= 0:
            before = via[last]
            owner[last] = start if before < 0 else owner[before]
            last = int(before)
    pairs = [(int(r), j) for j, r in enumerate(owner) if r >= 0]
    return sorted((j, i) for i, j in pairs) if flipped else sorted(pairs)


def _grouped(df: DataFrame, keys: list[str], left: str, right: str, cost: str, fn, out: str) -> DataFrame:
    """``fn`` turns each group's grid of costs (not a number where there is no pair) into rows, columns and values."""
    def solve(b: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        lefts, rights, costs = b[left].to_numpy(), b[right].to_numpy(), b[cost].to_numpy(float)
        at, chosen_l, chosen_r, values = [], [], [], []
        for a, z in bounds:
            rows, ri = np.unique(lefts[a:z], return_inverse=True)
            cols, ci = np.unique(rights[a:z], return_inverse=True)
            grid = np.full((len(rows), len(cols)), np.nan)
            grid[ri, ci] = costs[a:z]
            for i, j, v in fn(grid):
                at.append(a)
                chosen_l.append(rows[i])
                chosen_r.append(cols[j])
                values.append(v)
        got = b[keys].iloc[at].reset_index(drop=True)
        return got.assign(**{left: np.array(chosen_l, lefts.dtype), right: np.array(chosen_r, rights.dtype), out: np.array(values, float)})

    return whole_groups(df.select(*keys, left, right, cost), keys, solve, f"{schema_of(df.select(*keys, left, right))}, {out} double")


def assign_overlaps(pairs: DataFrame, keys: list[str], left: str, right: str, least: float = 0.5) -> DataFrame:
    """keys, left, right, iou: per group the pairing of most total overlap, of which pairs below ``least`` are dropped.

    The threshold holds after the solution, so a poor pair can keep a better one from being made. Groups are frames, so
    the square of their boxes is small.
    """
    def fn(grid):
        g = np.nan_to_num(grid)
        return [(i, j, float(g[i, j])) for i, j in assign(1 - g) if g[i, j] >= least]

    return _grouped(pairs, keys, left, right, "iou", fn, "iou")


def assign_poses(pairs: DataFrame, keys: list[str], left: str, right: str, reach: float = 120.0) -> DataFrame:
    """keys, left, right, dist: poses to tracks by distance (dist, inside).

    A pose may lie in the track's box or within ``reach`` of it; one that lies outside costs ``reach`` more; a
    forbidden pair is never made.
    """
    from pyspark.sql import functions as F

    forbidden = 1e6
    cost = F.when(F.col("inside"), F.col("dist")).when(F.col("dist") <= reach, F.col("dist") + reach).otherwise(forbidden)

    def fn(grid):
        g = np.where(np.isnan(grid), forbidden, grid)
        return [(i, j, float(g[i, j])) for i, j in assign(g) if g[i, j] < forbidden]

    return _grouped(pairs.withColumn("cost", cost), keys, left, right, "cost", fn, "cost")
