"""Ordered folds whose memory is a batch and not a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str, whole: str | None = None,
) -> DataFrame:
    """Passes each key's rows, in order and in pieces, through ``step`` with the key's state.

    Rows are hashed by key and sorted by Spark, which spills; the fold then reads the sorted batches one by one, so a
    key of any size needs one batch and its state. Rows of one key and one value of ``whole`` come in one piece. A null
    key is a key.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, rest = None, None, None

        def pieces(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal now, state
            if not len(b):
                return
            codes = np.zeros(len(b), bool)
            for k in keys:
                c = pd.factorize(b[k], use_na_sentinel=True)[0]
                codes[1:] |= c[1:] != c[:-1]
            for part in np.split(np.arange(len(b)), np.flatnonzero(codes)):
                if not len(part):
                    continue
                piece = b.iloc[part]
                key = tuple(None if pd.isna(x) else x for x in piece[keys].iloc[0])
                if state is None or key != now:
                    now, state = key, start()
                yield step(state, piece)

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            rest = None
            if whole and len(b):
                tail = len(b) - 1
                last = b[[*keys, whole]].iloc[tail]
                same = np.ones(len(b), bool)
                for k in (*keys, whole):
                    same &= (b[k].isna() if pd.isna(last[k]) else b[k] == last[k]).to_numpy(bool)
                other = np.flatnonzero(~same)
                cut = int(other[-1]) + 1 if len(other) else 0
                b, rest = b.iloc[:cut], b.iloc[cut:]
            yield from pieces(b)
        if rest is not None:
            yield from pieces(rest)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def schema_of(df: DataFrame, columns: list[str] | None = None) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if columns is None or f.name in columns)


def whole_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame], schema: str) -> DataFrame:
    """Passes batches of whole groups to ``fn`` with the places where each group begins and ends.

    For many small groups, such as frames: one call and one result per batch, and not per group. A group must fit a
    task's memory.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def cuts(b: pd.DataFrame) -> np.ndarray:
            new = np.zeros(len(b), bool)
            for k in keys:
                c = pd.factorize(b[k], use_na_sentinel=True)[0]
                new[1:] |= c[1:] != c[:-1]
            return np.flatnonzero(new)

        def call(b: pd.DataFrame, at: np.ndarray) -> Iterator[pd.DataFrame]:
            if len(b):
                edges = [0, *at.tolist(), len(b)]
                yield fn(b, list(zip(edges, edges[1:])))

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            at = cuts(b)
            if not len(at):
                rest = b
                continue
            last = int(at[-1])
            yield from call(b.iloc[:last], at[:-1])
            rest = b.iloc[last:]
        if rest is not None:
            yield from call(rest, cuts(rest))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
