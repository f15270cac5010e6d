"""Joins of 64-bit patterns by the number of bits in which they differ."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import hamming
from tessera.sources.workspace import Workspace

SEGMENTS = 8
#: Left patterns of a block and right ones of a chunk at most, about; in the search for the nearest each block meets each chunk.
BLOCK, CHUNK = 1 << 20, 3 << 20
#: Patterns that are compared in one step.
ROOM = 1 << 16


def _keys(name: str, width: int, bits: int, segments: int, together: int):
    """One whole number per set of ``together`` segments of ``width`` bits."""
    part = [F.shiftrightunsigned(name, width * i).bitwiseAND(F.lit((1 << width) - 1)).cast("long") for i in range(segments)]
    keys = []
    for c, chosen in enumerate(combinations(range(segments), together)):
        key = F.lit(c).cast("long")
        for i in chosen:
            key = F.shiftleft(key, width).bitwiseOR(part[i])
        keys.append(key)
    return F.array(*keys)


def near_patterns(left: DataFrame, right: DataFrame, most: int = 6, crowded: int = 4096) -> DataFrame:
    """Distinct pairs left_bits, right_bits of 64-bit patterns that differ in at most ``most`` bits; 6 at most.

    Both inputs: bits (long). Null patterns pair with nothing and repeated ones count once.

    Method: segment join. ``most`` differing bits touch at most 6 of 8 segments of 8 bits, so two segments agree at their
    own positions: the keys are the 28 pairs of segments, of 16 bits each. Where more than ``crowded`` left patterns
    share a key, the patterns under it are cut once more: the 48 bits left are cut into 8 segments of 6 bits, of which
    two agree as well, and the key grows by 12 bits. Candidates are verified by their differing bits.
    """
    if not 0 <= most <= SEGMENTS - 2:
        raise ValueError("at most 6 bits; see nearest_patterns for more")
    combos = list(combinations(range(SEGMENTS), 2))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.where("bits is not null").select(F.col("bits").alias(name)).distinct().select(name, F.explode(_keys(name, 8, 64, SEGMENTS, 2)).alias("key"))

    def refined(d: DataFrame, name: str) -> DataFrame:
        left_bits = F.lit(None).cast("long")
        for c, chosen in enumerate(combos):
            rest, at = F.lit(0).cast("long"), 0
            for s in range(SEGMENTS):
                if s not in chosen:
                    rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned(name, 8 * s).bitwiseAND(F.lit(255)).cast("long"), at))
                    at += 8
            left_bits = F.when(F.shiftright("key", 16) == c, rest).otherwise(left_bits)
        return d.withColumn("left", left_bits).select(name, "key", F.explode(_keys("left", 6, 48, 8, 2)).alias("more"))

    near = hamming(F.col("e"), F.col("t")) <= most
    e, t = keyed(left, "e"), keyed(right, "t")
    hot = Workspace(left.sparkSession).table(e.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("key"))
    names = [F.col("e").alias("left_bits"), F.col("t").alias("right_bits")]
    if not hot.count():
        return e.hint("shuffle_hash").join(t, "key").where(near).select(*names).distinct()
    plain = e.join(hot, "key", "left_anti").join(t, "key").where(near).select("e", "t")
    dense = refined(e.join(hot, "key", "left_semi"), "e").join(refined(t.join(hot, "key", "left_semi"), "t"), ["key", "more"]).where(near).select("e", "t")
    return plain.unionByName(dense).distinct().select(*names)


def nearest_patterns(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_bits, best: for each distinct left pattern the least number of bits in which any right pattern differs.

    Both inputs: bits (long). Exact and complete at any distance. Blocks of left patterns meet chunks of right ones, each
    pair in a cell whose rows are hashed to one task (``nearest_of``); a cell holds at most about ``BLOCK`` and ``CHUNK``
    patterns, and only numbers of patterns come to the driver.
    """
    import pyarrow as pa

    ws = Workspace(left.sparkSession)
    own, other = (ws.table(d.where("bits is not null").select("bits").distinct()) for d in (left, right))
    n, chunks = own.count(), max(1, -(-other.count() // CHUNK))
    wanted = -(-2 * left.sparkSession.sparkContext.defaultParallelism // chunks)
    blocks = max(1, -(-n // BLOCK), min(-(-n // 4096), wanted))

    def among(parts: int):
        return F.pmod(F.xxhash64("bits"), F.lit(parts)).cast("int")

    def all_of(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def cells(df: DataFrame, block, chunk):
        return df.select("bits", block.alias("block"), chunk.alias("chunk")).select("bits", (F.col("block") * chunks + F.col("chunk")).alias("cell")).groupBy("cell")

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        a, b = (t.column("bits").to_numpy().view(np.uint64) for t in (mine, others))
        if not len(b):
            a = a[:0]
        return pa.table({"left_bits": a.view(np.int64), "best": nearest_of(a, b).astype(np.int32)})

    met = cells(own, among(blocks), all_of(chunks)).cogroup(cells(other, all_of(blocks), among(chunks))).applyInArrow(run, "left_bits long, best int")
    return met.groupBy("left_bits").agg(F.min("best").alias("best"))


@cache
def _shell(weight: int) -> np.ndarray:
    """The numbers of 16 bits of which ``weight`` are set."""
    x = np.arange(1 << 16, dtype=np.uint16)
    return x[np.bitwise_count(x) == weight]


def nearest_of(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each of ``mine`` (uint64) the least number of bits in which any of ``others`` differs; 65 without others.

    Method: multi-index search with growing reach. A pattern is four segments of 16 bits, and ``others`` are sorted by
    each. Round r looks up, by segment r % 4, all patterns whose segment differs in exactly r // 4 bits; after it, every
    pattern within r bits was met, since one that wasn't differs in more than r. So a pattern whose best is at most r + 1
    is settled. Where a round would cost more than comparing with all, the patterns left are compared with all.
    A look-up takes a window of neighbouring patterns; what a segment value holds beyond it is read in pieces.
    """
    best = np.full(len(mine), 65, np.uint8)
    if not len(mine) or not len(others):
        return best
    mean = len(others) / (1 << 16)
    width = min(len(others), 8 * int(-(-(mean + 2 * mean**0.5 + 1) // 8)))
    last, sides, todo = len(others) - width, {}, np.arange(len(mine))
    for reach in range(64):
        weight, s = divmod(reach, 4)
        masks, shift = _shell(weight), np.uint64(16 * s)
        if 2 * len(masks) * (width + 8) > len(others):
            break
        if s not in sides:
            part = (others >> shift).astype(np.uint16)
            held = others[np.argsort(part, kind="stable")]
            sides[s] = held, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << 16))]), np.lib.stride_tricks.sliding_window_view(held, width)
        held, first, windows = sides[s]
        todo = todo[np.argsort((mine[todo] >> shift).astype(np.uint16), kind="stable")]  # neighbours read the same places
        step = max(1, ROOM // (len(masks) * width))
        for a in range(0, len(todo), step):
            at = todo[a : a + step]
            q = mine[at]
            cell = ((q >> shift).astype(np.uint16)[:, None] ^ masks).astype(np.intp)
            lo, hi = first[cell], first[cell + 1]
            met = windows[np.minimum(lo, last)]
            met ^= q[:, None, None]
            low = np.bitwise_count(met).reshape(len(at), -1).min(axis=1)
            i, j = np.nonzero(hi - lo > width)
            lo, hi = lo[i, j] + width, hi[i, j]
            for k in np.flatnonzero(hi - lo > 16 * width):
                low[i[k]] = min(low[i[k]], np.bitwise_count(held[lo[k] : hi[k]] ^ q[i[k]]).min())
                lo[k] = hi[k]
            while (on := lo < hi).any():
                i, lo, hi = i[on], lo[on], hi[on]
                np.minimum.at(low, i, np.bitwise_count(windows[np.minimum(lo, last)] ^ q[i][:, None]).min(axis=1))
                lo = lo + width
            best[at] = np.minimum(best[at], low)
        todo = todo[best[todo] > reach + 1]
        if not len(todo):
            return best
    for a in range(0, len(todo), 64):
        at = todo[a : a + 64]
        for c in range(0, len(others), 1024):
            best[at] = np.minimum(best[at], np.bitwise_count(mine[at][:, None] ^ others[None, c : c + 1024]).min(axis=1))
    return best
