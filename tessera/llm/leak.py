"""Problem 8: passages of evaluation texts in the training corpus."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.canonical import LOOKALIKES
from tessera.llm.workspace import Workspace

SHINGLE = 5
#: Words of a section, and words that it shares with the next one.
SECTION, SHARED = 1024, 256
#: Bits of the filter of item seeds, which bounds what is broadcast: 8 MB, whatever the number of items.
FILTER_BITS = 26
#: Distinct words whose hashes a worker remembers.
CACHE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

_POINT = re.compile(r"[.,](?<=\d.)(?=\d)")
_HYPHEN = re.compile(r"-(?:[ \t]*\r?\n[>|# \t]*|(?<=\w-)(?=\w))")
_MARKS = dict.fromkeys(map(ord, "'*_~`"))
_ACCENT = re.compile(f"[{chr(0x300)}-{chr(0x36F)}]+")
_TAG = re.compile(r"<[^<>]{1,200}>")
_NOTE = re.compile(r"\[\^?\w{1,4}\]|\]\([^()\s]*\)")
_WORD = re.compile(r"\w+")


def _look_table() -> dict[int, str]:
    table = {ord(c): plain for plain, alike in LOOKALIKES.items() for c in alike}
    superscript = chain((0xB2, 0xB3, 0xB9, 0x2070), range(0x2074, 0x207A), range(0x2080, 0x208A), (0x2020, 0x2021, 0xAA, 0xBA))
    table |= dict.fromkeys(superscript, " ")
    return table | dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF), "") | dict.fromkeys((0x2018, 0x2019, 0x201B, 0x2BC, 0xB4), "'") | dict.fromkeys((0x2010, 0x2011), "-")


_LOOK = _look_table()


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, markup, footnote and quotation marks and the look of letters.

    Numbers keep their digits only, words joined by a hyphen or an apostrophe are one word, and a word parted at the end
    of a line is whole again.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_LOOK)).lower().translate(_LOOK)
        if not text.isascii():
            text = _ACCENT.sub("", unicodedata.normalize("NFD", text))
    else:
        text = text.lower()
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _NOTE.sub(" ", text)
    text = _POINT.sub("", text.translate(_MARKS))
    return _WORD.findall(_HYPHEN.sub("", text) if "-" in text else text)


class Words:
    """Words as 64-bit hashes; frequent words are hashed once per worker."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in words_of(text):
            h = known.get(w)
            if h is None:
                if len(known) >= CACHE:
                    known.clear()
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return out


def powers(n: int) -> np.ndarray:
    """Powers 0 to ``n`` of the base."""
    out = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _BASE), out=out[1:])
    return out


_POWERS = powers(SECTION)


class Rolling:
    """Karp-Rabin hashes of all windows of any length, by one subtraction and one product each.

    Hashes are comparable between texts that were given the same ``power``, the powers of the base up to the longer one.
    """

    def __init__(self, words: np.ndarray, power: np.ndarray):
        self.words = words
        self.upto = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=self.upto[1:])
        # The sum of a window begins with the power of its place; times what is missing, places make no difference.
        self.shift = power[::-1]

    def windows(self, n: int) -> np.ndarray:
        m = max(0, len(self.words) - n + 1)
        return (self.upto[n : n + m] - self.upto[:m]) * self.shift[:m] if m else np.zeros(0, np.uint64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, doc start, length) of the longest matches that share no word, longest first.

    Running Karp-Rabin: in each round the longest length at which unmarked windows of both agree is found by halving,
    with window hashes that cost the same at every length; all such matches are marked in the item's order, first come
    first served, each compared word by word, and the next round looks at what is unmarked.
    """
    power = _POWERS if max(len(doc), len(item)) <= SECTION else powers(max(len(doc), len(item)))
    d, i = Rolling(doc, power), Rolling(item, power)
    used_d, used_i = np.zeros(len(doc) + 1, np.int64), np.zeros(len(item) + 1, np.int64)
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []

    def open_windows(r: Rolling, used: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        h = r.windows(n)
        at = np.flatnonzero(used[n : n + len(h)] == used[: len(h)])
        return h[at], at

    def agree(n: int) -> bool:
        return bool(np.isin(open_windows(i, used_i, n)[0], open_windows(d, used_d, n)[0]).any())

    high = min(len(doc), len(item))
    while high >= least and agree(least):
        low, top = least, high
        while low < top:
            n = (low + top + 1) // 2
            low, top = (n, top) if agree(n) else (low, n - 1)
        hi, at_i = open_windows(i, used_i, low)
        hd, at_d = open_windows(d, used_d, low)
        order = np.argsort(hd, kind="stable")
        hd, at_d = hd[order], at_d[order]
        marked = False
        for h, a in zip(hi, at_i.tolist()):
            if not free_i[a : a + low].all():
                continue
            for k in range(int(np.searchsorted(hd, h, "left")), int(np.searchsorted(hd, h, "right"))):
                b = int(at_d[k])
                if free_d[b : b + low].all() and (doc[b : b + low] == item[a : a + low]).all():
                    free_i[a : a + low] = free_d[b : b + low] = False
                    out.append((a, b, low))
                    marked = True
                    break
        if not marked:
            return out
        np.cumsum(~free_i, out=used_i[1:])
        np.cumsum(~free_d, out=used_d[1:])
        high = low
    return out


def longest_passage(doc: list[int], item: list[int], min_words: int, one_in: int, diagonals: list[int]) -> int:
    """Words of the longest stretch of the item that the document holds in order with one edit in ``one_in`` words.

    The stretch begins and ends with words that are there; 0 if none reaches ``min_words``. It is looked for on the
    ``diagonals`` (place in the document less place in the item) and as far beside them as edits can lead. The fewest edits are found for each place and diagonal, so
    other copies of the item's words take nothing away.
    """
    n, reach = len(item), len(item) // one_in
    most = 0
    bands: list[list[int]] = []
    for g in sorted(set(diagonals)):
        if bands and g - reach <= bands[-1][1] + 1:
            bands[-1][1] = g + reach
        else:
            bands.append([g - reach, g + reach])
    words = np.array(item, np.int64)
    for lo, hi in bands:
        width = hi - lo + 1
        wide = np.full(n + width - 1, -1, np.int64)
        a, z = max(0, lo), min(len(doc), hi + n)
        if z <= a:
            continue
        wide[a - lo : z - lo] = doc[a:z]
        same = np.lib.stride_tricks.sliding_window_view(wide, width) == words[:, None]
        starts = same.copy()
        starts[1:] &= ~same[:-1]
        step, far = np.arange(width), n + width
        for i0 in np.flatnonzero(starts.any(axis=1)).tolist():
            if n - i0 <= max(most, min_words - 1):
                break
            # Fewest edits by which item words i0 to i - 1 lead to diagonal lo + k from any start in item word i0.
            edits = np.where(starts[i0], 0, far)
            for i in range(i0, n):
                ends = edits[same[i]]
                w = i + 1 - i0
                if w > most and w >= min_words and len(ends) and ends.min() * one_in <= w:
                    most = w
                # The item's word agrees, is exchanged or is left out; then words of the document are added.
                after = edits + ~same[i]
                after[:-1] = np.minimum(after[:-1], edits[1:] + 1)
                edits = np.minimum.accumulate(after - step) + step
                if edits.min() * one_in > n - i0:
                    break
    return most


def seeded_diagonals(at_item: np.ndarray, at_doc: np.ndarray, item_words: int, min_words: int, one_in: int) -> Iterator[int]:
    """Diagonals on which, by the seeds (shingle starts) alone, a passage may begin.

    A stretch of w words with at most w / one_in edits keeps w - SHINGLE * (w // one_in) - SHINGLE + 1 whole shingles,
    and all of them lie on diagonals no farther apart than its edits.
    """
    order = np.lexsort((at_doc, at_item))
    item, diagonal = at_item[order].tolist(), (at_doc - at_item)[order].tolist()
    reach, told = item_words // one_in, set()
    for a in range(len(item)):
        if diagonal[a] in told:
            continue
        n, before = 0, -1
        for b in range(a, len(item)):
            if abs(diagonal[b] - diagonal[a]) > reach or item[b] == before:
                continue
            n, before = n + 1, item[b]
            w = max(min_words, item[b] - item[a] + SHINGLE)
            if n >= w - SHINGLE * (w // one_in) - SHINGLE + 1:
                told.add(diagonal[a])
                yield diagonal[a]
                break


def enough_words(doc: np.ndarray, item: np.ndarray, diagonal: int, min_words: int, one_in: int) -> bool:
    """Whether enough of some stretch's words stand near their place in the document, in whatever order."""
    n, reach = len(item), len(item) // one_in
    wide = np.zeros(n + 2 * reach, doc.dtype)
    lo = diagonal - reach
    a, z = max(0, lo), min(len(doc), lo + len(wide))
    if z <= a:
        return False
    wide[a - lo : z - lo] = doc[a:z]
    near = (np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1) == item[:, None]).any(axis=1)
    if n < min_words:
        return False
    # A word counts 1, a missing one 1 - one_in: a stretch is good if its sum is not negative.
    upto = np.concatenate([[0], np.cumsum(np.where(near, 1, 1 - one_in))])
    return bool((np.minimum.accumulate(upto[: n + 1 - min_words]) <= upto[min_words:]).any())


def compare(doc: np.ndarray, item: np.ndarray, min_words: int, one_in: int, tile: int | None) -> tuple[int, list[int]]:
    """Words of the longest passage (0 if there is none), and the places of the item's words that lie in tiles of
    ``tile`` words or more (none are looked for without it)."""
    hd, hi = seeds_of(doc), seeds_of(item)
    order = np.argsort(hi, kind="stable")
    lo, up = np.searchsorted(hi[order], hd, "left"), np.searchsorted(hi[order], hd, "right")
    n = up - lo
    at_doc = np.repeat(np.arange(len(hd)), n)
    at_item = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if n.sum() else np.zeros(0, np.int64)
    good = [g for g in seeded_diagonals(at_item, at_doc, len(item), min_words, one_in) if enough_words(doc, item, g, min_words, one_in)]
    most = longest_passage(doc.astype(np.int64), item.astype(np.int64), min_words, one_in, good) if good else 0
    return most, [a + x for a, _, m in tiles(doc, item, tile) for x in range(m)] if tile else []


def needed_seeds(min_words: int, one_in: int) -> int:
    """Of w words with w // one_in edits at least w - SHINGLE * edits - SHINGLE + 1 shingles stay whole."""
    return max(1, min(w - SHINGLE * (w // one_in) - SHINGLE + 1 for w in range(min_words, 4 * min_words)))


def sections(words: list[int]) -> list[tuple[int, np.ndarray]]:
    """Start and words of the sections of a text."""
    all_ = np.array(words, np.uint64)
    return [(a, all_[a : a + SECTION]) for a in range(0, max(1, len(all_) - SHARED), SECTION - SHARED)]


def seeds_of(words: np.ndarray) -> np.ndarray:
    h = Rolling(words, _POWERS).windows(SHINGLE)
    return h ^ (h >> np.uint64(29))


def item_sections(items: DataFrame) -> DataFrame:
    """item_id, item_at, item_words (of the whole item), words, seeds: a row per section of each distinct item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            of, at, total, rows, seeds = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                w = words.of(text)
                for a, part in sections(w):
                    of.append(k)
                    at.append(a)
                    total.append(len(w))
                    rows.append(part.view(np.int64))
                    seeds.append(np.unique(seeds_of(part)).view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (rows, seeds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(at, pa.int32()), pa.array(total, pa.int32()), *lists], ["item_id", "item_at", "item_words", "words", "seeds"])

    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, item_at int, item_words int, words array<long>, seeds array<long>")


def seed_filter(item_rows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit per hash value of the items' seeds; at most 2^``bits`` / 64 words come to the driver."""
    got = item_rows.select(F.explode("seeds").alias("s")).select(F.shiftrightunsigned("s", 64 - bits).alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).collect()
    out = np.zeros(1 << max(0, bits - 6), np.uint64)
    for r in got:
        out[r["w"]] = r["b"] & 0xFFFFFFFFFFFFFFFF
    return out


def seeded_sections(docs: DataFrame, item_filter: np.ndarray, need: int, span: int, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, text_hash, at, words, seeds, times: the sections of the documents in which ``need`` seeds of the filter
    stand within ``span`` words, with the seeds that do and how often."""
    sent = docs.sparkSession.sparkContext.broadcast(item_filter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), sent.value
        for b in batches:
            of, at, rows, seeds, times = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for a, part in sections(words.of(text)):
                    h = seeds_of(part)
                    g = h >> np.uint64(64 - bits)
                    hit = np.flatnonzero(known[(g >> np.uint64(6)).astype(np.int64)] >> (g & np.uint64(63)) & np.uint64(1))
                    if len(hit) < need:
                        continue
                    close = np.flatnonzero(hit[need - 1 :] - hit[: len(hit) - need + 1] < span)
                    if not len(close):
                        continue
                    mine = np.zeros(len(hit) + 1, np.int64)
                    np.add.at(mine, close, 1)
                    np.add.at(mine, close + need, -1)
                    x, n = np.unique(h[hit[np.cumsum(mine)[:-1] > 0]], return_counts=True)
                    of.append(k)
                    at.append(a)
                    rows.append(part.view(np.int64))
                    seeds.append(x.view(np.int64))
                    times.append(n)
            lists = [pa.array(x, pa.list_(t)) for x, t in ((rows, pa.int64()), (seeds, pa.int64()), (times, pa.int32()))]
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array(at, pa.int32()), *lists], ["doc_id", "text_hash", "at", "words", "seeds", "times"])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, at int, words array<long>, seeds array<long>, times array<int>")


def verified(pairs: DataFrame, min_words: int, one_in: int, tile: int) -> DataFrame:
    """doc_id, text_hash, item_id, item_words, words, covered of pairs of sections that share a passage or a tile; tiles
    are looked for where ``tiled``."""
    names = ["doc_id", "text_hash", "item_id", "item_words", "words", "covered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, most, places = [], [], []
            start, tiled = b.column(4).to_pylist(), b.column(5).to_pylist()
            d, i = (([0, *np.cumsum(c.value_lengths()).tolist()], c.flatten().to_numpy().view(np.uint64)) for c in (b.column(6), b.column(7)))
            for k in range(b.num_rows):
                n, covered = compare(d[1][d[0][k] : d[0][k + 1]], i[1][i[0][k] : i[0][k + 1]], min_words, one_in, tile if tiled[k] else None)
                if n or covered:
                    keep.append(k)
                    most.append(n)
                    places.append([start[k] + x for x in covered])
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c).take(take) for c in range(4)] + [pa.array(most, pa.int32()), pa.array(places, pa.list_(pa.int32()))], names)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    rows = pairs.select("doc_id", "text_hash", "item_id", "item_words", "item_at", "tiled", "doc_part", "item_part")
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, text_hash long, item_id {kinds['item_id']}, item_words int, words int, covered array<int>")


def leaked(docs: DataFrame, items: DataFrame, min_words: int = 25, one_in: int = 8, coverage: float = 0.5, ws: Workspace | None = None) -> DataFrame:
    """doc_id, item_id, words, covered, item_words: documents that give an item away, once per pair.

    ``words`` is the longest passage of ``min_words`` or more consecutive words of the item of which one in ``one_in``
    may be exchanged, added or left out, 0 if there is none; ``covered`` counts the item's words that stand in the
    document in tiles of ten words or more (for the defaults), in whatever order, and is 0 where the seeds show that it
    can't be enough. A pair is a leak if it has a
    passage, or if ``covered`` reaches ``min_words`` and ``coverage`` of the item, which finds items whose parts were
    moved. ``docs``: doc_id, text. ``items``: item_id, text. Null ids and null and empty texts hold nothing; an item of
    fewer words can't leak; repeated rows count once, different texts under one id count together; either table may be
    empty. :func:`words_of` says what makes no difference. A passage longer than the ``SHARED`` words of neighbouring
    sections may be told by a part of it.

    Method: seed join and greedy string tiling. The corpus is read once, however many items there are: a filter of fixed
    size with the five-word seeds of all items keeps the sections of documents that have as many seeds close together as
    a passage must leave whole (the count lemma), which are as many as a tile has. Their distinct seeds are joined with
    the items' by hash; a standing phrase of fewer words than a tile has too few seeds to get there, and a hot seed is
    split by the skew join. Pairs of sections with enough seeds are tiled by running Karp-Rabin, and aligned word by
    word beside their seeded diagonals, so that the edits within a passage don't break it up.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark)
    need = needed_seeds(min_words, one_in)
    # Any w words of a passage with its edits have `need` seeds within this span: short ones lie in it as a whole, and
    # of longer ones some part of it has its share, as whole shingles grow faster than `need` per span.
    span = 2 * (min_words + min_words // one_in + SHINGLE)
    own = ws.table(item_sections(items))
    rows = ws.table(seeded_sections(docs, seed_filter(own), need, span))
    seeds = rows.select("doc_id", "text_hash", "at", F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("doc_id", "text_hash", "at", "s.seeds", "s.times").distinct()
    met = seeds.join(own.select("item_id", "item_at", F.explode("seeds").alias("seeds")), "seeds")
    pairs = met.groupBy("doc_id", "text_hash", "at", "item_id", "item_at").agg(F.sum("times").alias("n")).where(F.col("n") >= need)
    pairs = pairs.withColumn("n", F.sum("n").over(Window.partitionBy("doc_id", "text_hash", "item_id")))
    parts = rows.select("doc_id", "text_hash", "at", F.col("words").alias("doc_part")).dropDuplicates(["doc_id", "text_hash", "at"])
    pairs = pairs.join(parts, ["doc_id", "text_hash", "at"]).join(own.select("item_id", "item_at", "item_words", F.col("words").alias("item_part")), ["item_id", "item_at"])
    # A tile of m words has m - SHINGLE + 1 seeds, so fewer seeds than this can't cover enough.
    tile = need + SHINGLE - 1
    pairs = pairs.withColumn("tiled", F.col("n") * tile >= need * F.greatest(F.lit(min_words), F.lit(coverage) * F.col("item_words")))
    told = verified(pairs.repartition(4 * spark.sparkContext.defaultParallelism), min_words, one_in, tile)
    per = told.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"), F.max("item_words").alias("item_words"))
    return per.where((F.col("words") > 0) | ((F.col("covered") >= min_words) & (F.col("covered") >= coverage * F.col("item_words"))))
