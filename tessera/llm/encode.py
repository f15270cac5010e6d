"""Problem 7: the corpus as token ids of a public tokenizer."""

from __future__ import annotations

import ast
import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
CACHE = 1 << 18
BLOCK = 1 << 22


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pattern_of(folder: str) -> str:
    """The pre-tokenizer's pattern, a constant in the module beside the vocabulary files; the module is not run."""
    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as f:
        tree = ast.parse(f.read())
    return next(ast.literal_eval(x.value) for x in tree.body if isinstance(x, ast.Assign) and getattr(x.targets[0], "id", "") == "PATTERN")


def certain_cuts(ranks: dict[bytes, int]) -> np.ndarray:
    """A table of 65,536 byte pairs, true where a cut between the two bytes is certain.

    Two things must hold. No token contains the pair, so no merge can ever reach across it. And the pre-tokenizer must
    part the two characters whatever surrounds them, so that the pattern finds the same pieces on either side: a
    visible ASCII character before a space or line break, a letter before anything but a letter, a digit before
    anything but a digit. Bytes of longer characters never take part.
    """
    inside = np.zeros(1 << 16, bool)
    for token in ranks:
        b = np.frombuffer(token, np.uint8).astype(np.int64)
        inside[b[:-1] * 256 + b[1:]] = True
    code = np.arange(256)
    ascii_ = code < 128
    letter = ((code | 32) >= ord("a")) & ((code | 32) <= ord("z")) & ascii_
    digit = (code >= ord("0")) & (code <= ord("9"))
    visible, blank = (code > 32) & (code < 127), (code == 32) | (code == 10)
    parts = visible[:, None] & blank[None, :]
    other = visible & ~letter & ~digit
    parts |= letter[:, None] & (digit | other | blank)[None, :]
    parts |= digit[:, None] & (letter | other | blank)[None, :]
    return parts.reshape(-1) & ~inside


class Encoder:
    """Splits bytes at certain cuts and encodes the fragments one by one, each distinct fragment once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.cuts = certain_cuts(ranks)
        self.bpe = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, tuple[int, ...]] = {}

    def fragment(self, piece: bytes) -> tuple[int, ...]:
        ids = tuple(self.bpe.encode_ordinary(piece.decode("utf-8")))
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[piece] = ids
        return ids

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        inner = [np.zeros(0, np.int64)]
        for at in range(0, len(data) - 1, BLOCK):
            part = data[at : at + BLOCK + 1].astype(np.int32)
            inner.append(np.flatnonzero(self.cuts[part[:-1] * 256 + part[1:]]) + at + 1)
        ends = np.unique(np.concatenate([*inner, offsets]))
        raw, known, fragment = data.tobytes(), self.known, self.fragment
        bounds = ends.tolist()
        found = []
        for a, z in zip(bounds, bounds[1:]):
            piece = raw[a:z]
            ids = known.get(piece)
            found.append(fragment(piece) if ids is None else ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(upto[-1]))
        return flat, upto[np.searchsorted(ends, offsets)]


@lru_cache(maxsize=2)
def _encoder(folder: str, name: str) -> Encoder:
    """One per Python worker, which serves many tasks."""
    return Encoder(read_ranks(os.path.join(folder, f"{name}.tiktoken")), pattern_of(folder))


def encode_corpus(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``key`` and ids (array<int>) of each row's text by ``name``, without special tokens.

    A null or empty text has an empty array. Strings that look like special tokens are ordinary text. Repeated rows
    stay, each with its ids; an empty table gives no row; other columns are not read.

    Method: forced-boundary splitting, see :func:`certain_cuts`; the ids of a text are those of its fragments in a
    row. Texts go through Arrow batches in place, without a shuffle. ``folder`` must be readable on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(folder, name)
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            # Rows go in turns of about BLOCK bytes, so that memory follows the longest text and not the batch.
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
                flat, starts = encoder.batch(whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                ids = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), ids], ["key", "ids"])
                first = last

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
