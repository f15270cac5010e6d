"""Vector functions over array columns, computed in double inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of one length; null where either is null or a part is."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-8) -> Column:
    """The array at length 1; unchanged where its length is below ``least``."""
    n = norm(a)
    return F.when(n > least, F.transform(a, lambda v: v.cast("double") / n)).otherwise(F.transform(a, lambda v: v.cast("double")))


def cosine(a: Column, b: Column, least: float = 1e-8) -> Column:
    """Cosine, null where a side is null or shorter than ``least``: unknown, not unlike."""
    n, m = norm(a), norm(b)
    return F.when((n >= least) & (m >= least), dot(a, b) / (n * m))


def masked_similarity(a: Column, b: Column, valid: Column) -> Column:
    """Similarity that is 0 where the vector is not valid."""
    return F.when(F.coalesce(valid, F.lit(False)), dot(a, b)).otherwise(F.lit(0.0))


def identity_similarity(centroid_sim: Column, best_sample_sim: Column, weight: float = 0.9) -> Column:
    """The larger of the centroid's similarity and the weighted best sample's; 0 without samples."""
    return F.coalesce(F.greatest(centroid_sim, best_sample_sim * F.lit(weight)), F.lit(0.0))


def fused(appearance: Column, ratio: Column, weight: float = 0.15) -> Column:
    """Appearance mixed with the ratio similarity where that is known."""
    return F.when(ratio.isNotNull(), appearance * F.lit(1 - weight) + ratio * F.lit(weight)).otherwise(appearance)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def smoothed(values: Column, keep: float = 0.9) -> Column:
    """Exponential mean over an ordered array; the first value is the start."""
    step = lambda s, v: F.when(s.isNull(), v).otherwise(s * F.lit(keep) + v * F.lit(1 - keep))
    return F.aggregate(values, F.lit(None).cast("double"), step)


def gradient_hash(grey: Column, width: int = 8, height: int = 8) -> Column:
    """64 bits of a picture of ``width`` + 1 by ``height`` grey values, row by row: whether the next value is larger.

    The first comparison is the highest bit. Null where there are fewer values or one of them is null.
    """
    n = (width + 1) * height
    bits = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: (F.get(grey, i + F.floor(i / width).cast("int") + 1) > F.get(grey, i + F.floor(i / width).cast("int"))).cast("long"))
    hashed = F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    return F.when(F.size(F.filter(grey, lambda x: x.isNotNull())) >= n, hashed)
