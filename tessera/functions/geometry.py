"""Box and landmark geometry as Column expressions.

Boxes are four double columns x1, y1, x2, y2 behind a prefix, landmarks a map from index to (x, y, v). A null in any
input gives null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import FRAME, MIN_VISIBILITY

#: Fixed landmark numbers.
SHOULDERS, WRISTS, HIPS, ANKLES = (11, 12), (15, 16), (23, 24), (27, 28)


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def w(self) -> Column:
        return self.x2 - self.x1

    @property
    def h(self) -> Column:
        return self.y2 - self.y1


def overlap_area(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    zero = F.lit(0.0)
    return F.greatest(w, zero) * F.greatest(h, zero)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the boxes do not meet or their union is empty."""
    inter = overlap_area(a, b)
    union = a.w * a.h + b.w * b.h - inter
    return F.when((inter > 0) & (union > 0), F.try_divide(inter, union)).otherwise(F.when(inter.isNotNull() & union.isNotNull(), F.lit(0.0)))


def clamped_area(b: Box) -> Column:
    """Area, at least 1."""
    return F.greatest(F.lit(1.0), b.w * b.h)


def iou_clamped(a: Box, b: Box) -> Column:
    """Intersection over union with both areas at least 1."""
    inter = overlap_area(a, b)
    return F.when(inter > 0, inter / (clamped_area(a) + clamped_area(b) - inter)).otherwise(F.when(inter.isNotNull(), F.lit(0.0)))


def containment(inner: Box, outer: Box) -> Column:
    """Share of ``inner`` that lies in ``outer``."""
    return overlap_area(inner, outer) / clamped_area(inner)


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def foot_point(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, b.y2


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def clipped(b: Box, width: int = FRAME.width, height: int = FRAME.height) -> Box:
    """The box with whole coordinates inside the frame."""
    low = lambda c: F.greatest(F.lit(0), c.cast("int"))
    return Box(low(b.x1), low(b.y1), F.least(F.lit(width), b.x2.cast("int")), F.least(F.lit(height), b.y2.cast("int")))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values))


def landmark(kp: Column, index: int, visibility: float = MIN_VISIBILITY) -> Column:
    """Landmark ``index`` where it is visible, else null."""
    p = F.try_element_at(kp, F.lit(index))
    return F.when(p["v"] >= visibility, p)


def visible_count(kp: Column, visibility: float = MIN_VISIBILITY) -> Column:
    """Number of visible landmarks; null, which means unknown, for a null or empty map."""
    return F.when(F.size(kp) > 0, F.size(F.filter(F.map_values(kp), lambda p: p["v"] >= visibility)))


def hull(kp: Column, visibility: float = MIN_VISIBILITY, least: int = 4) -> Column:
    """Struct x1, y1, x2, y2 around the visible landmarks; null for fewer than ``least``."""
    seen = F.filter(F.map_values(kp), lambda p: p["v"] >= visibility)
    xs, ys = F.transform(seen, lambda p: p["x"]), F.transform(seen, lambda p: p["y"])
    box = F.struct(*[c.cast("double").alias(n) for c, n in ((F.array_min(xs), "x1"), (F.array_min(ys), "y1"), (F.array_max(xs), "x2"), (F.array_max(ys), "y2"))])
    return F.when(F.size(seen) >= least, box)


def refined(b: Box, kp: Column, alpha: float = 0.3, least: float = 4.0) -> Column:
    """Struct of the box with left, right and lower edge drawn to the hull by ``alpha``.

    The upper edge stays, as no landmark lies above the eyes. Without a hull, or where a side would fall below
    ``least``, the box stays as it is.
    """
    hl = hull(kp)
    mix = lambda d, t: d * F.lit(1 - alpha) + t * F.lit(alpha)
    x1, x2, y2 = mix(b.x1, hl["x1"]), mix(b.x2, hl["x2"]), mix(b.y2, hl["y2"])
    ok = hl.isNotNull() & (x2 - x1 >= least) & (y2 - b.y1 >= least)
    pick = lambda new, old: F.when(ok, new).otherwise(old)
    return F.struct(pick(x1, b.x1).alias("x1"), b.y1.alias("y1"), pick(x2, b.x2).alias("x2"), pick(y2, b.y2).alias("y2"))


def torso_centre(kp: Column) -> Column:
    """Struct x, y: mean of the visible shoulders and hips; null for none."""
    pts = F.filter(F.array(*[landmark(kp, i) for i in (*SHOULDERS, *HIPS)]), lambda p: p.isNotNull())
    mean = lambda name: F.aggregate(pts, F.lit(0.0), lambda s, p: s + p[name]) / F.size(pts)
    return F.when(F.size(pts) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def body_ratios(kp: Column) -> Column:
    """Four proportions of a body, or null where shoulders or hips are not all visible or a length is nil.

    Shoulders to torso, hips to shoulders, mean leg to torso, span of the wrists to shoulders; a proportion that can't
    be measured is the mean of the others.
    """
    names = ("ls", "rs", "lh", "rh", "la", "ra", "lw", "rw")

    def points(k: Column) -> Column:
        return F.struct(*[landmark(k, i).alias(n) for n, i in zip(names, (*SHOULDERS, *HIPS, *ANKLES, *WRISTS))])

    def lengths(p: Column) -> Column:
        between = lambda a, b: F.hypot(p[a]["x"] - p[b]["x"], p[a]["y"] - p[b]["y"])
        mid = lambda a, b, n: (p[a][n] + p[b][n]) / 2
        torso = F.hypot(mid("ls", "rs", "x") - mid("lh", "rh", "x"), mid("ls", "rs", "y") - mid("lh", "rh", "y"))
        legs = F.filter(F.array(between("lh", "la"), between("rh", "ra")), lambda v: v.isNotNull())
        return F.struct(between("ls", "rs").alias("shoulders"), between("lh", "rh").alias("hips"), torso.alias("torso"), _mean(legs).alias("leg"), between("lw", "rw").alias("span"))

    def ratios(m: Column) -> Column:
        raw = F.array(F.try_divide(m["shoulders"], m["torso"]), F.try_divide(m["hips"], m["shoulders"]), F.try_divide(m["leg"], m["torso"]), F.try_divide(m["span"], m["shoulders"]))
        return F.when((m["shoulders"] >= 1e-3) & (m["torso"] >= 1e-3) & m["hips"].isNotNull(), raw)

    def filled(r: Column) -> Column:
        mean = _mean(F.filter(r, lambda v: v.isNotNull()))
        return F.transform(r, lambda v: F.coalesce(v, mean))

    return let(let(let(let(kp, points), lengths), ratios), filled)
