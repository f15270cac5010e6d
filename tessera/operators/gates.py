"""Row predicates and labels: each takes Columns and gives one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import ADMISSION, ASSOCIATION, FRAME, VERIFICATION, Admission, Verification
from tessera.functions.geometry import HIPS, SHOULDERS, WRISTS, Box, centre, clipped, distance, landmark

__all__ = ["HIPS", "person_box", "weapon_shape", "embeddable", "admission_reason", "touches_border", "render_decision", "class_conf_ok", "arm_raised", "track_colour", "near_points", "near_wrist", "time_holdout", "under_delivered", "vetoed", "expired"]


def person_box(b: Box, cls: Column, conf: Column, least_conf: float = 0.3) -> Column:
    """Boxes of class 0 wider and higher than one pixel with enough confidence."""
    return (cls == 0) & (conf >= least_conf) & (b.w > 1) & (b.h > 1)


def weapon_shape(b: Box, label: Column, least: float = 20, knife_aspect: float = 1.5) -> Column:
    """Boxes large enough, and, for a knife, elongated enough."""
    aspect = F.greatest(b.w, b.h) / F.greatest(F.least(b.w, b.h), F.lit(1.0))
    return (b.w >= least) & (b.h >= least) & ((label != "knife") | (aspect >= knife_aspect))


def embeddable(b: Box, min_w: int = 8, min_h: int = 16, width: int = FRAME.width, height: int = FRAME.height) -> Column:
    """Boxes whose part inside the frame is large enough for an embedding."""
    c = clipped(b, width, height)
    return (c.w >= min_w) & (c.h >= min_h)


def admission_reason(
    b: Box, conf: Column, matched: Column, kp_count: Column, valid: Column, frame_w: int = FRAME.width, frame_h: int = FRAME.height, p: Admission = ADMISSION,
) -> Column:
    """The first reason why a crop may not be stored, or ``ok``.

    Only a false ``matched`` rejects, not an unknown one; the number of landmarks counts only where it is known.
    """
    clipped_v = (b.y1 <= p.border) | (b.y2 >= frame_h - p.border)
    return (
        F.when(~F.coalesce(valid, F.lit(False)), "invalid_embedding")
        .when(~F.coalesce(matched, F.lit(True)), "not_matched")
        .when(conf < p.min_conf, "low_confidence")
        .when(b.h < p.min_height, "crop_too_small")
        .when((b.x1 <= p.border) | (b.x2 >= frame_w - p.border), "side_truncated")
        .when(clipped_v & (b.h / F.greatest(b.w, F.lit(1.0)) < p.min_aspect), "clipped_and_implausible_shape")
        .when(kp_count < p.min_keypoints, "insufficient_keypoints")
        .otherwise("ok")
    )


def touches_border(b: Box, margin: float = 15, width: int = FRAME.width, height: int = FRAME.height) -> Column:
    return (b.x1 <= margin) | (b.y1 <= margin) | (b.x2 >= width - margin) | (b.y2 >= height - margin)


def render_decision(matched: Column, since_update: Column, border: Column, kp_count: Column, coast: int = 2, least_kp: int = 5) -> Column:
    """Struct render, coasting for a track: what is drawn, and whether as a prediction."""
    out = lambda r, c: F.struct(r.alias("render"), F.lit(c).alias("coasting"))
    return (
        F.when(matched, out(F.lit(True), False))
        .when(since_update > coast, out(F.lit(False), False))
        .when(border, out(F.lit(False), False))
        .when(kp_count.isNull(), out(since_update <= 1, True))
        .otherwise(out(kp_count >= least_kp, True))
    )


def class_conf_ok(label: Column, conf: Column, p: Verification = VERIFICATION) -> Column:
    """Confidence of at least the label's own gate."""
    gate = F.lit(p.other_conf)
    for name, least in p.class_conf.items():
        gate = F.when(label == name, F.lit(least)).otherwise(gate)
    return conf >= gate


def arm_raised(kp: Column) -> Column:
    """A visible wrist above the visible shoulder of its side."""
    sides = [landmark(kp, w)["y"] < landmark(kp, s)["y"] for s, w in zip(SHOULDERS, WRISTS)]
    return F.coalesce(sides[0], F.lit(False)) | F.coalesce(sides[1], F.lit(False))


def track_colour(provisional: Column, coasting: Column, level: Column) -> Column:
    """Status a track is drawn in; a level above 0 goes before all others."""
    return F.when(level > 0, F.concat(F.lit("level_"), level.cast("string"))).when(provisional, "provisional").when(coasting, "coasting").otherwise("tracked")


def near_wrist(b: Box, kp: Column, radius: float = ASSOCIATION.wrist_radius) -> Column:
    """The box's centre within ``radius`` of a visible wrist."""
    return near_points(b, [(landmark(kp, i)["x"], landmark(kp, i)["y"]) for i in WRISTS], radius)


def near_points(b: Box, points: list[tuple[Column, Column]], radius: float) -> Column:
    """The box's centre within ``radius`` of any of ``points``; a null point is near nothing."""
    cx, cy = centre(b)
    near = F.lit(False)
    for x, y in points:
        near = near | F.coalesce(distance(cx, cy, x, y) <= radius, F.lit(False))
    return near


def time_holdout(df: DataFrame, group: str, order: str, first_share: float = 0.7) -> DataFrame:
    """The rows of each group after its first ``first_share`` in time."""
    w = Window.partitionBy(group).orderBy(order)
    n = F.count("*").over(Window.partitionBy(group))
    return df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n).where(F.col("_i") >= F.floor(F.col("_n") * F.lit(first_share))).drop("_i", "_n")


def under_delivered(frames: Column, seconds: Column, requested_fps: Column, share: float = 0.5) -> Column:
    """A capture that reached less than ``share`` of the requested rate."""
    return F.coalesce(F.try_divide(frames, seconds), F.lit(0.0)) < requested_fps * F.lit(share)


def vetoed(similarity: Column, gap: Column, least: float = 0.6636, from_gap: int = 2) -> Column:
    """A track that comes back after a gap and does not look like the identity it holds."""
    return (gap >= from_gap) & (similarity < least)


def expired(active: Column, last_seen: Column, now: Column, ttl: float = 600.0) -> Column:
    """An identity that no live track holds and that was last seen too long ago."""
    return ~active & (now - last_seen > ttl)
