"""Tuning values of the operators, one frozen group per concern.

The numbers are fixed values that results depend on; every operator takes them as parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Frame:
    width: int = 640
    height: int = 480


@dataclass(frozen=True)
class Admission:
    min_conf: float = 0.5
    min_height: float = 64
    border: float = 5
    min_aspect: float = 1.2
    min_keypoints: int = 5


@dataclass(frozen=True)
class Identity:
    match: float = 0.7327
    new: float = 0.5617
    margin: float = 0.0957
    veto: float = 0.6636
    sample_weight: float = 0.9
    ratio_weight: float = 0.15
    samples: int = 16
    ttl_s: float = 600.0
    sweep_every: int = 30
    capacity: int = 100
    defer: int = 30
    speed: float = 800.0
    jump: float = 200.0
    check_gap_s: float = 3.0
    ratio_keep: float = 0.9


@dataclass(frozen=True)
class Association:
    iou: float = 0.2
    containment: float = 0.3
    wrist_radius: float = 60.0


@dataclass(frozen=True)
class Verification:
    class_conf: dict[str, float] = field(default_factory=lambda: {"guns": 0.29, "knife": 0.23, "long_gun": 0.56})
    other_conf: float = 0.5
    persistence: int = 2
    same_iou: float = 0.25
    bypass_conf: float = 0.85
    forget_after: int = 2


@dataclass(frozen=True)
class Threat:
    base: dict[str, int] = field(default_factory=lambda: {"knife": 1, "guns": 2, "long_gun": 3})
    other: int = 1
    highest: int = 3
    calm_frames: int = 45
    approach_ratio: float = 1.5
    approach_window: int = 10


@dataclass(frozen=True)
class Tracking:
    confirm: int = 3
    patience: int = 5
    budget: int = 30
    unlike: float = 0.3735
    apart: float = 0.7
    gate: float = 9.4877
    place: float = 1 / 20
    speed: float = 1 / 160


FRAME, ADMISSION, IDENTITY, ASSOCIATION, VERIFICATION, THREAT = Frame(), Admission(), Identity(), Association(), Verification(), Threat()
TRACKING = Tracking()
MIN_VISIBILITY = 0.5
LEVEL_NAMES = {0: "SAFE", 1: "CAUTION", 2: "HIGH", 3: "CRITICAL"}
GAP_BUCKETS = (0, 30, 90, 300, 900)
