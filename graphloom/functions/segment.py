"""Temporal segments. Three length conventions exist side by side and keep their names:

inclusive length (x2 - x1 + 1) for offsets and IoU, plain length (end - start) for overlap with windows, and the decoder's
asymmetric ends. They are never shared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inclusive_length(x1: Column, x2: Column) -> Column:
    return x2 - x1 + 1


def center(x1: Column, x2: Column) -> Column:
    return x1 + inclusive_length(x1, x2) * 0.5


def encode(ex1: Column, ex2: Column, gt1: Column, gt2: Column) -> tuple[Column, Column]:
    """(dx, dl): offset of the centers in lengths, log of the lengths' ratio."""
    length = inclusive_length(ex1, ex2)
    return (center(gt1, gt2) - center(ex1, ex2)) / length, F.log(inclusive_length(gt1, gt2) / length)


def decode(x1: Column, x2: Column, dx: Column, dl: Column) -> tuple[Column, Column]:
    """Ends at center -/+ half the length; x2 comes back one higher than what was encoded."""
    length = inclusive_length(x1, x2)
    middle, new = dx * length + center(x1, x2), F.exp(dl) * length
    return middle - new * 0.5, middle + new * 0.5


def clip(x: Column, length: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), length - 1.0)


def normalize(x: Column, mean: float, std: float) -> Column:
    return (x - mean) / std


def denormalize(x: Column, mean: float, std: float) -> Column:
    return x * std + mean


def iou(a1: Column, a2: Column, g1: Column, g2: Column) -> Column:
    """Inclusive IoU; a ground truth of length 1 counts as padding (0), an anchor of length 1 as -1, which wins."""
    la, lg = inclusive_length(a1, a2), inclusive_length(g1, g2)
    inter = F.greatest(F.least(a2, g2) - F.greatest(a1, g1) + 1, F.lit(0))
    return F.when(la == 1, F.lit(-1.0)).when(lg == 1, F.lit(0.0)).otherwise(inter / (la + lg - inter))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Strict: touching segments don't overlap."""
    return (s1 < e2) & (e1 > s2)


def to_frames(seconds: Column, fps: float = 25.0) -> Column:
    return seconds * fps


def relative(x: Column, start: Column, stride: Column) -> Column:
    return (x - start) / stride
