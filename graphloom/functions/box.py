"""Boxes with inclusive corners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return x, y, x + w - 1, y + h - 1


def xyxy_to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    return x1, y1, x2 - x1 + 1, y2 - y1 + 1


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1 + 1) * (y2 - y1 + 1)


def flip(x1: Column, x2: Column, width: Column) -> tuple[Column, Column]:
    return width - x2 - 1, width - x1 - 1


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of two (x1, y1, x2, y2)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1, F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1, F.lit(0))
    inter = w * h
    return inter / (area(*a) + area(*b) - inter)


def key(x1: Column, y1: Column, x2: Column, y2: Column, scale: float = 1.0) -> Column:
    """Hash of the rounded corners with the fixed weights 1, 1e3, 1e6 and 1e9; corners of 1000 and more can collide."""
    r = [F.bround(c * scale) for c in (x1, y1, x2, y2)]
    return r[0] + r[1] * 1e3 + r[2] * 1e6 + r[3] * 1e9


def big_enough(x1: Column, y1: Column, x2: Column, y2: Column, least: float) -> Column:
    """At least `least` wide, but more than that high."""
    return (x2 - x1 + 1 >= least) & (y2 - y1 + 1 > least)


def invalid(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Why a box is invalid, else null."""
    return (
        F.when(x1 < 0, F.lit("x1<0")).when(y1 < 0, F.lit("y1<0")).when(x2 < x1, F.lit("x2<x1")).when(y2 < y1, F.lit("y2<y1")).when(x2 >= width, F.lit("x2>=width")).when(y2 >= height, F.lit("y2>=height"))
    )


def zero_padded_path(prefix: str, number: Column, digits: int = 12, suffix: str = ".jpg") -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), digits, "0"), F.lit(suffix))
