"""Voxels in long form (id, z, y, x, val): coordinates are rewritten, values are never gathered into arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def window_clip(v: Column, low: float = -1024.0, high: float = 400.0) -> Column:
    """Intensities scaled to 0..255, rounded half to even."""
    return F.bround(F.least(F.greatest((v - low) / (high - low) * 255.0, F.lit(0.0)), F.lit(255.0)))


def mask(voxels: DataFrame, segmentation: DataFrame, key: tuple[str, ...] = ("id", *AXES)) -> DataFrame:
    """Values times those of the segmentation. Both sides are as large as all voxels, however small the files they are
    made from, so the join is a merge and never sends one through the driver."""
    seg = segmentation.select(*key, F.col("val").alias("_seg")).hint("merge")
    return voxels.join(seg, list(key)).withColumn("val", F.col("val") * F.col("_seg")).drop("_seg")


def crop(voxels: DataFrame, center: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """[c - n // 2, c + n // 2) on each axis, counted from 0 again."""
    out = voxels
    for axis, c, n in zip(AXES, center, size, strict=True):
        out = out.where((F.col(axis) >= c - n // 2) & (F.col(axis) < c + n // 2)).withColumn(axis, F.col(axis) - (c - n // 2))
    return out


def crop_padded(voxels: DataFrame, center: tuple[int, int, int], size: tuple[int, int, int], fill: float = 0.0) -> DataFrame:
    """As crop, with `fill` where the volume has no voxel: the full target grid of every id, joined to the left."""
    grid = voxels.select("id").distinct()
    for axis, n in zip(AXES, size, strict=True):
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keys = ["id", *AXES]
    have = crop(voxels, center, size).select("id", *(F.col(a).cast("int").alias(a) for a in AXES), "val")
    return grid.join(have, keys, "left").withColumn("val", F.coalesce("val", F.lit(fill)))


def rotate(voxels: DataFrame, plane: tuple[str, str], turns: int, size: int) -> DataFrame:
    """Quarter turns in a plane: (a, b) becomes (size - 1 - b, a) for each."""
    out = voxels
    for _ in range(turns % 4):
        a, b = plane
        out = out.withColumns({a: F.lit(size - 1) - F.col(b), b: F.col(a)})
    return out


def reorder(voxels: DataFrame, order: tuple[int, int, int]) -> DataFrame:
    """Axis k of the result is axis order[k] of the input."""
    return voxels.withColumns({AXES[k]: F.col(AXES[o]) for k, o in enumerate(order)})


def reflect(voxels: DataFrame, axis: str, size: int) -> DataFrame:
    return voxels.withColumn(axis, F.lit(size - 1) - F.col(axis))


def mirror(voxels: DataFrame, axis: str, size: int, symmetrize: bool = True) -> DataFrame:
    """A true flip, or with symmetrize the first half replaced by the mirror image of the second, which stays."""
    if not symmetrize:
        return reflect(voxels, axis, size)
    second = voxels.where(F.col(axis) >= size - size // 2)
    middle = voxels.where((F.col(axis) >= size // 2) & (F.col(axis) < size - size // 2))
    return reflect(second, axis, size).unionByName(second).unionByName(middle)


def resample_nearest(voxels: DataFrame, size: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """Volumes of another size, every target voxel from the nearest source voxel; splines aren't offered.

    A source voxel is repeated at the targets that it is nearest to, which the sizes alone tell, so nothing is joined.
    """
    out = voxels.where("id IS NOT NULL").select("id", *(F.col(a).cast("long").alias(a) for a in AXES), "val")
    for axis, n, m in zip(AXES, size, new, strict=True):
        targets = [[] for _ in range(n)]
        for k in range(m):
            targets[min(math.floor((k + 0.5) * n / m), n - 1)].append(k)
        table = F.array(*(F.array(*map(F.lit, t)).cast("array<long>") for t in targets))
        at = F.when(F.col(axis).between(0, n - 1), F.col(axis)).cast("int")
        out = out.withColumn(f"_{axis}", F.explode(F.get(table, at)))
    return out.select("id", *(F.col(f"_{a}").alias(a) for a in AXES), "val")


def with_channel(shape: Column, at: int = 0) -> Column:
    """A shape with a dimension of 1 put in; the values of a long volume don't change."""
    return F.concat(F.slice(shape, 1, at), F.array(F.lit(1)), F.slice(shape, at + 1, F.size(shape)))
