"""Validators that return violations instead of raising; `require` raises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import box


def vector_report(points: DataFrame, column: str = "v") -> DataFrame:
    """rows, widths (distinct lengths), nulls, not_finite: one row, by partial sums."""
    v = F.col(column)
    bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return points.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.size(v)).alias("widths"), F.sum(v.isNull().cast("long")).alias("nulls"), F.sum(bad.cast("long")).alias("not_finite"))


def bad_boxes(boxes: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    why = box.invalid(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col(width), F.col(height))
    return boxes.withColumn("reason", why).where("reason is not null")


def bad_edges(edges: DataFrame) -> DataFrame:
    return edges.where("w <= 0 or w is null")


def bad_segments(segments: DataFrame) -> DataFrame:
    return segments.where("e <= s")


def bad_centers(centers: DataFrame, points: DataFrame) -> DataFrame:
    """k, width, wanted: centers that aren't as long as the points, or not there; the points' width is the longest's."""
    wanted = points.agg(F.max(F.size("v")).alias("wanted"))
    return centers.select("k", F.size("c").alias("width")).join(F.broadcast(wanted)).where("width <> wanted")


def complaints(spark: SparkSession, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """case, complaint: what each case raises as a ValueError, null where it is content."""
    rows = []
    for name, attempt in cases.items():
        try:
            attempt()
            rows.append((name, None))
        except ValueError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "case string, complaint string")


def require(violations: DataFrame, what: str) -> None:
    if violations.limit(1).count():
        raise ValueError(f"{what}: {violations.limit(3).collect()}")
