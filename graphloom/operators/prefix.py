"""Running sums and extremes in two levels, so that no order is ever taken over all rows of a hot key in one task.

Rows are dealt by key and bucket, where buckets follow the wanted order. Sums by bucket are few; their running sums come from
a window over them, those inside a bucket from a window over its rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.checkpoints import written


def running(rows: DataFrame, keys: list[str], buckets: dict[str, Column], bucket_order: list[Column], order: list[Column], sums: dict[str, Column], stored: bool = False) -> DataFrame:
    """rows with running sums (own row included): buckets are named columns whose order, bucket_order, agrees with `order`.

    rows are read twice, so they are written first, unless they are `stored` already, as those of by_range are.
    """
    names = list(buckets)
    rows = rows.withColumns({**buckets, **{f"_v_{n}": c for n, c in sums.items()}})
    rows = rows if stored else written(rows, "prefix")
    on = [*keys, *names]
    parts = rows.groupBy(*on).agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums))
    # Null keys are a group like others.
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    before = Window.partitionBy(*keys).orderBy(*bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(c).alias(f"_on_{c}") for c in on), *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(parts, same).withColumns({n: F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(inside) for n in sums})
    return out.drop(*names, *(f"_on_{c}" for c in on), *(f"_v_{n}" for n in sums), *(f"_b_{n}" for n in sums))


def by_range(rows: DataFrame, keys: list[str], column: str, n: int = 1024, descending: bool = False) -> tuple[DataFrame, dict[str, Column]]:
    """rows, written, with each key's extremes, and a bucket column `_bucket` that rises in the wanted order of the column.

    Buckets are equally wide, which costs one aggregate of extremes; rows of one value, or close to each other, stay together.
    """
    rows = written(rows, "prefix")
    ends = rows.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    if keys:
        rows = rows.join(ends, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))).drop(*(f"_of_{k}" for k in keys))
    else:
        rows = rows.join(F.broadcast(ends))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    # A null value comes first in rising, last in falling order, as Spark's own order has it.
    b = F.floor(F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)) * n).cast("int")
    b = F.when(F.col(column).isNull(), -1).otherwise(b)
    return rows, {"_bucket": -b if descending else b}


def positions(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """rows with pos, from 1, in order of a numeric column."""
    spread, bucket = by_range(rows, [], column, descending=descending)
    order = F.desc(column) if descending else F.asc(column)
    out = running(spread, [], bucket, [F.col("_bucket")], [order], {"pos": F.lit(1).cast("long")}, stored=True)
    return out.select(*rows.columns, "pos")
