"""Interval, IoU and lookup joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import box, segment


def interval(left: DataFrame, right: DataFrame, key: str | list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], bucket: float | None = None) -> DataFrame:
    """Rows whose half-open intervals overlap, by key.

    Without a bucket the key alone is joined and the rest filtered. With one, both sides are dealt to the buckets that they
    touch and joined on (key, bucket); a pair is emitted in the first bucket that both touch, so once. A key with
    a third of all rows is then spread over its buckets.
    """
    (a, b), (s, e) = left_ends, right_ends
    keys = [key] if isinstance(key, str) else key
    cond = segment.overlap(F.col(a), F.col(b), F.col(s), F.col(e))
    if bucket is None:
        return left.join(right, keys).where(cond)

    def dealt(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
        first, last = F.floor(F.col(x) / bucket).cast("long"), F.floor(F.col(y) / bucket).cast("long")
        return df.withColumn(name, first).withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last))))

    l2, r2 = dealt(left, a, b, "_lb"), dealt(right, s, e, "_rb")
    return l2.join(r2, [*keys, "_b"]).where(cond & (F.col("_b") == F.greatest("_lb", "_rb"))).drop("_b", "_lb", "_rb")


def width(*sides: tuple[DataFrame, str, str]) -> float:
    """A bucket for segments (rows, first, last): the largest mean length of a side, so that a row meets three buckets on average."""
    means = [F.avg(F.col(b) - F.col(a) + 1).cast("double").alias("w") for _, a, b in sides]
    rows = reduce(lambda x, y: x.unionByName(y), (df.agg(m) for (df, _, _), m in zip(sides, means, strict=True)))
    return max(rows.agg(F.max("w")).first()[0] or 1.0, 1.0)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], bucket: float | None = None) -> DataFrame:
    """Pairs of the keys whose segments share a point, ends included; without a bucket one is measured."""
    (a, b), (s, e) = left_ends, right_ends
    bucket = bucket or width((left, a, b), (right, s, e))
    return interval(left.withColumn("_le", F.col(b) + 1), right.withColumn("_re", F.col(e) + 1), keys, (a, "_le"), (s, "_re"), bucket).drop("_le", "_re")


def iou_1d(anchors: DataFrame, truths: DataFrame, key: str, bucket: float | None = None) -> DataFrame:
    """Anchors (a1, a2) with the truths (g1, g2) of their item that they overlap, and their `iou`."""
    return overlapping(anchors, truths, [key], ("a1", "a2"), ("g1", "g2"), bucket).withColumn("iou", segment.iou(F.col("a1"), F.col("a2"), F.col("g1"), F.col("g2")))


def iou_2d(detections: DataFrame, truths: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """Detections (x1, y1, x2, y2) with the truths (g_x1, ...) of their keys that they overlap, and `iou`; dealt by x."""
    d, g = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), tuple(F.col(f"g_{c}") for c in ("x1", "y1", "x2", "y2"))
    return overlapping(detections, truths, keys, ("x1", "x2"), ("g_x1", "g_x2"), bucket).withColumn("iou", box.iou(d, g)).where("iou > 0")


def both_ends(edges: DataFrame, vectors: DataFrame, strict: bool = False) -> DataFrame:
    """edges (src, dst) with va and vb; edges without a vector are dropped, or with strict returned alone as violations."""
    v = vectors.select("id", "v")
    if strict:
        known = v.select("id")
        return edges.join(known.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(edges.join(known.withColumnRenamed("id", "dst"), "dst", "left_anti")).distinct()
    out = edges.join(v.select(F.col("id").alias("src"), F.col("v").alias("va")), "src")
    return out.join(v.select(F.col("id").alias("dst"), F.col("v").alias("vb")), "dst")


def compose(partitions: list[DataFrame]) -> DataFrame:
    """node, comm after all passes (node, comm): the community of a pass is the node of the next."""
    return reduce(lambda a, b: a.join(b.select(F.col("node").alias("comm"), F.col("comm").alias("_next")), "comm").select("node", F.col("_next").alias("comm")), partitions)


def append_known(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of first, and of second what has a key of first."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_semi").select(*first.columns))


def right_biased(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of second, and of first what has no key of second."""
    return second.unionByName(first.join(second.select(key).distinct(), key, "left_anti").select(*second.columns))


def contains_once(ids: DataFrame, names: DataFrame) -> DataFrame:
    """id, name where exactly one name contains the id; ids with none or several hits are dropped.

    Names are cut into their distinct substrings of the lengths that ids have, so it is an equi-join: rows grow with the names'
    lengths, never with ids times names. An empty id is in every name.
    """
    lengths = sorted(r[0] for r in ids.select(F.length("id")).where("id is not null").distinct().collect())  # no more than the longest id has letters

    def cuts(n: int) -> Column:
        if not n:
            return F.array(F.lit(""))
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("name") - n + 1)), lambda k: F.substring("name", k, F.lit(n)))
        return F.when(F.length("name") >= n, found).otherwise(F.array().cast("array<string>"))

    every = F.concat(*map(cuts, lengths)) if lengths else F.array().cast("array<string>")
    parts = names.select("name", F.explode(F.array_distinct(every)).alias("id"))
    hits = ids.join(parts, "id")
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("name")).where("_n = 1").drop("_n")


def mapped(rows: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """The column by a literal map, and as it is where the map has no entry."""
    m = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return rows.withColumn(column, F.coalesce(F.try_element_at(m, F.col(column)), F.col(column)))
