"""Row generators over positions: sliding windows, gaps, tiles, anchors, mask cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward(items: DataFrame, window: int, step: int, length: str = "length") -> DataFrame:
    """Adds win_start, win_end: starts 0, step, ... up to length - window; a short item gets one window of its own length."""
    last = F.greatest(F.lit(0), F.col(length) - window).cast("long")
    out = items.withColumn("win_start", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))))
    return out.withColumn("win_end", F.least(F.col("win_start") + window, F.col(length)).cast("long"))


def backward(items: DataFrame, window: int, step: int, length: str = "length") -> DataFrame:
    """Windows that end at length, length - step, ... while they fit; none for short items."""
    fits = items.where(F.col(length) >= window)
    out = fits.withColumn("win_end", F.explode(F.sequence(F.col(length).cast("long"), F.lit(window).cast("long"), F.lit(-step).cast("long"))))
    return out.withColumn("win_start", F.col("win_end") - window)


def both(items: DataFrame, window: int, step: int, length: str = "length") -> DataFrame:
    """Forward and backward windows with `direction`; windows that come both ways are kept twice. One pass over the items."""
    n, w, s = F.col(length).cast("long"), F.lit(window).cast("long"), F.lit(step).cast("long")

    def one(start: Column, end: Column, direction: str) -> Column:
        return F.struct(start.alias("win_start"), end.alias("win_end"), F.lit(direction).alias("direction"))

    ahead = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), n - w), s), lambda a: one(a, F.least(a + w, n), "forward"))
    back = F.transform(F.sequence(n, w, -s), lambda b: one(b - w, b, "backward"))
    rows = items.withColumn("_w", F.explode(F.when(n >= w, F.concat(ahead, back)).otherwise(ahead)))
    return rows.select(*items.columns, "_w.win_start", "_w.win_end", "_w.direction")


def budgeted(items: DataFrame, window: int, step: int, budget: int, key: str, length: str = "length") -> DataFrame:
    """The first budget // 2 windows in order of item, forward before backward: each window costs two, whether used or not.

    Every item has a window, so only the first budget // 2 items can matter: a top-k. Those are ranked by running sums of
    their counts, and windows within their item.
    """
    counts = items.orderBy(key).limit(max(budget // 2, 0)).withColumn("_n", F.floor(F.greatest(F.lit(0), F.col(length) - window) / step) + 1 + F.when(F.col(length) >= window, F.floor((F.col(length) - window) / step) + 1).otherwise(0))
    order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).where(F.col("_before") < budget // 2)
    rows = both(counts.drop("_n"), window, step, length)
    inside = Window.partitionBy(key).orderBy(F.col("direction").desc(), F.when(F.col("direction") == "forward", F.col("win_start")).otherwise(-F.col("win_end")))
    return rows.withColumn("_rank", F.col("_before") + F.row_number().over(inside)).where(F.col("_rank") <= budget // 2).drop("_rank", "_before")


def keep_segments(joined: DataFrame, direction: Column, least_duration: float = 3.0, least_ratio: float = 0.7) -> DataFrame:
    """Joined windows and segments (s, e) with enough of the segment inside: at least forward, more than that backward.

    Both tests are on the clipped part; its ends replace s and e as win-clipped `s`, `e`.
    """
    s, e = F.greatest("s", F.col("win_start").cast("double")), F.least("e", F.col("win_end").cast("double"))
    ratio = (e - s) / (F.col("e") - F.col("s"))
    own = F.col("e") - F.col("s")
    long_enough = F.when(direction == "forward", own >= least_duration).otherwise(own > least_duration)
    inside = F.when(direction == "forward", ratio >= least_ratio).otherwise(ratio > least_ratio)
    return joined.where(long_enough & inside).withColumns({"s": s, "e": e})


def gaps(segments: DataFrame, key: str, start: str = "s", end: str = "e", tail: float = 30.0, merge_overlaps: bool = False) -> DataFrame:
    """key, gap_start, gap_end: before the first segment, between neighbours, and `tail` after the last.

    A gap opens after the segment just before, even if an earlier one ends later; merge_overlaps looks at all before.
    """
    w = Window.partitionBy(key).orderBy(start, end)
    past = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) if merge_overlaps else F.lag(end).over(w)
    latest = F.max(end).over(Window.partitionBy(key)) if merge_overlaps else F.col(end)
    rows = segments.select(key, F.col(start).alias(start), F.col(end).alias(end), past.alias("_past"), F.lead(start).over(w).isNull().alias("_last"), latest.alias("_end"))
    before = F.when(F.col("_past").isNull() & (F.col(start) != 0), F.struct(F.lit(0.0).alias("a"), F.col(start).cast("double").alias("b")))
    between = F.when(F.col(start) > F.col("_past"), F.struct(F.col("_past").cast("double").alias("a"), F.col(start).cast("double").alias("b")))
    after = F.when(F.col("_last"), F.struct(F.col("_end").cast("double").alias("a"), (F.col("_end") + tail).cast("double").alias("b")))
    return rows.select(key, F.explode(F.array_compact(F.array(before, between, after))).alias("g")).select(key, F.col("g.a").alias("gap_start"), F.col("g.b").alias("gap_end"))


def tiles(gap_rows: DataFrame, size: int = 16, length: str = "length") -> DataFrame:
    """Adds tile_start, tile_end: whole tiles from the gap's start while start < min(gap_end, length) - size."""
    stop = F.least(F.col("gap_end"), F.col(length)).cast("long") - size
    first = F.col("gap_start").cast("long")
    out = gap_rows.where(first < stop).withColumn("tile_start", F.explode(F.sequence(first, stop - 1, F.lit(size).cast("long"))))
    return out.withColumn("tile_end", F.col("tile_start") + size)


def pad_tail(frames: DataFrame, key: str, pos: str, value: str, length: int) -> DataFrame:
    """Positions 0 .. length - 1 of every key; those without a value repeat the last one before."""
    grid = frames.select(key).distinct().withColumn(pos, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(frames.select(key, F.col(pos).cast("long").alias(pos), value), [key, pos], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def anchors(spark_range: DataFrame, base_size: int, scales: list[int]) -> DataFrame:
    """scale, a1, a2 for a one-row frame: windows of base_size * scale around the base window's center."""
    length, middle = F.lit(float(base_size)) * F.col("scale"), (base_size - 1) * 0.5
    out = spark_range.limit(1).select(F.explode(F.array(*map(F.lit, scales))).alias("scale"))
    return out.select("scale", (F.lit(middle) - (length - 1) * 0.5).alias("a1"), (F.lit(middle) + (length - 1) * 0.5).alias("a2"))


def tile_anchors(base: DataFrame, positions: DataFrame, stride: int, cells: str = "cells") -> DataFrame:
    """Every anchor at every cell of each item; the anchors are as many as the scales, so they are broadcast."""
    at = positions.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col(cells).cast("int") - 1)))
    return at.join(F.broadcast(base)).withColumns({"a1": F.col("a1") + F.col("cell") * stride, "a2": F.col("a2") + F.col("cell") * stride})


def inside(anchor_rows: DataFrame, length: str = "length") -> DataFrame:
    return anchor_rows.where((F.col("a1") >= 0) & (F.col("a2") < F.col(length)))


def mask_cells(items: DataFrame, segments: DataFrame, key: str, stride: int, cells: int) -> DataFrame:
    """key, cell, mask: 1 where a segment covers the cell, ends included and clamped."""
    first = F.least(F.greatest(F.floor(F.col("s") / stride), F.lit(0)), F.lit(cells - 1))
    last = F.least(F.greatest(F.floor(F.col("e") / stride), F.lit(0)), F.lit(cells))
    covered = segments.where(last >= first).select(key, F.explode(F.sequence(first.cast("int"), F.least(last, F.lit(cells - 1)).cast("int"))).alias("cell")).distinct().withColumn("_on", F.lit(1))
    grid = items.select(key).distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return grid.join(covered, [key, "cell"], "left").select(key, "cell", F.coalesce("_on", F.lit(0)).alias("mask"))


def context_pairs(tokens: DataFrame, window: int, reduce: Column, key: str = "sentence", pos: str = "pos", token: str = "token", block: int = 4096) -> DataFrame:
    """key, pos, token, context_pos, context: words within window - reduce of each other, by a range frame on the position; reduce is 0 or more.

    Positions of a key are dealt to blocks, with those within the window of a border in both, so a long key is several tasks'
    work; only words are shuffled, never pairs or wanted positions.
    """
    reach = F.when(reduce < 0, F.raise_error(F.lit("context_pairs: reduce is below 0"))).otherwise(F.lit(window) - reduce).cast("int")
    size = max(block, window)
    blocks = [F.floor((F.col(pos) + k) / size) for k in (-window, 0, window)]
    rows = tokens.where(F.col(key).isNotNull() & F.col(pos).isNotNull()).select(key, pos, token, reach.alias("_r"), F.explode(F.array_distinct(F.array(*blocks))).alias("_b"))
    near = Window.partitionBy(key, "_b").orderBy(pos).rangeBetween(-window, window)
    own = F.struct(F.col(pos).alias("context_pos"), F.col(token).alias("context"))
    rows = rows.withColumn("_n", F.collect_list(own).over(near)).where((F.col("_r") > 0) & (F.col("_b") == blocks[1]))
    apart = F.abs(F.col("context_pos") - F.col(pos))
    return rows.select(key, pos, token, "_r", F.inline("_n")).where((apart > 0) & (apart <= F.col("_r")) & (F.col("context_pos") >= 0)).select(key, pos, token, "context_pos", "context")
