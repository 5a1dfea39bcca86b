"""Folds, batches, cycles and mixtures, by hash order: repeatable on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.rand import uniform
from graphloom.operators.prefix import running

#: Ranges that a draw in [0, 1) is dealt by; a hot stratum is spread over all of them.
RANGES = 1024


def ranked(rows: DataFrame, strata: list[str], draw: Column, key: str, name: str) -> DataFrame:
    """rows with a column `name`: the place in its stratum, from 1, by a uniform draw (ties: smaller key)."""
    drawn = rows.withColumn("_draw", draw)
    order = [F.col("_draw"), F.col(key)]
    return running(drawn, strata, {"_range": F.floor(F.col("_draw") * RANGES)}, [F.col("_range")], order, {name: F.lit(1).cast("long")}).drop("_draw")


def stratified_folds(rows: DataFrame, strata: str, folds: int, key: str, seed: int = 0) -> DataFrame:
    """Adds fold: in each stratum folds differ by one row at most."""
    placed = ranked(rows, [strata], uniform(seed, F.col(key)), key, "_k")
    return placed.withColumn("fold", F.pmod(F.col("_k") - 1, F.lit(folds)).cast("int")).drop("_k")


def split(rows: DataFrame, key: str, share: float = 0.75, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """About `share` of the rows and the rest, by hash."""
    u = uniform(seed, F.col(key))
    return rows.where(u < share), rows.where(u >= share)


def balanced_batches(rows: DataFrame, label: str, sizes: dict[int, int], batches: int, key: str, seed: int = 0) -> DataFrame:
    """batch, slot, label, key: in each batch sizes[label] rows of each label, cycling through a label in fresh orders."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    size = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))
    slots = n.withColumn("_size", F.try_element_at(size, F.col(label).cast("int"))).where("_size is not null")
    slots = slots.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_size") * batches - 1)))
    slots = slots.select(label, F.floor(F.col("_at") / F.col("_size")).alias("batch"), F.pmod("_at", "_size").alias("slot"), F.floor(F.col("_at") / F.col("_n")).alias("epoch"), F.pmod("_at", "_n").alias("_k"))
    epochs = slots.select(label, "epoch").distinct()
    placed = ranked(rows.select(label, key).join(epochs, label), [label, "epoch"], uniform(seed, F.col("epoch"), F.col(key)), key, "_k")
    return slots.withColumn("_k", F.col("_k").cast("long") + 1).join(placed, [label, "epoch", "_k"]).select("batch", "slot", label, key)


def cycled(rows: DataFrame, group: str, size: int, key: str, seed: int = 0) -> DataFrame:
    """group, pos, key: every group's rows in hash order, repeated until there are exactly `size`."""
    placed = ranked(rows.select(group, key), [group], uniform(seed, F.col(key)), key, "_k").withColumn("_k", F.col("_k") - 1)
    n = rows.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    placed = placed.where(F.col("_k") < size).join(n, F.col(group).eqNullSafe(F.col("_group")))
    copies = placed.withColumn("pos", F.explode(F.sequence(F.col("_k").cast("long"), F.lit(size - 1).cast("long"), F.col("_n").cast("long"))))
    return copies.select(group, "pos", key)


def block_order(rows: DataFrame, pos: str, block: int, seed: int = 0) -> DataFrame:
    """Adds block, in_block and shuffle_key: whole blocks in hash order, an incomplete last block at the end."""
    b = F.floor(F.col(pos) / block)
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    out = rows.join(F.broadcast(total)).withColumns({"block": b, "in_block": F.pmod(F.col(pos), F.lit(block))})
    return out.withColumn("shuffle_key", F.when(F.col("block") < F.floor(F.col("_n") / block), uniform(seed, F.col("block"))).otherwise(F.lit(2.0))).drop("_n")


def mixup(rows: DataFrame, key: str, columns: list[str], share: float, seed: int = 0, groups: int = 64) -> DataFrame:
    """share * row + (1 - share) * partner: partners are the next rows in hash order, within groups of the key's hash."""
    g = F.floor(uniform(seed + 1, F.col(key)) * groups)
    w = Window.partitionBy("_g").orderBy(uniform(seed, F.col(key)), key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.withColumn("_g", g)
    mixed = {c: share * F.col(c) + (1 - share) * F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in columns}
    partner = F.coalesce(F.lead(key).over(w), F.first(key).over(whole))
    return out.select(key, partner.alias("partner"), *(v.alias(c) for c, v in mixed.items()))
