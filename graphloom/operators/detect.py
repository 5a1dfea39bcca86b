"""Detections: non-maximum suppression, proposals, target assignment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from graphloom.functions import segment
from graphloom.functions.rand import uniform
from graphloom.operators import windows
from graphloom.operators.checkpoints import dropped, freed, written
from graphloom.operators.joins import iou_1d, width
from graphloom.operators.sampling import ranked


def _suppresses(iou: Column, threshold: float, inclusive: bool) -> Column:
    return iou >= threshold if inclusive else iou > threshold


def nms(detections: DataFrame, keys: list[str], threshold: float, inclusive: bool = True) -> DataFrame:
    """Greedy suppression by score (ties: smaller id) within keys, a group at a time in NumPy.

    inclusive: suppress at IoU >= threshold, else above it only. For groups that fit a task; nms_fixpoint needs none.
    """
    columns = detections.columns

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        x1, x2 = rows["x1"].to_numpy(float), rows["x2"].to_numpy(float)
        length, alive, kept = x2 - x1 + 1, np.ones(len(rows), bool), []
        for k in range(len(rows)):
            if alive[k]:
                kept.append(k)
                inter = np.maximum(0.0, np.minimum(x2[k], x2) - np.maximum(x1[k], x1) + 1)
                iou = inter / (length[k] + length - inter)
                alive &= ~(iou >= threshold if inclusive else iou > threshold)
        return rows.iloc[kept][columns]

    return detections.groupBy(*keys).applyInPandas(keep, detections.schema)


#: Blocks of suppression are so many buckets wide, so few segments reach into two.
WIDE = 16


def _settle(threshold: float, inclusive: bool):  # noqa: ANN202
    """Of the strongest rows of a block (x1, x2, _k, _all) those that nothing here suppresses, with _s: 1 kept, 2 if other blocks agree."""

    def settle(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_k")
        x1, x2 = (rows[c].cast(pa.float64(), safe=False).to_numpy() for c in ("x1", "x2"))
        inner, n = rows["_all"].to_numpy() == 1, rows.num_rows
        said, waits = np.zeros(n, np.int32), np.zeros(n, bool)
        for k in range(n):
            if said[k] == 3:
                continue
            # Weaker rows that are not gone yet.
            j = k + 1 + np.flatnonzero(said[k + 1 :] != 3)
            inter = np.maximum(0.0, np.minimum(x2[k], x2[j]) - np.maximum(x1[k], x1[j]) + 1)
            iou = inter / (x2[k] - x1[k] + x2[j] - x1[j] + 2 - inter)
            j = j[iou >= threshold if inclusive else iou > threshold]
            if waits[k]:
                waits[j] = True
            elif inner[k]:
                said[k], said[j] = 1, 3
            else:
                said[k], waits[j] = 2, True
        return rows.append_column("_s", pa.array(said)).filter(pa.array((said == 1) | (said == 2)))

    return settle


def nms_fixpoint(detections: DataFrame, keys: list[str], threshold: float, inclusive: bool = True, bucket: float | None = None, most: int = 20_000) -> DataFrame:
    """The same answer by rounds over blocks of the axis, for groups of any size; no table of overlapping pairs is made.

    A round settles the `most` strongest open rows of every block in NumPy: one that no stronger open row can suppress, in
    all blocks that it reaches, is kept, and what it overlaps goes, also what was not among the strongest. Rows wait for
    those that reach into other blocks; blocks grow when few rows are open. Rows with a null, or an end that isn't finite, stay.
    A bucket not given is measured; blocks are WIDE buckets, at least. On disk at once: the detections, the kept, the open
    rows of two rounds and one shuffle of them.
    """
    columns, used = detections.columns, [*keys, "id", "x1", "x2", "score"]
    with freed(detections.sparkSession):
        rows = written(detections.withColumn("_n", F.monotonically_increasing_id()), "nms-rows")
        bucket = bucket or width((rows, "x1", "x2"))
        comparable = F.lit(True)
        for c in used:
            comparable = comparable & F.col(c).isNotNull()
        for c in ("x1", "x2"):
            comparable = comparable & (F.abs(F.col(c).cast("double")) < math.inf)
        left = rows.where(comparable).select("_n", *used)
        x1, x2 = F.col("x1").cast("double"), F.col("x2").cast("double")
        last, longest = left.agg(F.count(F.lit(1)), F.max(x2 - x1)).first()
        block, kept = bucket * WIDE, []

        def touched(size: float) -> Column:
            lowest = F.floor(x1 / size)
            return F.sequence(lowest, F.greatest(lowest, F.floor((x2 + 1) / size)))

        # What a kept row suppresses begins this far before it at most; by the IoU, or because it reaches it.
        reach = F.lit(float(longest or 0))
        if threshold > 0:
            reach = F.least(reach, (x2 - x1 + 1) * (1 / threshold - 1) * (1 + 1e-9))
        home = F.floor(x1 / bucket)
        homes = F.sequence(F.floor((x1 - F.greatest(reach, F.lit(0.0)) - 1) / bucket), F.greatest(home, F.floor((x2 + 1) / bucket)))
        a1, a2 = F.col("_by_x1"), F.col("_by_x2")
        inter = F.greatest(F.lit(0.0), F.least(a2, x2) - F.greatest(a1, x1) + 1)
        hit = _suppresses(F.try_divide(inter, a2 - a1 + x2 - x1 + 2 - inter), threshold, inclusive) | (F.col("_n") == F.col("_by__n"))
        for k in (*keys, "_h"):
            hit = hit & (F.col(k) == F.col(f"_by_{k}"))

        while True:
            dealt = left.withColumn("_b", touched(block)).withColumn("_all", F.size("_b")).withColumn("_b", F.explode("_b"))
            dealt = dealt.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(F.desc("score"), "id", "_n"))).where(F.col("_k") <= most)
            said = dealt.groupBy(*keys, "_b").applyInArrow(_settle(threshold, inclusive), StructType([*dealt.schema.fields, StructField("_s", IntegerType())]))
            said = said.groupBy("_n").agg(F.max("_s").alias("_s"), F.count(F.lit(1)).alias("_clear"), F.max("_all").alias("_all"), *(F.first(c).alias(c) for c in used))
            kept.append(written(said.where("_s = 1 OR _clear = _all").select("_n", *used), "nms-kept"))
            by = kept[-1].select(*(F.col(k).alias(f"_by_{k}") for k in ("_n", *keys)), x1.alias("_by_x1"), x2.alias("_by_x2"), F.explode(homes).alias("_by__h"))
            # Every open row is in one home, so it is written once, or never again.
            open_ = written(left.withColumn("_h", home).join(by.hint("merge"), hit, "left_anti").select(*left.columns), "nms-open")
            if len(kept) > 1:
                dropped(left)
            left, n = open_, open_.count()
            if not n:
                break
            if n * 4 <= last:
                block *= WIDE
            last = n
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    if not set(columns) <= set(used):
        every = rows.join(every.select("_n").hint("merge"), "_n", "left_semi")
    return every.select(*columns).unionByName(rows.where(~F.coalesce(comparable, F.lit(False))).select(*columns))


def suppress(detections: DataFrame, keys: list[str], threshold: float, inclusive: bool = True, most: int = 100_000, bucket: float | None = None) -> DataFrame:
    """Greedy suppression, dispatched by the size of the largest group: one task a group up to `most` rows, else by rounds over blocks."""
    with freed(detections.sparkSession):
        largest = detections.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return nms(detections, keys, threshold, inclusive) if largest <= most else nms_fixpoint(detections, keys, threshold, inclusive, bucket)


def top(rows: DataFrame, keys: list[str], n: int, ties: bool = False) -> DataFrame:
    """The n best by score a group (ties: smaller id); with ties, all that score as the n-th; n = 0 keeps all."""
    if not n:
        return rows
    w = Window.partitionBy(*keys).orderBy(F.desc("score")) if ties else Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("_k", F.rank().over(w) if ties else F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def proposals(anchor_rows: DataFrame, least_length: float, before: int, after: int, threshold: float, key: str = "item") -> DataFrame:
    """Decoded, clipped, length-tested (a short one scores 0), cut to `before`, suppressed, cut to `after`; from anchors with dx, dl, score, id, length."""
    x1, x2 = segment.decode(F.col("a1"), F.col("a2"), F.col("dx"), F.col("dl"))
    rows = anchor_rows.withColumns({"x1": segment.clip(x1, F.col("length")), "x2": segment.clip(x2, F.col("length"))})
    rows = rows.withColumn("score", F.when(F.col("x2") - F.col("x1") + 1 < least_length, F.lit(0.0)).otherwise(F.col("score")))
    kept = suppress(top(rows.select(key, "id", "x1", "x2", "score"), [key], before), [key], threshold)
    return top(kept, [key], after)


def _apart() -> Column:
    """The IoU of an anchor (a1, a2) with a truth that it doesn't overlap."""
    length = segment.inclusive_length(F.col("a1"), F.col("a2"))
    return F.when(length == 1, F.lit(-1.0)).when(length.isNotNull(), F.lit(0.0))


def anchor_labels(anchor_rows: DataFrame, truths: DataFrame, positive: float = 0.7, negative: float = 0.3, clobber: bool = False, key: str = "item", bucket: float | None = None) -> DataFrame:
    """Anchors with best_iou and label: 1 for IoU >= positive and for each truth's best (all ties), 0 below negative, else -1.

    A truth that nothing overlaps has no best anchor. clobber lets the negative rule win. Anchors of items without truths
    have no label. Only overlapping pairs are made; an anchor's row without a truth stands for the rest.
    """
    anchor_rows, truths = anchor_rows.select(key, "id", "a1", "a2"), truths.select(key, "g1", "g2")
    pairs = iou_1d(anchor_rows, truths, key, bucket)
    top_iou = pairs.groupBy(key, "g1", "g2").agg(F.max("iou").alias("_g"))
    pairs = pairs.join(top_iou, [key, "g1", "g2"])
    pairs = pairs.select(key, "id", "a1", "a2", "iou", ((F.col("iou") == F.col("_g")) & (F.col("_g") > 0)).cast("int").alias("_b"))
    apart = anchor_rows.join(truths.select(key).distinct(), key, "left_semi").select(key, "id", "a1", "a2", _apart().alias("iou"), F.lit(0).alias("_b"))
    best = pairs.unionByName(apart).groupBy(key, "id", "a1", "a2").agg(F.max("iou").alias("best_iou"), F.max("_b").alias("_is_best"))
    low, high = F.col("best_iou") < negative, (F.col("best_iou") >= positive) | (F.col("_is_best") == 1)
    label = F.when(low, 0).when(high, 1).otherwise(-1) if clobber else F.when(high, 1).when(low, 0).otherwise(-1)
    return best.withColumn("label", label).drop("_is_best")


def subsample(labelled: DataFrame, batch: int, share: float = 0.5, seed: int = 0, key: str = "item") -> DataFrame:
    """Labels with the surplus set to -1: at most share * batch positives, and negatives up to batch; by hash order."""
    rows = ranked(labelled, [key, "label"], uniform(seed, F.col(key), F.col("id")), "id", "_k")
    fg = rows.groupBy(F.col(key).alias("_key")).agg(F.least(F.sum((F.col("label") == 1).cast("long")), F.lit(int(share * batch))).alias("_fg"))
    rows = rows.join(fg, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    drop = ((F.col("label") == 1) & (F.col("_k") > F.col("_fg"))) | ((F.col("label") == 0) & (F.col("_k") > batch - F.col("_fg")))
    return rows.withColumn("label", F.when(drop, -1).otherwise(F.col("label"))).drop("_k", "_fg")


def batch_summary(labelled: DataFrame, key: str = "item") -> DataFrame:
    """key, fg, bg, ignored, weight: counts of labels, and 1 / (labels that count) as each one's weight."""
    counts = labelled.groupBy(key).agg(*(F.sum((F.col("label") == v).cast("long")).alias(n) for n, v in (("fg", 1), ("bg", 0), ("ignored", -1))))
    return counts.withColumn("weight", F.when(F.col("fg") + F.col("bg") > 0, 1.0 / (F.col("fg") + F.col("bg"))))


def candidates(rois: DataFrame, truths: DataFrame, fg: float = 0.5, high: float = 0.5, low: float = 0.1, key: str = "item", bucket: float | None = None) -> DataFrame:
    """RoIs and the truths themselves with best_iou, best truth and kind: fg, bg (low <= IoU < high) or none. Where several
    truths are best, overlapped or not, it is the one of the smallest gid."""
    own = truths.select(key, F.concat(F.lit("g"), F.col("gid").cast("string")).alias("id"), F.col("g1").cast("double").alias("a1"), F.col("g2").cast("double").alias("a2"))
    everything = rois.select(key, F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.col("a1").cast("double").alias("a1"), F.col("a2").cast("double").alias("a2")).unionByName(own)
    pairs = iou_1d(everything, truths, key, bucket).select(key, "id", "a1", "a2", "iou", "gid")
    least = truths.groupBy(key).agg(F.min("gid").alias("gid"))
    pairs = pairs.unionByName(everything.join(least, key).select(key, "id", "a1", "a2", _apart().alias("iou"), "gid"))
    best = pairs.groupBy(key, "id", "a1", "a2").agg(F.max(F.struct("iou", (-F.col("gid")).alias("n"))).alias("b"))
    best = best.select(key, "id", "a1", "a2", F.col("b.iou").alias("best_iou"), (-F.col("b.n")).alias("gid"))
    return best.withColumn("kind", F.when(F.col("best_iou") >= fg, "fg").when((F.col("best_iou") < high) & (F.col("best_iou") >= low), "bg").otherwise("none"))


def sample_rois(cands: DataFrame, batch: int, share: float = 0.25, seed: int = 0, key: str = "item") -> DataFrame:
    """Exactly `batch` rows an item: foregrounds without replacement up to share, the rest backgrounds with replacement;
    if one kind is missing, the other with replacement fills the batch. Draws are hashes."""
    rows = ranked(cands.where("kind <> 'none'"), [key, "kind"], uniform(seed, F.col(key), F.col("id")), "id", "_k")
    n = rows.groupBy(key).agg(F.sum((F.col("kind") == "fg").cast("int")).alias("nf"), F.sum((F.col("kind") == "bg").cast("int")).alias("nb"))
    slots = n.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(batch)))).withColumn("_f", F.least(F.col("nf"), F.lit(int(share * batch))))
    u = uniform(seed, F.col(key), F.col("slot"))
    kind = F.when(F.col("nf") == 0, "bg").when(F.col("nb") == 0, "fg").when(F.col("slot") <= F.col("_f"), "fg").otherwise("bg")
    pick = F.when((kind == "fg") & (F.col("nb") > 0), F.col("slot")).otherwise(F.floor(u * F.when(kind == "fg", F.col("nf")).otherwise(F.col("nb"))) + 1)
    slots = slots.select(key, "slot", kind.alias("kind"), pick.cast("long").alias("_k"))
    return slots.join(rows, [key, "kind", "_k"]).drop("_k")


def assemble(scores: DataFrame, least: float = 0.005, threshold: float = 0.4, per_item: int = 0) -> DataFrame:
    """Detections (cls, item, id, x1, x2, score): background and low scores go, suppression by class and item, then the
    best of all classes an item, ties kept."""
    rows = scores.where((F.col("cls") >= 1) & (F.col("score") > least))
    return top(suppress(rows, ["cls", "item"], threshold), ["item"], per_item, ties=True)


def anchors_for(items: DataFrame, one_row: DataFrame, base_size: int, scales: list[int], stride: int) -> DataFrame:
    """All anchors of items (item, cells, length) that lie inside, with ids."""
    rows = windows.inside(windows.tile_anchors(windows.anchors(one_row, base_size, scales), items, stride))
    return rows.withColumn("id", F.col("cell") * 1000 + F.col("scale"))


def pack_by_budget(sentences: DataFrame, budget: int, key: str = "sentence", size: str = "n") -> DataFrame:
    """sentence, batch: greedy packing in order of the sentence until a batch would exceed the budget.

    Greedy packing is sequential, so it runs within `part`, a column that the caller gives to bound a task.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        batch, used, out = 0, 0, []
        for n in rows[size]:
            if used and used + n > budget:
                batch, used = batch + 1, 0
            used += n
            out.append(batch)
        return pd.DataFrame({"part": rows["part"], key: rows[key], "batch": np.array(out, np.int64)})

    return sentences.groupBy("part").applyInPandas(pack, f"part long, {key} long, batch long")
