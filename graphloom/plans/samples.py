"""Voxels, metrics, folds, batches, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import voxel
from graphloom.functions.rand import uniform, uniform_sql
from graphloom.operators import metrics, sampling
from graphloom.plans.base import JUDGED, judged, query, read

N = 8
GRID = f"vox AS (SELECT id, z, y, x, CAST((id * 31 + z * 7 + y * 5 + x * 3) % 101 AS DOUBLE) * 20 - 1100 AS val FROM (SELECT s_suppkey AS id FROM supplier) s, range({N}) a(z), range({N}) b(y), range({N}) c(x))"
WITH = f"WITH {GRID}"


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    for a in voxel.AXES:
        rows = rows.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N - 1).cast("long"))))
    return rows.withColumn("val", F.pmod(F.col("id") * 31 + F.col("z") * 7 + F.col("y") * 5 + F.col("x") * 3, F.lit(101)).cast("double") * 20 - 1100)


def _long(df: DataFrame) -> DataFrame:
    return df.select("id", *(F.col(a).cast("long").alias(a) for a in voxel.AXES), "val")


@query(f"{WITH} SELECT id, z, y, x, round_even(least(greatest((val + 1024) / 1424 * 255, 0), 255), 0) AS val FROM vox")
def p17_window_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_voxels(spark, sf_dir).withColumn("val", voxel.window_clip(F.col("val"))))


@query(f"{WITH} SELECT id, z, y, x, val * CASE WHEN (z + y + x) % 2 = 0 THEN 1.0 ELSE 0.0 END AS val FROM vox")
def p18_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voxels(spark, sf_dir)
    seg = v.withColumn("val", F.when((F.col("z") + F.col("y") + F.col("x")) % 2 == 0, 1.0).otherwise(0.0))
    return _long(voxel.mask(v, seg))


@query(f"{WITH} SELECT id, z - 2 AS z, y - 2 AS y, x - 3 AS x, val FROM vox WHERE z >= 2 AND z < 6 AND y >= 2 AND y < 6 AND x >= 3 AND x < 5")
def p19_cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(voxel.crop(_voxels(spark, sf_dir), (4, 4, 4), (4, 4, 2)))


@query(f"""{WITH}, g AS (SELECT id, z, y, x FROM (SELECT DISTINCT id FROM vox) i, range(6) a(z), range(6) b(y), range(6) c(x))
SELECT g.id, g.z, g.y, g.x, coalesce(val, -1) AS val FROM g LEFT JOIN vox v ON v.id = g.id AND v.z = g.z - 2 AND v.y = g.y + 1 AND v.x = g.x + 4""")
def p20_padded_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(voxel.crop_padded(_voxels(spark, sf_dir), (1, 4, 7), (6, 6, 6), -1.0))


@query(f"{WITH} SELECT id, z, {N - 1} - x AS y, y AS x, val FROM vox")
def p21_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(voxel.rotate(_voxels(spark, sf_dir), ("y", "x"), 1, N))


@query(f"{WITH} SELECT id, x AS z, z AS y, {N - 1} - y AS x, val FROM vox")
def p22_reordered_reflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(voxel.reflect(voxel.reorder(_voxels(spark, sf_dir), (2, 0, 1)), "x", N))


@query(f"{WITH}, s AS (SELECT * FROM vox WHERE z >= 4), m AS (SELECT id, z, y, x, val FROM s UNION ALL SELECT id, {N - 1} - z, y, x, val FROM s), t AS (SELECT * FROM m WHERE y >= 4) SELECT id, z, y, x, val FROM t UNION ALL SELECT id, z, {N - 1} - y, x, val FROM t")
def p23_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(voxel.mirror(voxel.mirror(_voxels(spark, sf_dir), "z", N), "y", N))


@query(f"{WITH} SELECT id, CAST(k AS BIGINT) AS copy, z, CASE k WHEN 1 THEN y ELSE {N - 1} - y END AS y, CASE k WHEN 3 THEN {N - 1} - x ELSE x END AS x, val FROM vox, (VALUES (1), (2), (3)) t(k)")
def c17_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voxels(spark, sf_dir)
    flip = voxel.reflect(v, "y", N)
    out = v.withColumn("copy", F.lit(1)).unionByName(flip.withColumn("copy", F.lit(2))).unionByName(voxel.reflect(flip, "x", N).withColumn("copy", F.lit(3)))
    return out.select("id", F.col("copy").cast("long").alias("copy"), *(F.col(a).cast("long").alias(a) for a in voxel.AXES), "val")


@query(f"{WITH}, t AS (SELECT id, CASE WHEN val > 0 THEN 1.0 ELSE 0.0 END AS y, (val + 1100) / 2000 AS p FROM vox) SELECT id, round(-(2 * sum(y * p) + 1e-7) / (sum(y) + sum(p) + 1e-7), 9) AS loss FROM t GROUP BY id")
def e13_dice_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voxels(spark, sf_dir).select("id", F.when(F.col("val") > 0, 1.0).otherwise(0.0).alias("t"), ((F.col("val") + 1100) / 2000).alias("p"))
    return metrics.dice_loss(v, "id", "t", "p").select("id", F.round("loss", 9).alias("loss"))



@query(f"WITH {JUDGED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM judged) SELECT round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 9) AS auc FROM r")
def e11_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(judged(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {JUDGED}, p AS (SELECT label, round_even(score, 0) AS p FROM judged) SELECT round(sum(p * label) / (sum(p) + 1e-7), 9) AS precision_, round(sum(p * label) / (sum(label) + 1e-7), 9) AS recall FROM p")
def e12_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precision_recall(judged(spark, sf_dir)).select(F.round("precision", 9).alias("precision_"), F.round("recall", 9).alias("recall"))


@query(f"WITH {JUDGED} SELECT round(avg(CASE WHEN label = (CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM judged")
def e14_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("long"))
    return metrics.accuracy(rows).select(F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {JUDGED}, p AS (SELECT label, score, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM judged) SELECT round(avg(pow(score - label, 2)), 9) AS mse, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 9) AS bce FROM p")
def e15_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.losses(judged(spark, sf_dir)).select(F.round("mse", 9).alias("mse"), F.round("bce", 9).alias("bce"))


@query(f"WITH {JUDGED} SELECT doc_id, round((score + label) / 2, 9) AS score FROM judged")
def p33_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    return metrics.ensemble(j, j.select("doc_id", F.col("label").cast("double").alias("score")), "doc_id", "score").select("doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {JUDGED} SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY {uniform_sql(3, 'doc_id')}, doc_id) - 1) % 5 AS fold FROM judged")
def c16_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_folds(judged(spark, sf_dir), "lang", 5, "doc_id", 3).select("doc_id", "lang", F.col("fold").cast("long").alias("fold"))


@query(f"WITH {JUDGED} SELECT lang, f AS fold, count(*) AS n FROM (SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5 AS f FROM judged) GROUP BY ALL")
def c16_fold_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = sampling.stratified_folds(judged(spark, sf_dir), "lang", 5, "doc_id", 3)
    return folds.groupBy("lang", F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


BALANCED = f"""WITH {JUDGED}, n AS (SELECT label, count(*) AS n FROM judged GROUP BY label), slots AS (SELECT label, n, CASE label WHEN 0 THEN 6 ELSE 2 END AS size, unnest(range(CASE label WHEN 0 THEN 60 ELSE 20 END)) AS slot_no FROM n),
ep AS (SELECT DISTINCT label, slot_no // n AS epoch FROM slots), ranked AS (SELECT j.label, epoch, doc_id, row_number() OVER (PARTITION BY j.label, epoch ORDER BY {uniform_sql(6, 'epoch', 'doc_id')}, doc_id) - 1 AS k FROM judged j JOIN ep ON ep.label = j.label)"""


@query(f"{BALANCED} SELECT slot_no // size AS batch, slot_no % size AS slot, s.label, doc_id FROM slots s JOIN ranked r ON r.label = s.label AND r.epoch = slot_no // n AND r.k = slot_no % n")
def c15_balanced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.balanced_batches(judged(spark, sf_dir), "label", {0: 6, 1: 2}, 10, "doc_id", 6)
    return out.select(F.col("batch").cast("long").alias("batch"), F.col("slot").cast("long").alias("slot"), "label", "doc_id")


@query(f"WITH {JUDGED}, r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {uniform_sql(2, 'doc_id')}, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM judged) SELECT lang, pos, doc_id FROM (SELECT lang, doc_id, unnest(range(k, 100, n)) AS pos FROM r)")
def s19_cycled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cycled(judged(spark, sf_dir), "lang", 100, "doc_id", 2)


@query(f"SELECT doc_id, doc_id // 64 AS block, doc_id % 64 AS in_block, round(CASE WHEN doc_id // 64 < (SELECT count(*) FROM documents) // 64 THEN {uniform_sql(8, 'doc_id // 64')} ELSE 2.0 END, 9) AS shuffle_key FROM documents")
def w14_block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.block_order(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64, 8)
    return out.select("doc_id", "block", "in_block", F.round("shuffle_key", 9).alias("shuffle_key"))


@query(f"""WITH {JUDGED}, g AS (SELECT doc_id, score, label, floor({uniform_sql(5, 'doc_id')} * 64) AS g, {uniform_sql(4, 'doc_id')} AS u FROM judged),
p AS (SELECT *, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS partner FROM g WINDOW w AS (PARTITION BY g ORDER BY u, doc_id))
SELECT p.doc_id, partner, round(0.3 * p.score + 0.7 * o.score, 9) AS score, round(0.3 * p.label + 0.7 * o.label, 9) AS label FROM p JOIN judged o ON o.doc_id = partner""")
def p25_mixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.mixup(judged(spark, sf_dir), "doc_id", ["score", "label"], 0.3, 4).select("doc_id", "partner", F.round("score", 9).alias("score"), F.round("label", 9).alias("label"))


@query("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def o1_o6_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return a.unionByName(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def o5_common_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return a.intersect(read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("nation")))


@query("SELECT DISTINCT l_partkey AS subject, l_returnflag AS predicate, l_suppkey AS object FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def o7_j11_distinct_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").alias("object")).distinct()
    parts = read(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("subject"))
    return rows.join(parts, "subject", "left_semi").join(read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("object")), "object", "left_semi")


@query(f"SELECT doc_id, round({uniform_sql(1, 'doc_id')}, 9) AS u FROM documents")
def l11_hash_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.round(uniform(1, F.col("doc_id")), 9).alias("u"))
