"""Mixing sources to target weights [native]: certain whole copies, then Pareto order sampling of fixed size in words.

A document's expected copies are its source's target over its source's size (shared out by an own weight, if a weight
column is given). Whole copies are certain; the rest is an inclusion probability p. Documents are ranked by their random odds
u/(1-u) over their inclusion odds p/(1-p), and taken in that order until the source's remaining words are met; a second
pass in the same order fills what the first too long document left open. Both passes end in a cut-off per source, so the
decision is a row-wise comparison and no text is ever shuffled.

The order is (rank, doc_id, size, row tag), so of rows that share an id and a size as many are taken as fit. A row tag is a hash of the
row's file and place in it, where the table has such, and stands in for nothing but equal rows' order.

Prefix sums run over (source, bucket of the rank), inside the bucket that holds the cut-off over kinds of rows (rank, id,
size; repeated rows are one), and inside the kind at the cut-off over buckets of the tag. So neither a source with a third
of all rows nor such an id is ever one group. u is a hash of seed and doc_id: reruns agree.

Defined results: null source sorts last and is a source of its own; null text has size 0; repeated rows rank alike, and a part
of them may be taken; a text is only ever counted, however long; columns of other names pass by; without rows there are no targets.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, materialize, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 17
BUCKETS = 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: water-filling of share x all words by weight, none above most x its source.

    Reshared excess ends where every source below its limit has the same words a weight; sorted by limit over weight,
    the first source that stays below its limit gives that level (later ones give less, as sources before them are
    counted with limits they don't reach). One row a source, from partial sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    per = per.withColumn("_cap", (F.col("source_size") * most).cast("double"))
    whole = Window.partitionBy()
    per = per.withColumns({"_below": F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_cap"), "_left": F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)), "_all": F.sum("source_size").over(whole) * F.lit(float(share))})
    per = per.withColumn("_level", (F.col("_all") - F.col("_below")) / F.col("_left"))
    per = per.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(whole))
    return per.select("source", "source_size", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def row_tag(df: DataFrame) -> DataFrame:
    """df with _tag, an own 64-bit number a row: from file and place in it, else (not read from Parquet) from Spark's row number."""
    try:
        return df.withColumn("_tag", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        return df.withColumn("_tag", F.xxhash64(F.monotonically_increasing_id()))


def _with_rank(df: DataFrame, plan: DataFrame, seed: int, weight: str | None) -> DataFrame:
    """df with its source's plan, _whole (certain copies), _q (random odds over inclusion odds; null: no share left) and its bucket _b."""
    plan = plan.withColumnRenamed("source", "_source")
    out = df.join(plan, df["source"].eqNullSafe(plan["_source"])).drop("_source")
    own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    copies = F.when(F.col("_weighted") > 0, F.least(F.lit(float(MOST)), own * F.col("target") / F.col("_weighted"))).otherwise(0.0)
    out = out.withColumn("_copies", copies).withColumn("_whole", F.floor("_copies").cast("long"))
    p, u = F.col("_copies") - F.col("_whole"), uniform(F.col("doc_id"), seed)
    out = out.withColumn("_q", F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))).withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    # A source's mean share turns ranks into near uniform numbers, and these into buckets.
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.5)
    mean = F.greatest(F.lit(0.01), F.least(F.lit(0.99), mean - F.floor(mean)))
    level = F.col("_q") * mean / (1 - mean)
    return out.withColumn("_b", F.floor(level / (1 + level) * BUCKETS).cast("int"))


def _cut(ranked: DataFrame, budget: str) -> DataFrame:
    """_source, cut (the last row that is taken, in order), used: rows in order while the words stay within the budget."""
    order, source = Window.partitionBy("source"), F.col("source").alias("_source")
    sums = ranked.groupBy("source", "_b").agg(F.sum("size").alias("_words"), F.first(budget).alias("_budget"))
    sums = sums.withColumn("_before", F.sum("_words").over(order.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_words"))
    last = sums.where("_before <= _budget").groupBy(source).agg(F.max(F.struct("_b", "_before")).alias("_at")).select("_source", F.col("_at._b").alias("_b2"), F.col("_at._before").alias("_before"))
    last = materialize(last, "mix-buckets")  # a row a source
    inside = ranked.join(last, ranked["source"].eqNullSafe(last["_source"]) & (ranked["_b"] == last["_b2"]))
    kinds = inside.groupBy("source", "_b", "_before", F.col(budget).alias("_budget"), "_q", "_id", "size").agg(F.count(F.lit(1)).alias("_n"))
    words = F.col("size") * F.col("_n")
    kinds = kinds.withColumn("_start", F.col("_before") + F.sum(words).over(order.orderBy("_q", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - words)
    fits = F.col("_start") + words <= F.col("_budget")
    part = F.floor((F.col("_budget") - F.col("_start")) / F.col("size")).cast("long")
    none = F.struct(F.col("_b"), F.lit(-1.0).alias("_q"), F.lit(-(1 << 63)).alias("_id"), F.lit(-1).cast("long").alias("size"), F.lit(0).cast("long").alias("_tag"))
    whole = F.struct("_b", "_q", "_id", "size", F.lit((1 << 63) - 1).alias("_tag"))
    ends = kinds.groupBy(source).agg(
        F.coalesce(F.max(F.when(fits, whole)), F.max(none)).alias("_full"),
        F.coalesce(F.max(F.when(fits, F.col("_start") + words)), F.max("_before")).alias("_used"),
        F.min(F.when(~fits, F.struct("_q", "_id", "size", "_start", part.alias("_m")))).alias("_next"),
    )
    ends = materialize(ends, "mix-ends")  # a row a source
    # Of the first kind that doesn't fit, the _m rows of the smallest tags: first their bucket, then their place in it.
    split = ends.where("_next._m > 0").select("_source", F.col("_next._q").alias("_q2"), F.col("_next._id").alias("_id2"), F.col("_next.size").alias("_size2"), F.col("_next._m").alias("_m"))
    rows = ranked.join(split, ranked["source"].eqNullSafe(split["_source"]) & (ranked["_q"] == split["_q2"]) & (ranked["_id"] == split["_id2"]) & (ranked["size"] == split["_size2"]))
    rows = rows.select("_source", "_b", "_q", "_id", "size", "_tag", "_m", F.shiftright("_tag", 54).alias("_t"))
    per = Window.partitionBy("_source").orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tags = rows.groupBy("_source", "_t").agg(F.count(F.lit(1)).alias("_n"), F.first("_m").alias("_m")).withColumn("_k", F.col("_m") - (F.sum("_n").over(per) - F.col("_n"))).where("_k BETWEEN 1 AND _n")
    tags = tags.select(F.col("_source").alias("_s"), F.col("_t").alias("_t2"), "_k")
    found = rows.join(tags, rows["_source"].eqNullSafe(tags["_s"]) & (rows["_t"] == tags["_t2"])).withColumn("_r", F.row_number().over(Window.partitionBy("_source", "_t").orderBy("_tag"))).where("_r = _k")
    found = found.select(F.col("_source").alias("_s"), F.struct("_b", "_q", "_id", "size", "_tag").alias("_part"), (F.col("_m") * F.col("size")).alias("_more"))
    out = ends.join(found, ends["_source"].eqNullSafe(found["_s"]), "left")
    return out.select("_source", F.coalesce("_part", "_full").alias("cut"), (F.col("_used") + F.coalesce("_more", F.lit(0))).alias("used"))


def _after(cut: str) -> Column:
    """Whether a row comes after the cut-off; all do where there is none."""
    return F.col(cut).isNull() | (F.struct("_b", "_q", "_id", "size", "_tag") > F.col(cut))


def plan_of(docs: DataFrame, seed: int = SEED, weight: str | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, _weighted, cut1, left1, cut2 from docs (doc_id, source, size, _tag of row_tag, any weight): a row a source."""
    plan = targets(docs, weights, share, most)
    own = F.lit(1) if weight is None else F.col(weight)
    mass = docs.groupBy(F.col("source").alias("_source")).agg(F.sum(own * F.col("size")).cast("double").alias("_weighted"))
    plan = materialize(plan.join(mass, plan["source"].eqNullSafe(mass["_source"])).drop("_source"), "mix-targets")
    ranked = _with_rank(docs, plan, seed, weight)
    sure = ranked.groupBy("source").agg(F.sum(F.col("_whole") * F.col("size")).alias("_sure"))
    sure = materialize(sure, "mix-sure").withColumnRenamed("source", "_source")
    plan = plan.join(sure, plan["source"].eqNullSafe(sure["_source"]), "left").drop("_source").withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.coalesce("_sure", F.lit(0)))).drop("_sure")
    first = _cut(_with_rank(docs, plan, seed, weight).where("_q is not null"), "_rest").select("_source", F.col("cut").alias("cut1"), F.col("used").alias("_used"))
    plan = plan.join(first, plan["source"].eqNullSafe(first["_source"]), "left").drop("_source").withColumn("left1", F.col("_rest") - F.coalesce("_used", F.lit(0))).drop("_used", "_rest")
    plan = materialize(plan, "mix-first")
    rest = _with_rank(docs, plan, seed, weight).where("_q is not null").where(_after("cut1") & (F.col("size") <= F.col("left1")))
    second = _cut(rest, "left1").select("_source", F.col("cut").alias("cut2"))
    return materialize(plan.join(second, plan["source"].eqNullSafe(second["_source"]), "left").drop("_source"), "mix-plan")


def copies(docs: DataFrame, plan: DataFrame, seed: int = SEED, weight: str | None = None) -> DataFrame:
    """docs (with doc_id, source, size, _tag) plus the plan's columns and `copies`, row by row."""
    out = _with_rank(docs, plan, seed, weight)
    one = F.col("_q").isNotNull() & (~_after("cut1") | ((F.col("size") <= F.col("left1")) & ~_after("cut2")))
    return out.withColumn("copies", F.col("_whole") + F.when(F.coalesce(one, F.lit(False)), 1).otherwise(0)).drop("_q", "_b", "_id", "_tag", "_whole", "_copies", "cut1", "cut2", "left1", "_weighted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = row_tag(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"), "_tag")
    docs = materialize(docs, "mix-sizes")
    return copies(docs, plan_of(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER a - cap)) / sum(w) OVER b AS level FROM w
  WINDOW a AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size, CASE WHEN m IS NULL THEN cap ELSE least(m * w, cap) END AS target
  FROM (SELECT *, max(level) FILTER (level <= cap / w) OVER () AS m FROM l)),
c AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(2.0::DOUBLE, t.target / t.source_size) ELSE 0.0::DOUBLE END AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(copies) AS whole, CASE WHEN copies - floor(copies) > 0 THEN (u / (1 - u)) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) END AS q FROM c),
r AS (SELECT *, greatest(0.0, target - sum(whole * size) OVER (PARTITION BY source)) AS rest FROM q),
f AS (SELECT *, q IS NOT NULL AND sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, coalesce(doc_id, -9223372036854775808), size ROWS UNBOUNDED PRECEDING) <= rest AS one FROM r),
g AS (SELECT *, rest - coalesce(sum(size) FILTER (one) OVER (PARTITION BY source), 0) AS left1 FROM f),
h AS (SELECT *, NOT one AND q IS NOT NULL AND size <= left1 AS fits FROM g),
i AS (SELECT *, fits AND sum(size) OVER (PARTITION BY source, fits ORDER BY q, coalesce(doc_id, -9223372036854775808), size ROWS UNBOUNDED PRECEDING) <= left1 AS two FROM h)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN one OR two THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM i
"""
