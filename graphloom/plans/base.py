"""Registration and the tables that queries start from, in DataFrame form and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- segments of events: from an event's minute to that of the user's next event --------------------------------

FIRST_MINUTE = 28_401_120  # 2024-01-01, in minutes since 1970


def event_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 60000000") - FIRST_MINUTE
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("item"), "event_id", "event_type", "value", minute.cast("long").alias("m"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, id, s, e, cls, score; cls numbers the event types from 1, in order."""
    w = Window.partitionBy("item").orderBy("m", "event_id")
    rows = event_minutes(spark, sf_dir).withColumn("e", F.lead("m").over(w)).where("e > m")
    kinds = read(spark, sf_dir, "events").select("event_type").distinct().withColumn("cls", F.row_number().over(Window.orderBy("event_type")).cast("long"))
    return rows.join(F.broadcast(kinds), "event_type").select("item", F.col("event_id").alias("id"), F.col("m").cast("double").alias("s"), F.col("e").cast("double").alias("e"), "cls", F.col("value").alias("score"))


SEGMENTS = f"""kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS cls FROM (SELECT DISTINCT event_type FROM events)),
mins AS (SELECT user_id AS item, event_id, event_type, value, CAST(epoch_us(ts) // 60000000 - {FIRST_MINUTE} AS BIGINT) AS m FROM events),
nexts AS (SELECT *, lead(m) OVER (PARTITION BY item ORDER BY m, event_id) AS e FROM mins),
seg AS (SELECT item, event_id AS id, CAST(m AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e, cls, value AS score FROM nexts JOIN kinds USING (event_type) WHERE e > m)"""


def items(seg: DataFrame) -> DataFrame:
    """item, length: the end of its last segment."""
    return seg.groupBy("item").agg(F.max("e").cast("long").alias("length"))


ITEMS = "items AS (SELECT item, CAST(max(e) AS BIGINT) AS length FROM seg GROUP BY item)"

# ---- detections: segments moved a little; truths: the segments themselves ------------------------------------------


def detections(seg: DataFrame) -> DataFrame:
    x1 = F.greatest(F.lit(0.0), F.col("s") + (F.pmod("id", F.lit(7)) - 3))
    return seg.select("cls", "item", "id", "score", x1.alias("x1"), F.greatest(x1, F.col("e") + (F.pmod("id", F.lit(5)) - 2)).alias("x2"))


def truths(seg: DataFrame) -> DataFrame:
    rows = seg.where(F.pmod("id", F.lit(3)) != 1)
    return rows.select("cls", "item", F.col("id").alias("gid"), F.col("s").alias("g1"), F.col("e").alias("g2"), (F.pmod("id", F.lit(11)) == 0).cast("int").alias("difficult"))


DETECTIONS = """det AS (SELECT cls, item, id, score, greatest(0.0::DOUBLE, s + (id % 7 - 3)) AS x1, greatest(greatest(0.0::DOUBLE, s + (id % 7 - 3)), e + (id % 5 - 2)) AS x2 FROM seg),
gt AS (SELECT cls, item, id AS gid, s AS g1, e AS g2, CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS difficult FROM seg WHERE id % 3 <> 1)"""

# ---- boxes from line items; truths are boxes of the same order, moved -----------------------------------------------


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").withColumn("id", F.row_number().over(w).cast("long"))
    x1, y1 = F.col("l_quantity"), F.col("l_linenumber") * 6.0
    return rows.select(F.col("l_orderkey").alias("item"), "id", x1.alias("x1"), y1.alias("y1"), (x1 + F.round(F.col("l_discount") * 100) + 2).alias("x2"), (y1 + F.round(F.col("l_tax") * 100) + 2).alias("y2"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).cast("long").alias("cls"), F.col("l_extendedprice").alias("score"), F.col("l_partkey").alias("part"))


BOXES = """box AS (SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_quantity AS x1, l_linenumber * 6.0::DOUBLE AS y1,
l_quantity + round(l_discount * 100) + 2 AS x2, l_linenumber * 6.0::DOUBLE + round(l_tax * 100) + 2 AS y2, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END::BIGINT AS cls, l_extendedprice AS score, l_partkey AS part FROM lineitem)"""


def box_truths(b: DataFrame) -> DataFrame:
    dx = (F.pmod("part", F.lit(5)) - 2).cast("double")
    rows = b.where(F.pmod("part", F.lit(2)) == 0)
    return rows.select("item", "cls", F.col("id").alias("gid"), (F.col("x1") + dx).alias("g_x1"), F.col("y1").alias("g_y1"), (F.col("x2") + dx).alias("g_x2"), (F.col("y2") + 1).alias("g_y2"), (F.pmod("part", F.lit(13)) == 0).cast("int").alias("difficult"))


BOX_TRUTHS = "bgt AS (SELECT item, cls, id AS gid, x1 + (part % 5 - 2) AS g_x1, y1 AS g_y1, x2 + (part % 5 - 2) AS g_x2, y2 + 1 AS g_y2, CASE WHEN part % 13 = 0 THEN 1 ELSE 0 END AS difficult FROM box WHERE part % 2 = 0)"
BOX_IOU = """greatest(least(x2, g_x2) - greatest(x1, g_x1) + 1, 0) * greatest(least(y2, g_y2) - greatest(y1, g_y1) + 1, 0) AS inter, (x2 - x1 + 1) * (y2 - y1 + 1) + (g_x2 - g_x1 + 1) * (g_y2 - g_y1 + 1) AS areas"""

# ---- graph of parts that follow each other in an order -----------------------------------------------------------


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w (how often): directed, without loops."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


EDGES = """follows AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem),
edges AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM follows WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""
GRAPH = EDGES + """,
graph AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(w) AS w FROM edges GROUP BY 1, 2),
sym AS (SELECT src, dst, w FROM graph UNION ALL SELECT dst, src, w FROM graph WHERE src <> dst),
nodes AS (SELECT src AS node FROM graph UNION SELECT dst FROM graph),
grp AS (SELECT node, node % 7 AS comm FROM nodes)"""


def partition(nodes: DataFrame, n: int = 7) -> DataFrame:
    return nodes.select("node", F.pmod("node", F.lit(n)).alias("comm"))


# ---- points, words, labels ------------------------------------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


POINTS = "pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings)"


def first_centers(pts: DataFrame, k: int = 5) -> DataFrame:
    return pts.where(F.col("id") < k).select(F.col("id").cast("int").alias("k"), F.col("v").alias("c"))


CENTERS = "ctr AS (SELECT id AS k, v AS c FROM pts WHERE id < 5)"
ASSIGNED = "near AS (SELECT id, k, list_distance(v, c) AS dist FROM pts, ctr), lab AS (SELECT id, arg_min(k, (dist, k)) AS label, min(dist) AS dist FROM near GROUP BY id)"

TOKENS = "tok AS (SELECT conv_id * 1000 + turn AS sentence, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM conversations))"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sentence"), "text")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, score, lang: toxicity labels with a score from the text's length."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("label")).join(d, "doc_id").select("doc_id", "label", "lang", (F.pmod("n_chars", F.lit(997)) / 997.0).alias("score"))


JUDGED = "judged AS (SELECT doc_id, CAST(toxic AS BIGINT) AS label, lang, (n_chars % 997) / 997.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
