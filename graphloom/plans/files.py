"""Sources and sinks: tables written in each format to the shared folder and read back by its reader."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import voxel
from graphloom.operators import windows
from graphloom.operators.checkpoints import cached, fresh_path
from graphloom.plans.base import BOXES, EDGES, ITEMS, POINTS, SEGMENTS, boxes, items, part_edges, points, query, read, segments
from graphloom.plans.samples import GRID, _voxels
from graphloom.sources import readers as R
from graphloom.sources import writers as W

WITH = f"WITH {SEGMENTS}, {ITEMS}"


def _lines(df: DataFrame, *parts) -> DataFrame:  # noqa: ANN002
    return df.select(F.concat_ws(" ", *parts).alias("value"))


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def s1_csv_with_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "s1")
    read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_acctbal as balance", "c_mktsegment as segment").write.csv(path, header=True)
    return R.csv(spark, path, "id long, balance double, segment string")


@query("SELECT p_name AS name FROM part")
def s2_csv_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "s2")
    read(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_name as name").write.csv(path, header=True)
    return R.csv(spark, path, "id long, name string").select("name")


@query(f"{WITH} SELECT CAST(item AS VARCHAR) AS video, CAST(length AS DOUBLE) AS length, s, e, CAST(cls AS BIGINT) AS cls FROM seg JOIN items USING (item)")
def s3_packed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, path = segments(spark, sf_dir), fresh_path(spark, "s3")
    action = F.concat_ws(" ", F.format_string("c%03d", F.col("cls") - 1), F.col("s").cast("string"), F.col("e").cast("string"))
    packed = seg.groupBy("item").agg(F.concat_ws(";", F.collect_list(action)).alias("actions")).join(items(seg), "item")
    packed.select(F.col("item").alias("id"), F.col("length").cast("double").alias("length"), "actions").write.csv(path, header=True)
    return R.packed_actions(spark, path).withColumn("cls", F.col("cls").cast("long"))


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def s4_tab_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "s4")
    part_edges(spark, sf_dir).select("src", "dst").write.csv(path, sep="\t")
    return R.edges(spark, path)


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """The classes as read from a list file, and their rows (five)."""
    kinds = read(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()
    path = f"{fresh_path(spark, 's5')}/classes.txt"
    W.one_file(spark.createDataFrame([(f"{k + 1} {r['event_type']}",) for k, r in enumerate(kinds)], "value string").coalesce(1), path)
    return R.class_list(spark, path, ambiguous=99), [r["event_type"] for r in kinds]


@query(f"{WITH} SELECT CAST(cls AS BIGINT) AS cls, event_type AS name FROM kinds UNION ALL SELECT 99, 'Ambiguous'")
def s5_class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir)[0].select(F.col("cls").cast("long").alias("cls"), "name")


@query(f"{WITH} SELECT CAST(item AS VARCHAR) AS video, s, e, CAST(cls AS BIGINT) AS cls FROM seg")
def s5_class_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, names = _classes(spark, sf_dir)
    folder, seg = fresh_path(spark, "s5"), segments(spark, sf_dir)
    for k, name in enumerate(names):  # a file a class
        W.one_file(_lines(seg.where(F.col("cls") == k + 1), "item", "s", "e"), f"{folder}/{name}_val.txt")
    return R.class_segments(spark, f"{folder}/*.txt", classes).withColumn("cls", F.col("cls").cast("long"))


@query(f"{WITH} SELECT CAST(item AS VARCHAR) AS video, 1.0::DOUBLE AS s, 1.0::DOUBLE AS e, 1::BIGINT AS cls FROM items")
def s6_unlabelled_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "s6")
    items(segments(spark, sf_dir)).select(F.col("item").cast("string").alias("value")).write.text(path)
    return R.unlabelled_videos(spark, path).withColumn("cls", F.col("cls").cast("long"))


@query(f"{WITH} SELECT CAST(item AS VARCHAR) AS video, s, e, CAST(cls AS BIGINT) AS cls FROM seg")
def s7_k3_segment_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "s7")
    W.segment_dump(segments(spark, sf_dir).withColumn("video", F.col("item").cast("string")), path)
    return R.paired_segments(spark, path).withColumn("cls", F.col("cls").cast("long"))


@query(f"{WITH} SELECT CAST(item AS VARCHAR) AS video, CASE WHEN item % 2 = 0 THEN 'training' ELSE 'validation' END AS subset, CAST(length AS DOUBLE) AS duration, s, e, event_type AS label FROM seg JOIN items USING (item) JOIN kinds USING (cls) WHERE item % 2 = 0")
def s8_activity_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a group of videos, as the format nests videos in a map; the subset filter is the reader's."""
    seg, path = segments(spark, sf_dir), fresh_path(spark, "s8")
    kinds = _classes(spark, sf_dir)[0].select(F.col("cls").cast("long").alias("cls"), "name")
    rows = seg.join(F.broadcast(kinds), "cls").groupBy("item").agg(F.collect_list(F.struct(F.array("s", "e").alias("segment"), F.col("name").alias("label"))).alias("annotations")).join(items(seg), "item")
    subset = F.when(F.col("item") % 2 == 0, "training").otherwise("validation")
    rows = rows.select(F.pmod("item", F.lit(16)).alias("g"), F.col("item").cast("string").alias("video"), F.struct(subset.alias("subset"), F.col("length").cast("double").alias("duration"), F.lit("u").alias("url"), "annotations").alias("i"))
    rows.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("video", "i"))).alias("database")).select("database").write.option("maxRecordsPerFile", 1).json(path)
    return R.activity_json(spark, path, "training")


# ---- annotations in XML and JSON, an image an order -----------------------------------------------------------------

DIFFICULT = "CASE WHEN part % 4 = 1 THEN 1 ELSE 0 END"


def _annotations(spark: SparkSession, sf_dir: str, wnid: bool = False) -> DataFrame:
    """Objects of each order's boxes as read from XML; where part % 4 is 0 no `difficult` is written; relations come twice."""
    path, part = fresh_path(spark, "xml"), F.col("part")
    name = F.format_string("n%08d", "cls") if wnid else F.element_at(F.array(F.lit("A"), F.lit("N "), F.lit("R")), F.col("cls").cast("int"))
    attributes = F.array(F.concat(F.lit("X"), F.pmod(part, F.lit(5))), F.lit("odd"), F.concat(F.lit("Y"), F.pmod("id", F.lit(3))))
    corner = F.struct(F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    one = F.struct(F.col("id").alias("object_id"), name.alias("name"), F.when(F.pmod(part, F.lit(4)) > 0, (F.pmod(part, F.lit(4)) == 1).cast("int")).alias("difficult"), attributes.alias("attribute"), corner.alias("bndbox"))
    rows = boxes(spark, sf_dir).groupBy("item").agg(F.array_sort(F.collect_list(one)).alias("object"))
    predicate = lambda k: F.when(k % 3 == 0, "On").when(k % 3 == 1, "near").otherwise("odd")
    relation = F.transform(F.filter(F.sequence(F.lit(1).cast("long"), F.size("object").cast("long")), lambda k: k < F.size("object")), lambda k: F.struct(k.alias("subject_id"), predicate(k).alias("predicate"), (k + 1).alias("object_id")))
    rows = rows.select(F.col("item").cast("string").alias("filename"), F.struct(F.lit(50).alias("width"), F.lit(40).alias("height")).alias("size"), "object", F.concat(relation, relation).alias("relation"))
    rows.write.format("xml").option("rootTag", "annotations").option("rowTag", "annotation").save(path)
    return R.voc_objects(spark, path)


@query(f"WITH {BOXES} SELECT CAST(item AS VARCHAR) AS image, 50::BIGINT AS width, 40::BIGINT AS height, id - 1 AS pos, id AS object_id, CASE cls WHEN 1 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END AS name, CASE WHEN part % 4 = 0 THEN -1 WHEN part % 4 = 1 THEN 1 ELSE 0 END::BIGINT AS difficult, x1 AS xmin, y1 AS ymin, x2 AS xmax, y2 AS ymax FROM box")
def s9_voc_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _annotations(spark, sf_dir)
    longs = (F.col(c).cast("long").alias(c) for c in ("width", "height", "pos", "object_id"))
    return o.select("image", *longs, F.trim("name").alias("name"), F.coalesce("difficult", F.lit(-1)).cast("long").alias("difficult"), "bndbox.*")


def _voc(shift: int, where: str = "true") -> str:
    return f"WITH {BOXES} SELECT CAST(item AS VARCHAR) AS image, x1 - {shift} AS x1, y1 - {shift} AS y1, x2 - {shift} AS x2, y2 - {shift} AS y2, cls, CAST({DIFFICULT} AS BIGINT) AS difficult, (x2 - x1 + 1) * (y2 - y1 + 1) AS area FROM box WHERE {where}"


def _boxes(objects: DataFrame, names: list[str], shift: int, use_difficult: bool) -> DataFrame:
    classes = objects.sparkSession.createDataFrame([(n, k + 1) for k, n in enumerate(names)], "name string, cls long")
    return R.voc_boxes(objects, classes, shift, use_difficult).select("image", "x1", "y1", "x2", "y2", "cls", F.col("difficult").cast("long").alias("difficult"), "area")


@query(_voc(1))
def s10_voc_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(_annotations(spark, sf_dir), ["a", "n", "r"], 1, True)


@query(_voc(1, f"{DIFFICULT} = 0"))
def s11_voc_boxes_without_difficult(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(_annotations(spark, sf_dir), ["a", "n", "r"], 1, False)


@query(_voc(0))
def s12_boxes_by_wnid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(_annotations(spark, sf_dir, wnid=True), [f"n{k:08d}" for k in (1, 2, 3)], 0, True)


KNOWN = ["x0", "x1", "x2", "y1"]
SCENE = f"""scene AS (SELECT CAST(item AS VARCHAR) AS image, id AS object_id, cls, greatest(0.0::DOUBLE, x1) AS x1, greatest(0.0::DOUBLE, y1) AS y1, least(x2, 49.0::DOUBLE) AS x2, least(y2, 39.0::DOUBLE) AS y2,
list_filter(['x' || (part % 5), 'odd', 'y' || (id % 3)], lambda a: list_contains({KNOWN}, a)) AS attrs FROM box WHERE cls <= 2)"""


def _scene(spark: SparkSession, objects: DataFrame) -> DataFrame:
    vocabulary = spark.createDataFrame([("a", 1), ("n", 2)], "name string, cls long")
    return R.scene_objects(objects, vocabulary, spark.createDataFrame([(k,) for k in KNOWN], "name string"))


@query(f"WITH {BOXES}, {SCENE} SELECT image, object_id, cls, x1, y1, CASE WHEN x2 < x1 THEN 49.0 ELSE x2 END::DOUBLE AS x2, CASE WHEN y2 < y1 THEN 49.0 ELSE y2 END::DOUBLE AS y2, array_to_string(attrs, ',') AS attributes FROM scene")
def s13_scene_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene(spark, _annotations(spark, sf_dir)).withColumn("attributes", F.concat_ws(",", "attributes"))


@query(f"WITH {BOXES}, {SCENE} SELECT a.image, a.object_id AS subject, CASE WHEN a.object_id % 3 = 0 THEN 4 ELSE 5 END::BIGINT AS predicate, b.object_id AS object FROM scene a JOIN scene b ON b.image = a.image AND b.object_id = a.object_id + 1 WHERE a.object_id % 3 < 2")
def s13_j11_scene_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _annotations(spark, sf_dir)
    return R.scene_relations(objects, _scene(spark, objects), spark.createDataFrame([("on", 4), ("near", 5)], "name string, cls long"))


@query("SELECT lower(n_name) AS name, CAST(n_nationkey + 1 AS BIGINT) AS cls FROM nation UNION ALL SELECT 'n' || n_nationkey, n_nationkey + 1 FROM nation")
def s14_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{fresh_path(spark, 's14')}/vocabulary.txt"
    W.one_file(read(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.concat(F.col("n_name"), F.lit(" , N"), F.col("n_nationkey")).alias("value")), path)
    return R.synonyms(spark, path).withColumn("cls", F.col("cls").cast("long"))


@query(f"""WITH {BOXES}, c AS (SELECT item, item * 1000 + id AS id, cls, part, greatest(0.0::DOUBLE, x1 - 3) AS x1, y1, x2 - x1 + 1 AS w, y2 - y1 + 1 AS h FROM box WHERE part % 11 <> 0),
b AS (SELECT *, least(39.0::DOUBLE, x1 + greatest(0.0::DOUBLE, w - 1)) AS x2, least(29.0::DOUBLE, y1 + greatest(0.0::DOUBLE, h - 1)) AS y2 FROM c)
SELECT item AS image, id, cls, x1, y1, x2, y2, CASE WHEN part % 7 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS overlap FROM b WHERE x2 >= x1 AND y2 >= y1""")
def s15_coco_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of images and annotations, 16 of them, as the format nests a data set in one."""
    path, b = fresh_path(spark, "s15"), boxes(spark, sf_dir)
    w, h = F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1
    one = F.struct((F.col("item") * 1000 + F.col("id")).alias("id"), F.col("item").alias("image_id"), F.col("cls").cast("int").alias("category_id"), (F.pmod("part", F.lit(7)) == 0).cast("int").alias("iscrowd"), F.when(F.pmod("part", F.lit(11)) == 0, 0.0).otherwise(w * h).alias("area"), F.array(F.col("x1") - 3, F.col("y1"), w, h).alias("bbox"))
    image = F.struct(F.col("item").alias("id"), F.lit(40).alias("width"), F.lit(30).alias("height"))
    b.groupBy(F.pmod("item", F.lit(16)).alias("g")).agg(F.collect_set(image).alias("images"), F.collect_list(one).alias("annotations")).drop("g").write.option("maxRecordsPerFile", 1).json(path)
    return R.coco_boxes(spark, path).withColumn("cls", F.col("cls").cast("long"))


@query(f"{WITH} SELECT item, count(*) AS n, sum(e - s) AS covered, CAST(max(cls) AS BIGINT) AS most FROM seg GROUP BY item")
def s17_k2_window_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with nested segments, stored as Parquet; pickles are never read."""
    path = fresh_path(spark, "s17")
    W.table(segments(spark, sf_dir).groupBy("item").agg(F.collect_list(F.struct("s", "e", "cls")).alias("segments")), path)
    one = spark.read.parquet(path).select("item", F.explode("segments").alias("x")).select("item", "x.*")
    return one.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("covered"), F.max("cls").alias("most"))


def _image_set(spark: SparkSession, sf_dir: str) -> str:
    path = f"{fresh_path(spark, 's18')}/set.txt"
    W.one_file(read(spark, sf_dir, "documents").coalesce(1).sortWithinPartitions("doc_id").select(F.concat(F.lit("img_"), F.col("doc_id")).alias("value")), path)
    return path


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, 'img_' || doc_id AS image FROM documents")
def s18_image_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.image_set(spark, _image_set(spark, sf_dir))


@query("SELECT pos, image FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, 'img_' || doc_id AS image, doc_id FROM documents) WHERE pos < 100 AND doc_id IN (SELECT doc_id FROM labels)")
def s18_first_images_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format's prefix of a set (its minimal split), then images with an annotation."""
    known = read(spark, sf_dir, "labels").select(F.concat(F.lit("img_"), F.col("doc_id")).alias("image"))
    return R.image_set(spark, _image_set(spark, sf_dir), 100).join(known, "image", "left_semi").select("pos", "image")


@query("SELECT 'region=' || n_regionkey AS video, count(*) AS frames FROM nation GROUP BY n_regionkey")
def s20_frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "s20")
    read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), "n_name").write.option("maxRecordsPerFile", 1).partitionBy("region").text(path)
    return R.frame_counts(spark, path)


@query(f"WITH {GRID} SELECT CAST(id AS VARCHAR) AS name, z, y, x, val, CASE WHEN (z + y + x) % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS seg FROM vox")
def s21_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, v = fresh_path(spark, "s21"), _voxels(spark, sf_dir)
    v = v.withColumn("seg", F.when((F.col("z") + F.col("y") + F.col("x")) % 2 == 0, 1.0).otherwise(0.0))
    W.volumes(v, path, (8, 8, 8)).write.format("noop").mode("overwrite").save()
    return R.volumes(spark, f"{path}/*.npz")


NAMES = """SELECT 'voc_' || y || '_' || s AS name FROM (VALUES ('2007'), ('2012')) a(y), (VALUES ('train'), ('val'), ('trainval'), ('test')) b(s)
UNION ALL SELECT 'coco_2014_' || s FROM (VALUES ('train'), ('val'), ('minival'), ('valminusminival'), ('trainval'), ('capval'), ('valminuscapval')) b(s)
UNION ALL SELECT 'coco_2015_' || s FROM (VALUES ('test'), ('test-dev')) b(s)
UNION ALL SELECT 'vg_' || v || '_' || s FROM (VALUES ('150-50-20'), ('150-50-50'), ('500-150-80'), ('750-250-150'), ('1750-700-450'), ('1600-400-20')) a(v), (VALUES ('minitrain'), ('smalltrain'), ('train'), ('minival'), ('smallval'), ('val'), ('test')) b(s)
UNION ALL SELECT 'imagenet_' || s FROM (VALUES ('train'), ('val'), ('val1'), ('val2'), ('test')) b(s)"""


@query(NAMES)
def s22_registered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = R.Registry.standard({f: (lambda s, version, split: s.range(0)) for f, *_ in R.FAMILIES})
    return spark.createDataFrame([(n,) for n in reg.names()], "name string")


@query(f"{WITH} SELECT item, p AS pos, least(p, length // 64) AS frame FROM items, range(32) t(p)")
def s23_frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of an item's frames (one each 64 minutes) fill a window of 32: those it has, then its last one again."""
    own = items(segments(spark, sf_dir)).select("item", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(31).cast("long"), F.floor(F.col("length") / 64)))).alias("pos"))
    return windows.pad_tail(own.withColumn("frame", F.col("pos")), "item", "pos", "frame", 32)


# ---- sinks ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id, coalesce(lang, '-') AS category FROM documents")
def k1_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "k1")
    W.submission(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("-")).alias("category")), path)
    return R.csv(spark, path, "id long, category string")


@query(f"WITH {BOXES} SELECT cls, CAST(item AS VARCHAR) AS image, score, x1 + 1 AS x1, y1 + 1 AS y1, x2 + 1 AS x2, y2 + 1 AS y2 FROM box")
def k4_voc_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "k4")
    W.voc_results(boxes(spark, sf_dir).withColumn("image", F.col("item").cast("string")), path)
    rows = spark.read.schema("value string, cls long").text(path).select("cls", F.split("value", " ").alias("x"))
    numbers = (F.get("x", F.lit(k + 1)).cast("double").alias(n) for k, n in enumerate(("score", "x1", "y1", "x2", "y2")))
    return rows.select("cls", F.get("x", F.lit(0)).alias("image"), *numbers)


@query(f"WITH {BOXES} SELECT item AS image_id, cls AS category_id, x1 AS x, y1 AS y, x2 - x1 + 1 AS w, y2 - y1 + 1 AS h, score FROM box")
def k5_coco_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "k5")
    W.coco_results(boxes(spark, sf_dir).withColumn("image", F.col("item")), path)
    rows = spark.read.schema("image_id long, category_id long, bbox array<double>, score double").json(path)
    return rows.select("image_id", "category_id", *(F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")), "score")


@query(f"WITH {BOXES} SELECT CAST(cls AS VARCHAR) AS cls, round(max(score) / 2, 3) AS threshold FROM box GROUP BY cls")
def k6_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "k6")
    W.thresholds(boxes(spark, sf_dir).groupBy("cls").agg((F.max("score") / 2).alias("threshold")), path)
    return spark.read.text(path).select(F.split("value", " ").alias("x")).select(F.get("x", F.lit(0)).alias("cls"), F.get("x", F.lit(1)).cast("double").alias("threshold"))


@query(f"{WITH} SELECT item, length FROM items")
def k7_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second call finds the table and never makes it."""
    path = fresh_path(spark, "k7")
    cached(spark, path, lambda: items(segments(spark, sf_dir)))

    def never() -> DataFrame:
        raise AssertionError("made twice")

    return cached(spark, path, never)


@query(f"{WITH} SELECT event_id, CAST(cls - 1 AS DOUBLE) AS idx FROM events JOIN kinds USING (event_type)")
def k8_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, ev = fresh_path(spark, "k8"), read(spark, sf_dir, "events").select("event_id", "event_type")
    W.model(StringIndexer(inputCol="event_type", outputCol="idx", stringOrderType="alphabetAsc").fit(ev), path)
    return StringIndexerModel.load(path).transform(ev).select("event_id", "idx")


@query(f"WITH {POINTS} SELECT CAST(id AS VARCHAR) AS token, len(v) AS size, round(list_sum(v), 6) AS total, v[1] AS first, v[-1] AS last FROM pts")
def k8_embedding_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "k8")
    W.embedding_text(points(spark, sf_dir).select(F.col("id").cast("string").alias("token"), F.col("v").alias("vec")), path)
    v = R.embedding_text(spark, path)
    return v.select("token", F.size("vec").cast("long").alias("size"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.get("vec", F.lit(0)).alias("first"), F.element_at("vec", -1).alias("last"))


@query("SELECT c_name AS name, substr(c_name, 1, 10) AS p1, substr(c_name, 1, 14) AS p2 FROM customer")
def k9_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "k9")
    W.by_prefix(read(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), path, lengths=(10, 14))
    return spark.read.schema("name string, p1 string, p2 string").parquet(path)


# ---- what else had no entry ----------------------------------------------------------------------------------------


@query(f"WITH {GRID}, t AS (SELECT id, z, y, x FROM (SELECT DISTINCT id FROM vox) i, range(5) a(z), range(10) b(y), range(8) c(x)) SELECT t.id, t.z, t.y, t.x, v.val FROM t JOIN vox v ON v.id = t.id AND v.z = CAST(floor((t.z + 0.5) * 8 / 5) AS BIGINT) AND v.y = CAST(floor((t.y + 0.5) * 8 / 10) AS BIGINT) AND v.x = t.x")
def p24_resampled_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.resample_nearest(_voxels(spark, sf_dir), (8, 8, 8), (5, 10, 8))


@query("SELECT s_suppkey AS id, '[' || 1 || ', ' || (s_suppkey % 5) || ', 8]' AS front, '[' || (s_suppkey % 5) || ', 8, 1]' AS back FROM supplier")
def p27_channel_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.array(F.pmod("s_suppkey", F.lit(5)).cast("int"), F.lit(8))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), voxel.with_channel(shape).cast("string").alias("front"), voxel.with_channel(shape, 2).cast("string").alias("back"))
