"""Readers with explicit schemas; nothing is inferred and nothing is unpickled."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.prefix import running


def csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, sep=sep)


def edges(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """src, dst from lines without a header."""
    return csv(spark, path, "src long, dst long", header=False, sep=sep)


def packed_actions(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """video, length, s, e, cls from a CSV whose `actions` are `c001 1.0 2.0;c002 ...`; the class is its number + 1."""
    rows = csv(spark, path, "id string, length double, actions string")
    parts = F.filter(F.split(F.coalesce("actions", F.lit("")), ";"), lambda x: F.trim(x) != "")
    explode = F.explode_outer if keep_empty else F.explode
    rows = rows.select(F.col("id").alias("video"), "length", explode(parts).alias("a")).withColumn("a", F.split(F.trim("a"), " +"))
    return rows.select("video", "length", F.get("a", F.lit(1)).cast("double").alias("s"), F.get("a", F.lit(2)).cast("double").alias("e"), (F.substring(F.get("a", F.lit(0)), 2, 10).cast("int") + 1).alias("cls"))


def _file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def class_list(spark: SparkSession, path: str, ambiguous: int | None = None) -> DataFrame:
    """cls, name from lines `id name`; ambiguous adds that class as `Ambiguous`."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") >= 2)
    rows = rows.select(F.get("x", F.lit(0)).cast("int").alias("cls"), F.get("x", F.lit(1)).alias("name"))
    return rows if ambiguous is None else rows.unionByName(spark.range(1).select(F.lit(ambiguous).alias("cls"), F.lit("Ambiguous").alias("name")))


def class_segments(spark: SparkSession, glob: str, classes: DataFrame, suffix: str = "_.*$") -> DataFrame:
    """video, s, e, cls from one text file a class (its name is the file's, without suffix) with lines `video s e`."""
    rows = spark.read.text(glob).select(F.regexp_replace(_file_stem(), suffix, "").alias("name"), F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") >= 3)
    rows = rows.select("name", F.get("x", F.lit(0)).alias("video"), F.get("x", F.lit(1)).cast("double").alias("s"), F.get("x", F.lit(2)).cast("double").alias("e"))
    return rows.join(F.broadcast(classes), "name").select("video", "s", "e", "cls")


def unlabelled_videos(spark: SparkSession, path: str) -> DataFrame:
    """video with the placeholder segment (1, 1, class 1)."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("video"), F.lit(1.0).alias("s"), F.lit(1.0).alias("e"), F.lit(1).alias("cls"))


def paired_segments(spark: SparkSession, path: str) -> DataFrame:
    """video, s, e, cls from blocks of a name line and a `[[s, e, c], ...]` line, blank lines between."""
    rows = spark.read.option("lineSep", "\n\n").text(path).select(F.split(F.trim("value"), "\n").alias("x")).where(F.size("x") >= 2)
    rows = rows.select(F.trim(F.get("x", F.lit(0))).alias("video"), F.explode(F.from_json(F.get("x", F.lit(1)), "array<array<double>>")).alias("a"))
    return rows.select("video", F.get("a", F.lit(0)).alias("s"), F.get("a", F.lit(1)).alias("e"), F.get("a", F.lit(2)).cast("int").alias("cls"))


ACTIVITY = "database map<string, struct<subset: string, duration: double, url: string, annotations: array<struct<segment: array<double>, label: string>>>>"


def activity_json(spark: SparkSession, path: str, subset: str | None = None) -> DataFrame:
    """video, subset, duration, s, e, label from one nested JSON document."""
    rows = spark.read.schema(ACTIVITY).json(path, multiLine=True).select(F.explode("database").alias("video", "i"))
    if subset is not None:
        rows = rows.where(F.col("i.subset") == subset)
    rows = rows.select("video", F.col("i.subset").alias("subset"), F.col("i.duration").alias("duration"), F.explode("i.annotations").alias("a"))
    return rows.select("video", "subset", "duration", F.get("a.segment", F.lit(0)).alias("s"), F.get("a.segment", F.lit(1)).alias("e"), F.col("a.label").alias("label"))


def class_dictionary(labels: DataFrame, column: str = "label") -> DataFrame:
    """label, cls: sorted distinct labels from 1, and Background as 0."""
    ranked = labels.select(F.col(column).alias("label")).distinct().withColumn("cls", F.row_number().over(Window.orderBy("label")).cast("long"))
    return ranked.unionByName(labels.sparkSession.range(1).select(F.lit("Background").alias("label"), F.lit(0).cast("long").alias("cls")))


VOC = "struct<filename: string, size: struct<width: int, height: int>, object: array<struct<name: string, pose: string, truncated: int, difficult: int, object_id: long, attribute: array<string>, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>, relation: array<struct<subject_id: long, predicate: string, object_id: long>>>"


def voc_objects(spark: SparkSession, path: str) -> DataFrame:
    """image, width, height, pos and the object's fields: one row an object of each `annotation` element."""
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(spark.range(1).select(F.from_json(F.lit("{}"), VOC).alias("x")).select("x.*").schema).load(path)
    rows = rows.select(F.col("filename").alias("image"), F.col("size.width").alias("width"), F.col("size.height").alias("height"), F.posexplode("object").alias("pos", "o"), "relation")
    return rows.select("image", "width", "height", "pos", "o.*", "relation")


def voc_boxes(objects: DataFrame, classes: DataFrame, shift: int = 1, use_difficult: bool = True) -> DataFrame:
    """image, x1, y1, x2, y2, cls, difficult, area: corners less `shift` (1 for 1-based files, else 0); a missing difficult is 0."""
    hard = F.coalesce("difficult", F.lit(0))
    rows = objects.withColumn("difficult", hard) if use_difficult else objects.where(hard == 0).withColumn("difficult", hard)
    b = {k: F.col(f"bndbox.{f}") - shift for k, f in (("x1", "xmin"), ("y1", "ymin"), ("x2", "xmax"), ("y2", "ymax"))}
    rows = rows.select("image", "width", "height", F.lower(F.trim("name")).alias("name"), "difficult", *(v.alias(k) for k, v in b.items())).join(F.broadcast(classes), "name")
    return rows.withColumn("area", (F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)).drop("name")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos (from 0), value: one file's lines in order, read in splits; positions are running sums by split."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    rows = running(rows, [], {"_split": F.col("_start")}, [F.col("_split")], [F.col("_row")], {"pos": F.lit(1).cast("long")})
    return rows.select((F.col("pos") - 1).alias("pos"), "value")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """name, cls: a line's comma-separated names share its number, from 1; 0 is kept for the background."""
    rows = numbered_lines(spark, path).select(F.explode(F.split("value", ",")).alias("name"), (F.col("pos") + 1).cast("int").alias("cls"))
    return rows.select(F.lower(F.trim("name")).alias("name"), "cls").where("name <> ''")


def scene_objects(objects: DataFrame, vocabulary: DataFrame, attributes: DataFrame, most: int = 16) -> DataFrame:
    """In-vocabulary objects with clipped boxes and at most `most` known attributes, in their order.

    A corner beyond its side falls back to the last column; y2's fallback uses the width, as the source data's reader did.
    """
    known = attributes.agg(F.collect_set("name").alias("_known"))
    rows = objects.withColumn("name", F.lower(F.trim("name"))).join(F.broadcast(vocabulary), "name").join(F.broadcast(known))
    attrs = F.slice(F.filter(F.transform(F.coalesce("attribute", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a))), lambda a: F.array_contains("_known", a)), 1, most)
    w = F.col("width") - 1
    x1, y1 = F.greatest(F.lit(0.0), F.col("bndbox.xmin")), F.greatest(F.lit(0.0), F.col("bndbox.ymin"))
    x2, y2 = F.least(F.col("bndbox.xmax"), w.cast("double")), F.least(F.col("bndbox.ymax"), (F.col("height") - 1).cast("double"))
    return rows.select("image", "object_id", "cls", x1.alias("x1"), y1.alias("y1"), F.when(x2 < x1, w.cast("double")).otherwise(x2).alias("x2"), F.when(y2 < y1, w.cast("double")).otherwise(y2).alias("y2"), attrs.alias("attributes"))


def scene_relations(objects: DataFrame, kept: DataFrame, predicates: DataFrame) -> DataFrame:
    """image, subject, predicate, object: distinct known triples between kept objects; others are dropped."""
    rows = objects.select("image", F.explode("relation").alias("r")).select("image", F.col("r.subject_id").alias("subject"), F.lower(F.trim("r.predicate")).alias("name"), F.col("r.object_id").alias("object")).distinct()
    rows = rows.join(F.broadcast(predicates.select("name", F.col("cls").alias("predicate"))), "name")
    ids = kept.select("image", F.col("object_id").alias("subject"))
    return rows.join(ids, ["image", "subject"], "left_semi").join(ids.withColumnRenamed("subject", "object"), ["image", "object"], "left_semi").select("image", "subject", "predicate", "object").distinct()


COCO = "images array<struct<id: long, width: int, height: int>>, annotations array<struct<id: long, image_id: long, category_id: int, iscrowd: int, area: double, bbox: array<double>>>"


def coco_boxes(spark: SparkSession, path: str) -> DataFrame:
    """image, id, cls, x1, y1, x2, y2, overlap: clipped to the image, without empty boxes; crowds have overlap -1."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select("i.*").withColumnRenamed("id", "image")
    rows = doc.select(F.explode("annotations").alias("a")).select("a.id", F.col("a.image_id").alias("image"), F.col("a.category_id").alias("cls"), "a.iscrowd", "a.area", *(F.get("a.bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")))
    rows = rows.join(images, "image")
    x1, y1 = F.greatest(F.lit(0.0), F.col("x")), F.greatest(F.lit(0.0), F.col("y"))
    x2 = F.least(F.col("width") - 1.0, x1 + F.greatest(F.lit(0.0), F.col("w") - 1))
    y2 = F.least(F.col("height") - 1.0, y1 + F.greatest(F.lit(0.0), F.col("h") - 1))
    rows = rows.select("image", "id", "cls", "area", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.when(F.col("iscrowd") == 1, -1.0).otherwise(1.0).alias("overlap"))
    return rows.where("area > 0 and x2 >= x1 and y2 >= y1").drop("area")


def image_set(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """pos, image: the file's lines in order, at most `first` of them."""
    rows = numbered_lines(spark, path).select("pos", F.trim("value").alias("image"))
    return rows if first is None else rows.where(F.col("pos") < first)


def embedding_text(spark: SparkSession, path: str) -> DataFrame:
    """token, vec from lines `token x1 x2 ...`; a first line with two numbers alone (how many, how long) is passed over."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") > 2)
    return rows.select(F.get("x", F.lit(0)).alias("token"), F.slice("x", 2, F.size("x") - 1).cast("array<double>").alias("vec"))


def frame_counts(spark: SparkSession, root: str) -> DataFrame:
    """video, frames: files a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("video")).groupBy("video").agg(F.count(F.lit(1)).alias("frames"))


def volumes(spark: SparkSession, glob: str) -> DataFrame:
    """name, z, y, x, val, seg in long form from `voxel` and `seg` arrays of .npz files; pickled content is refused."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    voxel, seg = z["voxel"], z["seg"]
                name = path.rsplit("/", 1)[-1].removesuffix(".npz")
                for k in range(voxel.shape[0]):  # a slice at a time
                    y, x = np.indices(voxel.shape[1:])
                    yield pd.DataFrame({"name": name, "z": k, "y": y.ravel(), "x": x.ravel(), "val": voxel[k].ravel().astype(float), "seg": seg[k].ravel().astype(float)})

    return files.mapInPandas(run, "name string, z long, y long, x long, val double, seg double")


#: Families of public detection sets with their versions and splits: fixed values.
FAMILIES = [
    ("voc", ("2007", "2012"), ("train", "val", "trainval", "test")),
    ("coco", ("2014",), ("train", "val", "minival", "valminusminival", "trainval", "capval", "valminuscapval")),
    ("coco", ("2015",), ("test", "test-dev")),
    ("vg", ("150-50-20", "150-50-50", "500-150-80", "750-250-150", "1750-700-450", "1600-400-20"), ("minitrain", "smalltrain", "train", "minival", "smallval", "val", "test")),
    ("imagenet", ("",), ("train", "val", "val1", "val2", "test")),
]


class Registry:
    """Tables by name: a name maps to a function of the session; unknown names list what there is."""

    def __init__(self) -> None:
        self.makers: dict = {}

    @classmethod
    def standard(cls, readers: dict) -> Registry:
        """All names of FAMILIES, as family_version_split, whose family is in readers: family -> function of (session, version, split)."""
        out = cls()
        for family, versions, splits in FAMILIES:
            for version in versions if family in readers else ():
                for split in splits:
                    out.add("_".join(x for x in (family, version, split) if x), partial(readers[family], version=version, split=split))
        return out

    def add(self, name: str, maker) -> None:  # noqa: ANN001
        self.makers[name] = maker

    def names(self) -> list[str]:
        return sorted(self.makers)

    def get(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.makers:
            raise KeyError(f"no table {name}; there are {self.names()}")
        return self.makers[name](spark)
