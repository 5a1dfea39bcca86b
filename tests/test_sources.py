"""Readers and writers on small literal files."""

import json

import numpy as np
import pytest

from graphloom.sources import readers as R
from graphloom.sources import writers as W


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_csv_and_edges(spark, tmp_path):
    p = put(tmp_path / "a.csv", "id,label\n1,x\n2,y\n")
    assert [tuple(r) for r in R.csv(spark, p, "id long, label string").select("label").collect()] == [("x",), ("y",)]
    assert sorted(map(tuple, R.edges(spark, put(tmp_path / "e.tsv", "1\t2\n1\t2\n3\t4\n")).collect())) == [(1, 2), (1, 2), (3, 4)]


def test_packed_actions(spark, tmp_path):
    p = put(tmp_path / "a.csv", "id,length,actions\nv1,30.5,c001 1.0 2.0;c015 3 4.5\nv2,10,\n")
    assert sorted(map(tuple, R.packed_actions(spark, p).collect())) == [("v1", 30.5, 1.0, 2.0, 2), ("v1", 30.5, 3.0, 4.5, 16)]
    assert R.packed_actions(spark, p, keep_empty=True).count() == 3


def test_class_segments(spark, tmp_path):
    put(tmp_path / "seg" / "Jump_val.txt", "video_1  1.5 2.5\nvideo_2 0 1\n")
    put(tmp_path / "seg" / "Ambiguous_val.txt", "video_1 7 8\n")
    classes = R.class_list(spark, put(tmp_path / "classes.txt", "7 Jump\n8 Run\n"), ambiguous=21)
    got = R.class_segments(spark, str(tmp_path / "seg" / "*.txt"), classes).collect()
    assert sorted(map(tuple, got)) == [("video_1", 1.5, 2.5, 7), ("video_1", 7.0, 8.0, 21), ("video_2", 0.0, 1.0, 7)]
    assert [tuple(r) for r in R.unlabelled_videos(spark, put(tmp_path / "t.txt", "v9\n\n")).collect()] == [("v9", 1.0, 1.0, 1)]


def test_paired_segments_round_trip(spark, tmp_path):
    p = put(tmp_path / "s.txt", "video_a\n[[1, 1, 1]]\n\nvideo_b\n[[0.5, 2, 3], [4, 5, 6]]\n\n")
    want = [("video_a", 1.0, 1.0, 1), ("video_b", 0.5, 2.0, 3), ("video_b", 4.0, 5.0, 6)]
    rows = R.paired_segments(spark, p)
    assert sorted(map(tuple, rows.collect())) == want
    W.segment_dump(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, R.paired_segments(spark, str(tmp_path / "out")).collect())) == want


def test_activity_json_and_dictionary(spark, tmp_path):
    doc = {"database": {"v1": {"subset": "training", "duration": 9.5, "url": "u", "annotations": [{"segment": [1, 2.5], "label": "Run"}, {"segment": [3, 4], "label": "Jump"}]}, "v2": {"subset": "testing", "duration": 1.0, "url": "u", "annotations": []}}}
    rows = R.activity_json(spark, put(tmp_path / "a.json", json.dumps(doc, indent=1)), "training")
    assert sorted((r["video"], r["s"], r["e"], r["label"]) for r in rows.collect()) == [("v1", 1.0, 2.5, "Run"), ("v1", 3.0, 4.0, "Jump")]
    assert sorted(map(tuple, R.class_dictionary(rows).collect())) == [("Background", 0), ("Jump", 1), ("Run", 2)]


XML = """<annotation><filename>a.jpg</filename><size><width>20</width><height>10</height></size>
<object><name>Cat</name><difficult>1</difficult><object_id>1</object_id><attribute>Red</attribute><attribute>odd</attribute><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>5</xmax><ymax>6</ymax></bndbox></object>
<object><name>dog </name><object_id>2</object_id><bndbox><xmin>-3</xmin><ymin>4</ymin><xmax>50</xmax><ymax>9</ymax></bndbox></object>
<relation><subject_id>1</subject_id><predicate>On</predicate><object_id>2</object_id></relation>
<relation><subject_id>1</subject_id><predicate>On</predicate><object_id>2</object_id></relation>
<relation><subject_id>1</subject_id><predicate>near</predicate><object_id>9</object_id></relation></annotation>"""


def test_voc_and_scene_xml(spark, tmp_path):
    objects = R.voc_objects(spark, put(tmp_path / "a.xml", XML))
    classes = spark.createDataFrame([("cat", 1), ("dog", 2)], "name string, cls int")
    got = R.voc_boxes(objects, classes).select("image", "cls", "x1", "y1", "x2", "y2", "difficult", "area").collect()
    assert sorted(map(tuple, got)) == [("a.jpg", 1, 0.0, 1.0, 4.0, 5.0, 1, 25.0), ("a.jpg", 2, -4.0, 3.0, 49.0, 8.0, 0, 324.0)]
    assert R.voc_boxes(objects, classes, use_difficult=False).count() == 1
    assert R.voc_boxes(objects, classes, shift=0).where("cls = 1").first()["x1"] == 1.0
    vocab = R.synonyms(spark, put(tmp_path / "v.txt", "cat,kitty\ndog\n"))
    assert sorted(map(tuple, vocab.collect())) == [("cat", 1), ("dog", 2), ("kitty", 1)]
    kept = R.scene_objects(objects, vocab, spark.createDataFrame([("red",), ("blue",)], "name string"))
    rows = {r["object_id"]: r for r in kept.collect()}
    assert rows[1]["attributes"] == ["red"] and (rows[2]["x1"], rows[2]["x2"], rows[2]["y2"]) == (0.0, 19.0, 9.0)
    rel = R.scene_relations(objects, kept, spark.createDataFrame([("on", 4), ("near", 5)], "name string, cls int"))
    assert [tuple(r) for r in rel.collect()] == [("a.jpg", 1, 4, 2)]


def test_coco_round_trip(spark, tmp_path):
    doc = {"images": [{"id": 1, "width": 100, "height": 50}], "annotations": [{"id": 5, "image_id": 1, "category_id": 3, "iscrowd": 0, "area": 20, "bbox": [-2, 3, 10, 5]}, {"id": 6, "image_id": 1, "category_id": 3, "iscrowd": 1, "area": 9, "bbox": [90, 40, 30, 30]}, {"id": 7, "image_id": 1, "category_id": 3, "iscrowd": 0, "area": 0, "bbox": [1, 1, 2, 2]}]}
    boxes = R.coco_boxes(spark, put(tmp_path / "c.json", json.dumps(doc)))
    assert sorted((r["id"], r["x1"], r["y1"], r["x2"], r["y2"], r["overlap"]) for r in boxes.collect()) == [(5, 0.0, 3.0, 9.0, 7.0, 1.0), (6, 90.0, 40.0, 99.0, 49.0, -1.0)]
    W.coco_results(boxes.selectExpr("image", "cls", "x1", "y1", "x2", "y2", "0.5D as score"), str(tmp_path / "r"))
    assert sorted(r["bbox"] for r in spark.read.json(str(tmp_path / "r")).collect()) == [[0.0, 3.0, 10.0, 5.0], [90.0, 40.0, 10.0, 10.0]]


def test_image_sets_and_frames(spark, tmp_path):
    assert [r["image"] for r in R.image_set(spark, put(tmp_path / "i.txt", "a\nb\nc\n"), 2).collect()] == ["a", "b"]
    for v, n in (("v1", 3), ("v2", 1)):
        for k in range(n):
            put(tmp_path / "frames" / v / f"{k}.jpg", "x")
    assert {tuple(r) for r in R.frame_counts(spark, str(tmp_path / "frames")).collect()} == {("v1", 3), ("v2", 1)}


def test_volumes(spark, tmp_path):
    v = np.arange(24).reshape(2, 3, 4)
    np.savez(tmp_path / "c1.npz", voxel=v, seg=v % 2)
    rows = R.volumes(spark, str(tmp_path / "*.npz")).collect()
    assert len(rows) == 24 and all(r["val"] == v[r["z"], r["y"], r["x"]] and r["seg"] == r["val"] % 2 and r["name"] == "c1" for r in rows)


def test_registry(spark):
    reg = R.Registry()
    reg.add("ten", lambda s: s.range(10))
    assert reg.get(spark, "ten").count() == 10
    with pytest.raises(KeyError, match="ten"):
        reg.get(spark, "other")


def test_writers(spark, tmp_path):
    W.submission(spark.createDataFrame([(2, "b"), (1, "a")], "id long, category string"), str(tmp_path / "s"))
    assert next((tmp_path / "s").glob("*.csv")).read_text() == "id,category\n1,a\n2,b\n"
    W.voc_results(spark.createDataFrame([("cat", "i1", 0.12345, 0.0, 1.0, 2.0, 3.0)], "cls string, image string, score double, x1 double, y1 double, x2 double, y2 double"), str(tmp_path / "v"))
    assert next((tmp_path / "v" / "cls=cat").glob("*.txt")).read_text() == "i1 0.123 1.0 2.0 3.0 4.0\n"
    W.thresholds(spark.createDataFrame([("cat", 0.5)], "cls string, threshold double"), str(tmp_path / "t"))
    assert next((tmp_path / "t").glob("*.txt")).read_text() == "cat 0.500\n"
    W.by_prefix(spark.createDataFrame([("a" * 14 + "b" * 10,)], "name string"), str(tmp_path / "p"))
    assert (tmp_path / "p" / f"p1={'a' * 14}" / f"p2={'a' * 14 + 'b' * 8}").is_dir()
    W.table(spark.range(3), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 3
