"""Temporal segments: windows, gaps, anchors, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import segment
from graphloom.functions.rand import uniform_sql
from graphloom.operators import cluster, detect, joins, validate, windows
from graphloom.plans.base import DETECTIONS, ITEMS, SEGMENTS, detections, items, query, read, segments, truths
from graphloom.sources.readers import class_dictionary
from graphloom.streaming.windows import event_windows

WIN, STEP = 2304, 576
WITH = f"WITH {SEGMENTS}, {ITEMS}"
FORWARD = f"fwd AS (SELECT item, length, st AS win_start, least(st + {WIN}, length) AS win_end FROM (SELECT item, length, unnest(generate_series(0, greatest(0, length - {WIN}), {STEP})) AS st FROM items))"
BACKWARD = f"bwd AS (SELECT item, length, en - {WIN} AS win_start, en AS win_end FROM (SELECT item, length, unnest(generate_series(length, {WIN}, -{STEP})) AS en FROM items WHERE length >= {WIN}))"
BOTH = f"{FORWARD}, {BACKWARD}, wins AS (SELECT *, 'forward' AS direction FROM fwd UNION ALL SELECT *, 'backward' FROM bwd)"
KEPT = """joined AS (SELECT w.*, seg.id, seg.s, seg.e, seg.cls FROM wins w JOIN seg USING (item) WHERE seg.s < w.win_end AND seg.e > w.win_start),
ratios AS (SELECT *, greatest(s, win_start::DOUBLE) AS cs, least(e, win_end::DOUBLE) AS ce, (least(e, win_end::DOUBLE) - greatest(s, win_start::DOUBLE)) / (e - s) AS r FROM joined),
kept AS (SELECT * FROM ratios WHERE CASE WHEN direction = 'forward' THEN e - s >= 3 AND r >= 0.7 ELSE e - s > 3 AND r > 0.7 END)"""


@query(f"{WITH}, {FORWARD} SELECT * FROM fwd")
def w1_windows_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.forward(items(segments(spark, sf_dir)), WIN, STEP)


@query(f"{WITH}, {BACKWARD} SELECT * FROM bwd")
def w2_windows_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.backward(items(segments(spark, sf_dir)), WIN, STEP).select("item", "length", "win_start", "win_end")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    wins = windows.both(items(seg), WIN, STEP)
    joined = joins.interval(wins, seg.select("item", "id", "s", "e", "cls"), "item", ("win_start", "win_end"), ("s", "e"), bucket=float(WIN))
    return windows.keep_segments(joined, F.col("direction"))


@query(f"""{WITH}, {BOTH}, {KEPT} SELECT item, win_start, win_end, direction, count(*) AS n, round(sum(ce - cs), 6) AS covered,
round(sum((cs - win_start) / 3.0), 6) AS sum_x1, round(sum((ce - win_start) / 3.0), 6) AS sum_x2, CAST(max(cls) AS BIGINT) AS max_cls FROM kept GROUP BY ALL""")
def w1_w2_j1_window_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _kept(spark, sf_dir)
    x1, x2 = (segment.relative(F.col(c), F.col("win_start"), F.lit(3.0)) for c in ("s", "e"))
    return rows.groupBy("item", "win_start", "win_end", "direction").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("e") - F.col("s")), 6).alias("covered"), F.round(F.sum(x1), 6).alias("sum_x1"), F.round(F.sum(x2), 6).alias("sum_x2"), F.max("cls").alias("max_cls"))


@query(f"{WITH}, {BOTH} SELECT w.item, win_start, win_end, direction, id FROM wins w JOIN seg ON w.item = seg.item WHERE s < win_end AND e > win_start")
def j1_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    wins = windows.both(items(seg), WIN, STEP)
    return joins.interval(wins, seg.select("item", "id", "s", "e"), "item", ("win_start", "win_end"), ("s", "e"), bucket=float(WIN)).select("item", "win_start", "win_end", "direction", "id")


@query(f"{WITH}, {BOTH} SELECT item, win_start, win_end, direction, f.flipped FROM wins, (VALUES (false), (true)) f(flipped)")
def w3_p9_unlabelled_windows_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    wins = windows.both(items(segments(spark, sf_dir)), WIN, STEP)
    return wins.select("item", "win_start", "win_end", "direction", F.explode(F.array(F.lit(False), F.lit(True))).alias("flipped"))


@query(f"""{WITH}, {BOTH}, ranked AS (SELECT *, row_number() OVER (ORDER BY item, direction DESC, CASE WHEN direction = 'forward' THEN win_start ELSE -win_end END) AS rn FROM wins)
SELECT item, win_start, win_end, direction FROM ranked WHERE rn <= 1000""")
def w4_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.budgeted(items(segments(spark, sf_dir)), WIN, STEP, 2001, "item").select("item", "win_start", "win_end", "direction")


GAPS = """g0 AS (SELECT item, s, e, lag(e) OVER w AS past, lead(s) OVER w IS NULL AS last FROM seg WINDOW w AS (PARTITION BY item ORDER BY s, e)),
gaps AS (SELECT item, 0.0::DOUBLE AS gap_start, s AS gap_end FROM g0 WHERE past IS NULL AND s <> 0 UNION ALL SELECT item, past, s FROM g0 WHERE s > past UNION ALL SELECT item, e, e + 30 FROM g0 WHERE last)"""


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where(F.pmod("id", F.lit(3)) == 0)


SPARSE = WITH.replace("WHERE e > m)", "WHERE e > m AND event_id % 3 = 0)")


@query(f"{SPARSE}, {GAPS} SELECT * FROM gaps")
def w5_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.gaps(_sparse(spark, sf_dir), "item")


@query(f"""{SPARSE}, {GAPS}, cut AS (SELECT gaps.*, length, CAST(least(gap_end, length) AS BIGINT) - 16 AS stop, CAST(gap_start AS BIGINT) AS first FROM gaps JOIN items USING (item))
SELECT item, tile_start, tile_start + 16 AS tile_end FROM (SELECT item, unnest(range(first, stop, 16)) AS tile_start FROM cut WHERE first < stop)""")
def w6_l14_gap_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _sparse(spark, sf_dir)
    return windows.tiles(windows.gaps(seg, "item").join(items(seg), "item")).select("item", "tile_start", "tile_end")


@query("""WITH f AS (SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events),
g AS (SELECT item, unnest(range(24)) AS pos FROM (SELECT DISTINCT item FROM f))
SELECT item, pos, last_value(value IGNORE NULLS) OVER (PARTITION BY item ORDER BY pos) AS value FROM g LEFT JOIN (SELECT * FROM f WHERE pos % 3 <> 2) USING (item, pos)""")
def w7_pad_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = read(spark, sf_dir, "events").select(F.col("user_id").alias("item"), (F.row_number().over(w) - 1).cast("long").alias("pos"), "value")
    return windows.pad_tail(f.where("pos % 3 <> 2"), "item", "pos", "value", 24)


SCALES = [2, 4, 8, 16]
ANCHORS = "anc AS (SELECT CAST(sc AS BIGINT) AS scale, 3.5 - (8.0 * sc - 1) * 0.5 AS a1, 3.5 + (8.0 * sc - 1) * 0.5 AS a2 FROM (VALUES (2), (4), (8), (16)) t(sc))"


@query(f"WITH {ANCHORS} SELECT scale, a1::DOUBLE AS a1, a2::DOUBLE AS a2 FROM anc")
def w8_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.anchors(spark.range(1), 8, SCALES).withColumn("scale", F.col("scale").cast("long"))


@query(f"""{WITH}, {ANCHORS}, cells AS (SELECT item, length, unnest(range(length // 64)) AS cell FROM items)
SELECT item, scale, count(*) AS n, sum((a1 + cell * 64)::DOUBLE) AS sum_a1, min((a2 + cell * 64)::DOUBLE) AS min_a2 FROM cells, anc WHERE a1 + cell * 64 >= 0 AND a2 + cell * 64 < length GROUP BY item, scale""")
def w9_l5_anchor_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(segments(spark, sf_dir)).withColumn("cells", F.floor(F.col("length") / 64).cast("int")).where("cells > 0")
    rows = windows.inside(windows.tile_anchors(windows.anchors(spark.range(1), 8, SCALES), it, 64))
    return rows.groupBy("item", F.col("scale").cast("long").alias("scale")).agg(F.count(F.lit(1)).alias("n"), F.sum("a1").alias("sum_a1"), F.min("a2").alias("min_a2"))


@query(f"""{SPARSE}, on_ AS (SELECT DISTINCT item, unnest(range(least(greatest(floor(s / 512), 0), 63)::BIGINT, least(least(greatest(floor(e / 512), 0), 64), 63)::BIGINT + 1)) AS cell FROM seg),
grid AS (SELECT DISTINCT item, unnest(range(64)) AS cell FROM seg)
SELECT grid.item, grid.cell, CAST(CASE WHEN on_.cell IS NULL THEN 0 ELSE 1 END AS BIGINT) AS mask FROM grid LEFT JOIN on_ USING (item, cell)""")
def w12_mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _sparse(spark, sf_dir)
    return windows.mask_cells(seg, seg, "item", 512, 64).select("item", F.col("cell").cast("long").alias("cell"), F.col("mask").cast("long").alias("mask"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the segments of their item that they overlap (inclusive ends)."""
    seg = segments(spark, sf_dir)
    d = detections(seg).select("item", F.col("id").alias("aid"), F.col("x1").alias("a1"), F.col("x2").alias("a2"), (F.col("x2") + 1).alias("_a3"))
    g = seg.select("item", F.col("id").alias("gid"), F.col("s").alias("g1"), F.col("e").alias("g2"), (F.col("e") + 1).alias("_g3"))
    return joins.interval(d, g, "item", ("a1", "_a3"), ("g1", "_g3"), bucket=float(WIN)).drop("_a3", "_g3")


PAIRS = f"{WITH}, {DETECTIONS}, pairs AS (SELECT det.item, det.id AS aid, x1 AS a1, x2 AS a2, seg.id AS gid, s AS g1, e AS g2 FROM det JOIN seg ON det.item = seg.item WHERE x1 < e + 1 AND x2 + 1 > s)"
IOU = "CASE WHEN a2 - a1 + 1 = 1 THEN -1.0 WHEN g2 - g1 + 1 = 1 THEN 0.0 ELSE greatest(least(a2, g2) - greatest(a1, g1) + 1, 0) / ((a2 - a1 + 1) + (g2 - g1 + 1) - greatest(least(a2, g2) - greatest(a1, g1) + 1, 0)) END::DOUBLE"


@query(f"{PAIRS} SELECT item, aid, gid, round({IOU}, 9) AS iou FROM pairs")
def j3_segment_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("item", "aid", "gid", F.round(segment.iou(F.col("a1"), F.col("a2"), F.col("g1"), F.col("g2")), 9).alias("iou"))


ENCODED = "enc AS (SELECT *, ((g1 + (g2 - g1 + 1) * 0.5) - (a1 + (a2 - a1 + 1) * 0.5)) / (a2 - a1 + 1) AS dx, ln((g2 - g1 + 1) / (a2 - a1 + 1)) AS dl FROM pairs)"


@query(f"{PAIRS}, {ENCODED} SELECT item, aid, gid, round(dx, 6) AS dx, round(dl, 6) AS dl, round((dx - 0.1) / 0.2, 6) AS ndx FROM enc")
def p3_p6_segment_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dl = segment.encode(*(F.col(c) for c in ("a1", "a2", "g1", "g2")))
    return _pairs(spark, sf_dir).select("item", "aid", "gid", F.round(dx, 6).alias("dx"), F.round(dl, 6).alias("dl"), F.round(segment.normalize(dx, 0.1, 0.2), 6).alias("ndx"))



@query(f"""{WITH}, {DETECTIONS}, dec AS (SELECT det.*, length, (id % 9 - 4) / 8.0 * (x2 - x1 + 1) + x1 + (x2 - x1 + 1) * 0.5 AS c, exp((id % 5 - 2) / 4.0) * (x2 - x1 + 1) AS l FROM det JOIN items USING (item))
SELECT item, id, round(c - l * 0.5, 6) AS x1, round(c + l * 0.5, 6) AS x2, round(least(greatest(c - l * 0.5, 0), length - 1), 6) AS cx1, round(least(greatest(c + l * 0.5, 0), length - 1), 6) AS cx2 FROM dec""")
def p4_p5_segment_decode_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    rows = detections(seg).join(items(seg), "item")
    x1, x2 = segment.decode(F.col("x1"), F.col("x2"), (F.pmod("id", F.lit(9)) - 4) / 8.0, (F.pmod("id", F.lit(5)) - 2) / 4.0)
    return rows.select("item", "id", F.round(x1, 6).alias("x1"), F.round(x2, 6).alias("x2"), F.round(segment.clip(x1, F.col("length")), 6).alias("cx1"), F.round(segment.clip(x2, F.col("length")), 6).alias("cx2"))


@query(f"{WITH} SELECT item, id, s * 25.0 AS f1, e * 25.0 AS f2, e - s AS len FROM seg")
def p11_g22_frames_and_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("item", "id", segment.to_frames(F.col("s")).alias("f1"), segment.to_frames(F.col("e")).alias("f2"), (F.col("e") - F.col("s")).alias("len"))


@query(f"{WITH} SELECT event_type AS label, CAST(cls AS BIGINT) AS cls FROM kinds UNION ALL SELECT 'Background', 0")
def p13_class_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_dictionary(read(spark, sf_dir, "events"), "event_type")


@query(f"{WITH}, b AS (SELECT round_even(e - s, 0) AS bin, count(*) AS n FROM seg GROUP BY 1) SELECT bin + 0.5 AS bin, round(n * 100.0 / sum(n) OVER (), 9) AS share FROM b")
def g21_duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = segments(spark, sf_dir).groupBy(F.bround(F.col("e") - F.col("s")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return b.join(F.broadcast(b.agg(F.sum("n").alias("t")))).select((F.col("bin") + 0.5).alias("bin"), F.round(F.col("n") * 100.0 / F.col("t"), 9).alias("share"))


@query(f"{WITH}, b AS (SELECT n AS segments, count(*) AS items FROM (SELECT item, count(*) AS n FROM seg GROUP BY item) GROUP BY n) SELECT segments, round(items * 100.0 / sum(items) OVER (), 9) AS share FROM b")
def g21_segments_per_item_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = segments(spark, sf_dir).groupBy("item").agg(F.count(F.lit(1)).alias("segments")).groupBy("segments").agg(F.count(F.lit(1)).alias("items"))
    return b.join(F.broadcast(b.agg(F.sum("items").alias("t")))).select("segments", F.round(F.col("items") * 100.0 / F.col("t"), 9).alias("share"))


LLOYD = """l{n} AS (SELECT p.id, len, arg_min(k, (abs(len - c), k)) AS label FROM pts p, c{n} GROUP BY p.id, len),
c{m} AS (SELECT k, coalesce(avg(len), 0.0) AS c FROM c{n} LEFT JOIN l{n} ON label = k GROUP BY k)"""


@query(f"""{WITH}, pts AS (SELECT id, e - s AS len FROM seg), c0 AS (SELECT row_number() OVER (ORDER BY {uniform_sql(3, 'id')}, id) - 1 AS k, len AS c FROM pts QUALIFY k < 5),
{', '.join(LLOYD.format(n=k, m=k + 1) for k in range(3))}, l3 AS (SELECT p.id, len, arg_min(k, (abs(len - c), k)) AS label FROM pts p, c3 GROUP BY p.id, len)
SELECT CAST(label AS BIGINT) AS label, count(*) AS n, min(len) AS least, max(len) AS most FROM l3 GROUP BY label""")
def g23_segment_length_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = segments(spark, sf_dir).select("id", F.array(F.col("e") - F.col("s")).alias("v"))
    labelled, centers, _ = cluster.lloyd(pts, cluster.seed_centers(pts, 5, 3), rounds=3, tol=0.0)
    return labelled.groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min(F.get("v", F.lit(0))).alias("least"), F.max(F.get("v", F.lit(0))).alias("most"))


@query(f"{WITH}, a AS (SELECT * FROM seg WHERE id % 2 = 0 AND item % 3 = 0), b AS (SELECT * FROM seg WHERE id % 2 = 1) SELECT item, id, s, e, cls FROM a UNION ALL SELECT item, id, s, e, cls FROM b WHERE item IN (SELECT item FROM a)")
def j8_append_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir).select("item", "id", "s", "e", "cls")
    return joins.append_known(seg.where("id % 2 = 0 and item % 3 = 0"), seg.where("id % 2 = 1"), "item")


@query(f"{WITH}, a AS (SELECT * FROM seg WHERE id % 2 = 0), b AS (SELECT * FROM seg WHERE id % 2 = 1 AND item % 3 = 0) SELECT item, id, s, e, cls FROM b UNION ALL SELECT item, id, s, e, cls FROM a WHERE item NOT IN (SELECT item FROM b)")
def j10_right_biased_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir).select("item", "id", "s", "e", "cls")
    return joins.right_biased(seg.where("id % 2 = 0"), seg.where("id % 2 = 1 and item % 3 = 0"), "item")


@query(f"{WITH} SELECT item, id, row_number() OVER (PARTITION BY item ORDER BY s, id) AS pos FROM seg WHERE item IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def r1_l12_sorted_segments_of_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("item"))
    rows = segments(spark, sf_dir).join(known, "item", "left_semi")
    return rows.select("item", "id", F.row_number().over(Window.partitionBy("item").orderBy("s", "id")).cast("long").alias("pos"))


@query("WITH ids AS (SELECT DISTINCT substr(p_name, 1, 8) AS id FROM part), names AS (SELECT DISTINCT p_name AS name FROM part), h AS (SELECT id, count(*) AS n, min(name) AS name FROM ids JOIN names ON contains(name, id) GROUP BY id) SELECT id, name FROM h WHERE n = 1")
def l13_single_substring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return joins.contains_once(p.select(F.substring("p_name", 1, 8).alias("id")).distinct(), p.select(F.col("p_name").alias("name")).distinct())


@query(f"{WITH} SELECT item, id, s, e FROM seg WHERE cls = 2 AND item % 2 = 0")
def l15_subset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where("cls = 2 and item % 2 = 0").select("item", "id", "s", "e")


@query(f"""{WITH}, {DETECTIONS}, anchors AS (SELECT item, id, x1 AS a1, x2 AS a2 FROM det), tr AS (SELECT item, gid, g1, g2 FROM gt),
p AS (SELECT a.*, g1, g2, {IOU} AS iou FROM anchors a JOIN tr USING (item)), q AS (SELECT *, max(iou) OVER (PARTITION BY item, g1, g2) AS gmax FROM p),
b AS (SELECT item, id, a1, a2, max(iou) AS best, max(CASE WHEN iou = gmax AND gmax > 0 THEN 1 ELSE 0 END) AS isb FROM q GROUP BY ALL)
SELECT item, id, round(best, 9) AS best_iou, CAST(CASE WHEN best >= 0.7 OR isb = 1 THEN 1 WHEN best < 0.3 THEN 0 ELSE -1 END AS BIGINT) AS label FROM b""")
def n5_anchor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    a = detections(seg).select("item", "id", F.col("x1").alias("a1"), F.col("x2").alias("a2"))
    out = detect.anchor_labels(a, truths(seg).select("item", "gid", "g1", "g2"), bucket=float(WIN))
    return out.select("item", "id", F.round("best_iou", 9).alias("best_iou"), F.col("label").cast("long").alias("label"))


@query(f"""{WITH}, {DETECTIONS}, tr AS (SELECT item, gid, g1, g2 FROM gt), rois AS (SELECT item, 'r' || id AS id, x1 AS a1, x2 AS a2 FROM det UNION ALL SELECT item, 'g' || gid, g1, g2 FROM tr),
p AS (SELECT r.*, gid, {IOU} AS iou FROM rois r JOIN tr USING (item)), b AS (SELECT item, id, max(iou) AS best, arg_max(gid, (iou, -gid)) AS gid FROM p GROUP BY item, id)
SELECT item, id, round(best, 9) AS best_iou, gid, CASE WHEN best >= 0.5 THEN 'fg' WHEN best >= 0.1 THEN 'bg' ELSE 'none' END AS kind FROM b""")
def n6_roi_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    rois = detections(seg).select("item", "id", F.col("x1").alias("a1"), F.col("x2").alias("a2"))
    out = detect.candidates(rois, truths(seg).select("item", "gid", "g1", "g2"), bucket=float(WIN))
    return out.select("item", "id", F.round("best_iou", 9).alias("best_iou"), "gid", "kind")


LABELLED = f"""{WITH}, {DETECTIONS}, anchors AS (SELECT item, id, x1 AS a1, x2 AS a2 FROM det), tr AS (SELECT item, gid, g1, g2 FROM gt),
p AS (SELECT a.*, g1, g2, {IOU} AS iou FROM anchors a JOIN tr USING (item)), q AS (SELECT *, max(iou) OVER (PARTITION BY item, g1, g2) AS gmax FROM p),
b AS (SELECT item, id, max(iou) AS best, max(CASE WHEN iou = gmax AND gmax > 0 THEN 1 ELSE 0 END) AS isb FROM q GROUP BY ALL),
l AS (SELECT item, id, CASE WHEN best >= 0.7 OR isb = 1 THEN 1 WHEN best < 0.3 THEN 0 ELSE -1 END AS label FROM b)"""


@query(f"""{LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY item, label ORDER BY {uniform_sql(0, 'item', 'id')}, id) AS k, least(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY item), 8) AS fg FROM l)
SELECT item, id, CAST(CASE WHEN (label = 1 AND k > fg) OR (label = 0 AND k > 16 - fg) THEN -1 ELSE label END AS BIGINT) AS label FROM r""")
def n5_subsampled_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    a = detections(seg).select("item", "id", F.col("x1").alias("a1"), F.col("x2").alias("a2"))
    out = detect.subsample(detect.anchor_labels(a, truths(seg).select("item", "gid", "g1", "g2"), bucket=float(WIN)), batch=16)
    return out.select("item", "id", F.col("label").cast("long").alias("label"))


@query(f"""{WITH}, {DETECTIONS}, tr AS (SELECT item, gid, g1, g2 FROM gt), rois AS (SELECT item, 'r' || id AS id, x1 AS a1, x2 AS a2 FROM det UNION ALL SELECT item, 'g' || gid, g1, g2 FROM tr),
p AS (SELECT r.*, gid, {IOU} AS iou FROM rois r JOIN tr USING (item)), b AS (SELECT item, id, max(iou) AS best FROM p GROUP BY item, id),
c AS (SELECT item, id, CASE WHEN best >= 0.5 THEN 'fg' WHEN best >= 0.1 THEN 'bg' ELSE 'none' END AS kind FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY item, kind ORDER BY {uniform_sql(0, 'item', 'id')}, id) AS k FROM c WHERE kind <> 'none'),
n AS (SELECT item, sum(CASE WHEN kind = 'fg' THEN 1 ELSE 0 END) AS nf, sum(CASE WHEN kind = 'bg' THEN 1 ELSE 0 END) AS nb FROM k GROUP BY item),
s AS (SELECT item, nf, nb, unnest(range(1, 17)) AS slot FROM n), t AS (SELECT *, CASE WHEN nf = 0 THEN 'bg' WHEN nb = 0 THEN 'fg' WHEN slot <= least(nf, 4) THEN 'fg' ELSE 'bg' END AS kind FROM s),
u AS (SELECT *, CASE WHEN kind = 'fg' AND nb > 0 THEN slot ELSE floor({uniform_sql(0, 'item', 'slot')} * CASE WHEN kind = 'fg' THEN nf ELSE nb END) + 1 END AS pick FROM t)
SELECT u.item, CAST(slot AS BIGINT) AS slot, u.kind, id FROM u JOIN k ON k.item = u.item AND k.kind = u.kind AND k.k = u.pick""")
def n6_sampled_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    rois = detections(seg).select("item", "id", F.col("x1").alias("a1"), F.col("x2").alias("a2"))
    return detect.sample_rois(detect.candidates(rois, truths(seg).select("item", "gid", "g1", "g2"), bucket=float(WIN)), batch=16).select("item", F.col("slot").cast("long").alias("slot"), "kind", "id")



@query(f"""{LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY item, label ORDER BY {uniform_sql(0, 'item', 'id')}, id) AS k, least(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY item), 8) AS fg FROM l),
f AS (SELECT item, CASE WHEN (label = 1 AND k > fg) OR (label = 0 AND k > 16 - fg) THEN -1 ELSE label END AS label FROM r),
n AS (SELECT item, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fg, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bg, CAST(sum(CASE WHEN label = -1 THEN 1 ELSE 0 END) AS BIGINT) AS ignored FROM f GROUP BY item)
SELECT *, round(1.0 / (fg + bg), 9) AS weight FROM n""")
def g24_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.batch_summary(n5_subsampled_anchors(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(f"{WITH} SELECT CAST(count(*) AS BIGINT) AS bad FROM seg WHERE e <= s")
def v8_segment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.bad_segments(segments(spark, sf_dir)).agg(F.count(F.lit(1)).alias("bad"))


@query("""WITH w AS (SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS st, ts FROM events)
SELECT event_type, epoch_us(st) // 60000000 AS start_minute, count(*) AS n, round(sum(value), 6) AS total FROM w WHERE ts >= st AND ts < st + INTERVAL 12 HOUR GROUP BY ALL""")
def streaming_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the streaming operator on a batch frame; minutes are those of the session's clock."""
    ev = read(spark, sf_dir, "events").withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))
    out = event_windows(ev, "12 hours", "6 hours")
    return out.select("event_type", F.expr("unix_micros(win_start) div 60000000").alias("start_minute"), "n", F.round("total", 6).alias("total"))
