"""Boxes and detections: geometry, suppression, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import box
from graphloom.operators import detect, evaluate, joins, validate
from graphloom.plans.base import BOX_IOU, BOX_TRUTHS, BOXES, DETECTIONS, SEGMENTS, box_truths, boxes, detections, query, segments, truths

WITH = f"WITH {BOXES}"
#: Boxes are 2 to 12 wide.
BUCKET = 16.0
MATCHED = f"""WITH {BOXES}, {BOX_TRUTHS}, pr AS (SELECT b.cls, b.item, b.id, score, gid, difficult, {BOX_IOU} FROM box b LEFT JOIN bgt g ON b.item = g.item AND b.cls = g.cls),
best AS (SELECT * FROM (SELECT *, inter / (areas - inter) AS iou, row_number() OVER (PARTITION BY item, id ORDER BY inter / (areas - inter) DESC NULLS LAST, gid) AS k FROM pr) WHERE k = 1),
hits AS (SELECT *, coalesce(iou > 0.5, false) AS hit FROM best),
flagged AS (SELECT *, CASE WHEN hit AND difficult = 1 THEN NULL WHEN hit AND row_number() OVER (PARTITION BY cls, item, gid, hit ORDER BY score DESC, id) = 1 THEN 1 ELSE 0 END AS flag FROM hits),
npos AS (SELECT cls, sum(CASE WHEN difficult = 0 THEN 1 ELSE 0 END) AS npos FROM bgt GROUP BY cls),
curve AS (SELECT f.cls, row_number() OVER w AS rank, item, id, score, sum(flag) OVER w AS tp, sum(1 - flag) OVER w AS fp, npos FROM flagged f JOIN npos USING (cls) WHERE flag IS NOT NULL WINDOW w AS (PARTITION BY f.cls ORDER BY score DESC, item, id ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT *, tp / npos AS recall, tp / (tp + fp) AS prec FROM curve)"""
AREA = "env AS (SELECT *, max(prec) OVER (PARTITION BY cls ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e, recall - coalesce(lag(recall) OVER (PARTITION BY cls ORDER BY rank), 0) AS step FROM pts), ap AS (SELECT cls, sum(step * e) AS ap FROM env GROUP BY cls)"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Detections get ids that are unique over items, in order of (item, id)."""
    b = boxes(spark, sf_dir)
    return b.withColumn("id", F.col("item") * 1000 + F.col("id")), box_truths(b)


def _curve(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    d, g = _inputs(spark, sf_dir)
    npos = evaluate.positives(g)
    return evaluate.curve(evaluate.match(evaluate.pairs_2d(d, g, BUCKET), threshold), npos), npos


@query(f"{WITH} SELECT item, id, x1, y1, x2 - x1 + 1 AS w, y2 - y1 + 1 AS h, (x2 - x1 + 1) * (y2 - y1 + 1) AS area FROM box")
def p7_p10_box_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tuple(F.col(k) for k in ("x1", "y1", "x2", "y2"))
    x, y, w, h = box.xyxy_to_xywh(*c)
    return boxes(spark, sf_dir).select("item", "id", x.alias("x1"), y.alias("y1"), w.alias("w"), h.alias("h"), box.area(*c).alias("area"))


@query(f"{WITH} SELECT item, id, false AS flipped, x1, x2 FROM box UNION ALL SELECT item, id, true, 100 - x2 - 1, 100 - x1 - 1 FROM box")
def p8_flipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select("item", "id", F.lit(False).alias("flipped"), "x1", "x2")
    x1, x2 = box.flip(F.col("x1"), F.col("x2"), F.lit(100.0))
    return b.unionByName(b.select("item", "id", F.lit(True).alias("flipped"), x1.alias("x1"), x2.alias("x2")))


@query(f"{WITH}, h AS (SELECT cls, item, id, round_even(x1 * 0.5, 0) + round_even(y1 * 0.5, 0) * 1e3 + round_even(x2 * 0.5, 0) * 1e6 + round_even(y2 * 0.5, 0) * 1e9 AS key FROM box) SELECT cls, CAST(key AS BIGINT) AS key, min(item * 1000 + id) AS first FROM h GROUP BY ALL")
def p16_unique_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = box.key(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), scale=0.5).cast("long")
    return boxes(spark, sf_dir).groupBy("cls", k.alias("key")).agg(F.min(F.col("item") * 1000 + F.col("id")).alias("first"))


@query(f"{WITH} SELECT item, id FROM box WHERE x2 - x1 + 1 >= 6 AND y2 - y1 + 1 > 6")
def l4_big_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where(box.big_enough(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), 6)).select("item", "id")


@query(f"{WITH} SELECT cls, count(*) AS n FROM box WHERE (x2 - x1 + 1) * (y2 - y1 + 1) * 100 BETWEEN 1024 AND 9216 GROUP BY cls")
def l8_area_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = box.area(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))) * 100
    return boxes(spark, sf_dir).where(evaluate.in_area(a, "medium")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BOXES}, {BOX_TRUTHS}, pr AS (SELECT b.item, b.id, gid, {BOX_IOU} FROM box b JOIN bgt g ON b.item = g.item) SELECT item, id, gid, round(inter / (areas - inter), 9) AS iou FROM pr WHERE inter > 0")
def j5_box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return joins.iou_2d(b.drop("cls"), box_truths(b).drop("cls"), ["item"], BUCKET).select("item", "id", "gid", F.round("iou", 9).alias("iou"))


@query(f"WITH {BOXES}, {BOX_TRUTHS}, pr AS (SELECT b.item, b.id, gid, g.cls, {BOX_IOU} FROM box b JOIN bgt g ON b.item = g.item), v AS (SELECT *, inter / (areas - inter) AS iou FROM pr WHERE inter > 0) SELECT item, id, arg_max(cls, (iou, -gid)) AS cls, round(max(iou), 9) AS iou FROM v GROUP BY item, id")
def e9_r7_class_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return evaluate.assign_classes(b.drop("cls"), box_truths(b), BUCKET).withColumn("iou", F.round("iou", 9))


@query(f"{MATCHED} SELECT cls, CAST(rank AS BIGINT) AS rank, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(recall, 9) AS recall, round(prec, 9) AS prec FROM pts")
def e1_precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, _ = _curve(spark, sf_dir)
    return points.select("cls", "rank", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("prec"))


@query(f"{MATCHED}, {AREA} SELECT cls, round(ap, 9) AS ap FROM ap")
def e3_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(_curve(spark, sf_dir)[0]).select("cls", F.round("ap", 9).alias("ap"))


@query(f"{MATCHED}, t AS (SELECT cls, k, coalesce(max(CASE WHEN recall >= k / 10.0::DOUBLE THEN prec END), 0) AS p FROM pts, range(11) r(k) GROUP BY cls, k) SELECT cls, round(sum(p) / 11, 9) AS ap FROM t GROUP BY cls")
def e3_eleven_point_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(_curve(spark, sf_dir)[0], "11point").select("cls", F.round("ap", 9).alias("ap"))


@query(f"{MATCHED}, {AREA} SELECT round(avg(coalesce(ap, 0)), 9) AS map, round(sum(coalesce(ap, 0) * npos) / sum(npos), 9) AS weighted_map FROM npos LEFT JOIN ap USING (cls)")
def e4_e6_mean_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, npos = _curve(spark, sf_dir)
    return evaluate.mean_ap(evaluate.average_precision(points), npos).select(F.round("map", 9).alias("map"), F.round("weighted_map", 9).alias("weighted_map"))


@query(f"{MATCHED}, f AS (SELECT cls, arg_max(score, (prec * recall / (prec + recall), -rank)) AS threshold FROM pts WHERE tp > 0 GROUP BY cls) SELECT cls, round(threshold, 6) AS threshold FROM npos LEFT JOIN f USING (cls)")
def e7_best_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, npos = _curve(spark, sf_dir)
    return evaluate.best_thresholds(points, npos).select("cls", F.round("threshold", 6).alias("threshold"))


POINTS_101 = "SELECT cls, {t} AS threshold, round(sum(p) / 101, 9) AS ap FROM (SELECT cls, k, coalesce(max(CASE WHEN recall >= k / 100.0::DOUBLE THEN prec END), 0) AS p FROM pts, range(101) r(k) GROUP BY cls, k) GROUP BY cls"


@query(" UNION ALL ".join(f"(SELECT cls, CAST(threshold AS BIGINT) AS threshold, ap FROM ({MATCHED.replace('iou > 0.5', f'iou > {t / 100}')} {POINTS_101.format(t=t)}))" for t in (50, 75, 95)))
def e10_precision_over_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our own version with 101 points; not a reimplementation of any tool."""
    d, g = _inputs(spark, sf_dir)
    npos, out = evaluate.positives(g), None
    pairs = evaluate.pairs_2d(d, g, BUCKET)
    for k in (50, 75, 95):
        one = evaluate.average_precision(evaluate.curve(evaluate.match(pairs, k / 100), npos), "101point").select("cls", F.lit(k).cast("long").alias("threshold"), F.round("ap", 9).alias("ap"))
        out = one if out is None else out.unionByName(one)
    return out


def _one_to_one(rounds: int = 8) -> str:
    """Greedy matching as rounds: edges that are the best of both their ends are taken, and what shares an end goes."""
    out = ""
    for k in range(rounds):
        out += f""", t{k} AS MATERIALIZED (SELECT * FROM e{k} QUALIFY row_number() OVER (PARTITION BY item, id ORDER BY iou DESC, gid, id) = 1 AND row_number() OVER (PARTITION BY item, gid ORDER BY iou DESC, gid, id) = 1),
e{k + 1} AS MATERIALIZED (SELECT * FROM e{k} e WHERE NOT EXISTS (SELECT 1 FROM t{k} t WHERE t.item = e.item AND (t.id = e.id OR t.gid = e.gid)))"""
    return out + ", taken AS (" + " UNION ALL ".join(f"SELECT iou FROM t{k}" for k in range(rounds)) + ")"


@query(f"""WITH {BOXES}, {BOX_TRUTHS}, pr AS (SELECT b.item, b.id, gid, {BOX_IOU} FROM box b JOIN bgt g ON b.item = g.item), e0 AS MATERIALIZED (SELECT item, id, gid, inter / (areas - inter) AS iou FROM pr WHERE inter > 0){_one_to_one()}
SELECT round(0.5 + k * 0.05, 2)::DOUBLE AS threshold, round((SELECT count(*) FROM taken WHERE iou >= 0.5::DOUBLE + k * 0.05::DOUBLE) / (SELECT count(*) FROM bgt), 9) AS recall FROM range(10) r(k)""")
def e8_proposal_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    g = box_truths(b).drop("cls")
    return evaluate.recall(joins.iou_2d(b.drop("cls"), g, ["item"], BUCKET), g).select("threshold", F.round("recall", 9).alias("recall"))


SEG = f"WITH {SEGMENTS}, {DETECTIONS}"


@query(f"{SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS k FROM det) SELECT item, id, score FROM r WHERE k <= 3")
def r3_r5_top_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.top(detections(segments(spark, sf_dir)), ["item"], 3).select("item", "id", "score")


@query(f"{SEG}, r AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY floor(score) DESC) AS k FROM det) SELECT cls, id FROM r WHERE k <= 20")
def r4_top_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.top(detections(segments(spark, sf_dir)).withColumn("score", F.floor("score")), ["cls"], 20, ties=True).select("cls", "id")


@query(f"{SEG} SELECT item, id FROM det ORDER BY item, id LIMIT 500")
def r6_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(segments(spark, sf_dir)).orderBy("item", "id").limit(500).select("item", "id")


@query(f"{SEG} SELECT item, id, CASE WHEN x2 - x1 + 1 < 60 THEN 0.0 ELSE score END AS score FROM det WHERE cls >= 1 AND score > 5")
def l6_l7_score_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(segments(spark, sf_dir)).where("cls >= 1 and score > 5")
    return d.select("item", "id", F.when(F.col("x2") - F.col("x1") + 1 < 60, 0.0).otherwise(F.col("score")).alias("score"))


@query(f"{SEG} SELECT cls, count(*) AS n FROM gt WHERE cls > 0 AND difficult = 0 GROUP BY cls")
def l9_positive_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truths(segments(spark, sf_dir)).where("cls > 0 and difficult = 0").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


def _crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections spread out fivefold, so that many overlap."""
    d = detections(segments(spark, sf_dir))
    return d.withColumns({"x1": F.col("x1") - 4 * (F.col("x2") - F.col("x1")), "item": F.col("item") % 50})


CROWDED = f"""{SEG}, d AS (SELECT cls, item % 50 AS item, id, score, x1 - 4 * (x2 - x1) AS x1, x2 FROM det),
o AS (SELECT a.cls, a.item, a.id AS i, b.id AS j, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1, 0) AS inter, a.x2 - a.x1 + b.x2 - b.x1 + 2 AS lens FROM d a JOIN d b ON a.cls = b.cls AND a.item = b.item WHERE a.score > b.score OR (a.score = b.score AND a.id < b.id)),
e AS (SELECT i, j FROM o WHERE inter / (lens - inter) >= 0.4)"""


def _greedy(source: str, keys: str, threshold: float, strict: bool, rounds: int = 10) -> str:
    """CTEs after `source` (keys, id, score, x1, x2): greedy suppression as rounds over overlap edges; `kept` has the ids."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    sign = ">" if strict else ">="
    out = f""", ov AS (SELECT a.id AS i, b.id AS j, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1, 0) AS inter, a.x2 - a.x1 + b.x2 - b.x1 + 2 AS lens FROM {source} a JOIN {source} b ON {on} WHERE a.score > b.score OR (a.score = b.score AND a.id < b.id)),
e0 AS MATERIALIZED (SELECT i, j FROM ov WHERE inter / (lens - inter) {sign} {threshold})"""
    for k in range(rounds):
        out += f""", f{k} AS MATERIALIZED (SELECT DISTINCT i FROM e{k} WHERE i NOT IN (SELECT j FROM e{k})), g{k} AS MATERIALIZED (SELECT DISTINCT j FROM e{k} WHERE i IN (SELECT i FROM f{k})),
e{k + 1} AS MATERIALIZED (SELECT i, j FROM e{k} WHERE j NOT IN (SELECT j FROM g{k}) AND i NOT IN (SELECT j FROM g{k}) AND i NOT IN (SELECT i FROM f{k}))"""
    gone = " UNION ALL ".join(f"SELECT j FROM g{k}" for k in range(rounds))
    return f"{out}, kept AS (SELECT * FROM {source} WHERE id NOT IN ({gone}))"


DENSE = f"{SEG}, d AS (SELECT cls, item % 50 AS item, id, score, x1 - 4 * (x2 - x1) AS x1, x2 FROM det)"


@query(f"{DENSE}{_greedy('d', 'cls, item', 0.4, False)} SELECT cls, item, id, score, x1, x2 FROM kept")
def n1_nms_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.nms(_crowded(spark, sf_dir), ["cls", "item"], 0.4)


@query(f"{DENSE}{_greedy('d', 'cls, item', 0.4, True)} SELECT cls, item, id, score, x1, x2 FROM kept")
def n1_n2_nms_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.nms_fixpoint(_crowded(spark, sf_dir), ["cls", "item"], 0.4, inclusive=False, bucket=4096.0)


@query(f"{DENSE}{_greedy('d', 'cls, item', 0.4, False)} SELECT cls, item, id, score, x1, x2 FROM kept")
def n3_nms_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups here are larger than `most`, so the dispatch takes the rounds over blocks, as it does for hot groups."""
    return detect.suppress(_crowded(spark, sf_dir), ["cls", "item"], 0.4, most=20, bucket=4096.0)


@query(f"{CROWDED} SELECT i, j FROM e WHERE i NOT IN (SELECT j FROM e)")
def n1_first_round_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What undisputed detections suppress: the first round of the fixpoint, as one join."""
    d = _crowded(spark, sf_dir)
    a = d.select("cls", "item", F.col("id").alias("i"), F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.col("score").alias("si"))
    b = d.select("cls", "item", F.col("id").alias("j"), F.col("x1").alias("b1"), F.col("x2").alias("b2"), F.col("score").alias("sj"))
    inter = F.greatest(F.lit(0.0), F.least("a2", "b2") - F.greatest("a1", "b1") + 1)
    e = a.join(b, ["cls", "item"]).where("si > sj or (si = sj and i < j)").where(inter / (F.col("a2") - F.col("a1") + F.col("b2") - F.col("b1") + 2 - inter) >= 0.4).select("i", "j")
    return e.join(e.select(F.col("j").alias("i")).distinct(), "i", "left_anti")


@query(f"""{SEG}, len AS (SELECT item, max(e) AS length FROM seg GROUP BY item), q AS (SELECT det.item, id, score, length, (id % 9 - 4) / 8.0 * (x2 - x1 + 1) + x1 + (x2 - x1 + 1) * 0.5 AS c, exp((id % 5 - 2) / 4.0) * (x2 - x1 + 1) AS l FROM det JOIN len USING (item)),
c AS (SELECT item, id, score, least(greatest(c - l * 0.5, 0), length - 1) AS x1, least(greatest(c + l * 0.5, 0), length - 1) AS x2 FROM q), s AS (SELECT item, id, x1, x2, CASE WHEN x2 - x1 + 1 < 8 THEN 0.0 ELSE score END AS score FROM c),
d AS MATERIALIZED (SELECT item, id, x1, x2, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS k FROM s) WHERE k <= 60){_greedy('d', 'item', 0.8, False)}
SELECT item, id, round(x1, 6) AS x1, round(x2, 6) AS x2, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS k FROM kept) WHERE k <= 20""")
def n4_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    rows = detections(seg).join(seg.groupBy("item").agg(F.max("e").alias("length")), "item")
    rows = rows.select("item", "id", F.col("x1").alias("a1"), F.col("x2").alias("a2"), ((F.pmod("id", F.lit(9)) - 4) / 8.0).alias("dx"), ((F.pmod("id", F.lit(5)) - 2) / 4.0).alias("dl"), "score", "length")
    out = detect.proposals(rows, least_length=8.0, before=60, after=20, threshold=0.8)
    return out.select("item", "id", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"), "score")


@query(f"{DENSE}, h AS (SELECT * FROM d WHERE cls >= 1 AND score > 1.0){_greedy('h', 'cls, item', 0.4, False)} SELECT cls, item, id, score, x1, x2 FROM (SELECT *, rank() OVER (PARTITION BY item ORDER BY score DESC) AS k FROM kept) WHERE k <= 10")
def n7_assembled_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.assemble(_crowded(spark, sf_dir), least=1.0, threshold=0.4, per_item=10)


@query(f"{WITH} SELECT item, id, CASE WHEN x2 >= 50 THEN 'x2>=width' ELSE 'y2>=height' END AS reason FROM box WHERE x2 >= 50 OR y2 >= 45")
def v7_bad_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumns({"width": F.lit(50), "height": F.lit(45)})
    return validate.bad_boxes(b).select("item", "id", "reason")


TEMPORAL = f"""{SEG}, pr AS (SELECT d.cls, d.item, d.id, score, gid, difficult, greatest(least(x2, g2) - greatest(x1, g1) + 1, 0) AS inter, x2 - x1 + g2 - g1 + 2 AS lens FROM det d LEFT JOIN gt ON gt.cls = d.cls AND gt.item = d.item),
best AS (SELECT * FROM (SELECT *, inter / (lens - inter) AS iou, row_number() OVER (PARTITION BY id ORDER BY inter / (lens - inter) DESC NULLS LAST, gid) AS k FROM pr) WHERE k = 1),
fl AS (SELECT *, CASE WHEN iou > 0.5 AND difficult = 1 THEN NULL WHEN iou > 0.5 AND row_number() OVER (PARTITION BY cls, item, gid, coalesce(iou > 0.5, false) ORDER BY score DESC, id) = 1 THEN 1 ELSE 0 END AS flag FROM best)"""


@query(f"{TEMPORAL} SELECT cls, CAST(sum(flag) AS BIGINT) AS tp, CAST(sum(1 - flag) AS BIGINT) AS fp, CAST(sum(CASE WHEN flag IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS ignored FROM fl GROUP BY cls")
def e2_temporal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    m = evaluate.match(evaluate.pairs_1d(detections(seg), truths(seg), 4096.0))
    return m.groupBy("cls").agg(F.sum("flag").cast("long").alias("tp"), F.sum(1 - F.col("flag")).cast("long").alias("fp"), F.sum(F.col("flag").isNull().cast("long")).alias("ignored"))
