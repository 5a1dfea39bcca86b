"""Worked-out small inputs for boundaries."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import box, segment, vector, voxel
from graphloom.operators import cluster, detect, embed, evaluate, graph, joins, metrics, sampling, validate, windows


def first(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("length", "starts", "ends"), [(2000, [0, 192, 384, 576, 768, 960, 1152], [2000, 1808, 1616, 1424, 1232, 1040, 848]), (768, [0], [768]), (500, [0], [])])
def test_sliding_windows(spark, length, starts, ends):
    items = spark.createDataFrame([(1, length)], "item long, length long")
    assert sorted(r["win_start"] for r in windows.forward(items, 768, 192).collect()) == starts
    assert sorted((r["win_end"] for r in windows.backward(items, 768, 192).collect()), reverse=True) == ends


def segs(spark, *pairs):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in pairs], "item long, s double, e double")


def test_gaps(spark):
    def gaps(*pairs, **kw):
        return sorted((r["gap_start"], r["gap_end"]) for r in windows.gaps(segs(spark, *pairs), "item", **kw).collect())

    assert gaps((2, 5), (4, 8), (10, 12)) == [(0, 2), (8, 10), (12, 42)]
    assert gaps((0, 20), (1, 3), (5, 6)) == [(3, 5), (6, 36)]
    assert gaps((0, 20), (1, 3), (5, 6), merge_overlaps=True) == [(20, 50)]


def test_window_segment_rules(spark):
    seg = segs(spark, (0, 2), (90, 130), (95, 96.5), (100, 120), (40, 43))
    for direction, kept in (("forward", [(40, 43)]), ("backward", [])):
        wins = spark.createDataFrame([(1, 0, 100, direction)], "item long, win_start long, win_end long, direction string")
        joined = joins.interval(wins, seg, "item", ("win_start", "win_end"), ("s", "e"))
        assert [(r["s"], r["e"]) for r in windows.keep_segments(joined, F.col("direction")).collect()] == kept


@pytest.mark.parametrize("bucket", [None, 1.0, 7.0, 1000.0])
def test_bucketed_interval_join_is_the_plain_one(spark, bucket):
    left = spark.range(60).selectExpr("id % 3 as k", "id as l", "cast(id * 2 as double) a", "cast(id * 2 + id % 9 + 1 as double) b")
    right = spark.range(50).selectExpr("id % 3 as k", "id as r", "cast(id * 3 as double) s", "cast(id * 3 + id % 5 + 1 as double) e")
    got = joins.interval(left, right, "k", ("a", "b"), ("s", "e"), bucket).select("l", "r").collect()
    want = [(x, y) for x in range(60) for y in range(50) if x % 3 == y % 3 and 2 * x < y * 3 + y % 5 + 1 and 2 * x + x % 9 + 1 > 3 * y]
    assert sorted(map(tuple, got)) == sorted(want)


def test_segment_iou_masks(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert first(spark, segment.iou(*lit(0, 9, 5, 14))) == pytest.approx(1 / 3)
    assert first(spark, segment.iou(*lit(0, 9, 10, 19))) == 0
    assert first(spark, segment.iou(*lit(0, 9, 3, 3))) == 0
    assert first(spark, segment.iou(*lit(4, 4, 0, 9))) == -1


def test_encode_decode_asymmetry(spark):
    dx, dl = segment.encode(*(F.lit(float(x)) for x in (0, 9, 5, 24)))
    r = spark.range(1).select(dx.alias("dx"), dl.alias("dl")).first()
    assert r["dx"] == pytest.approx(1.0) and r["dl"] == pytest.approx(math.log(2))
    x1, x2 = segment.decode(F.lit(0.0), F.lit(9.0), F.lit(1.0), F.lit(math.log(2)))
    r = spark.range(1).select(x1.alias("a"), x2.alias("b")).first()
    assert (r["a"], r["b"]) == pytest.approx((5, 25))


def test_anchors(spark):
    assert sorted((r["scale"], r["a1"], r["a2"]) for r in windows.anchors(spark.range(1), 8, [2, 4]).collect()) == [(2, -4, 11), (4, -12, 19)]


def dets(spark, rows):
    return spark.createDataFrame([(1, k, float(a), float(b), s) for k, (a, b, s) in enumerate(rows)], "item long, id long, x1 double, x2 double, score double")


def test_suppression_at_the_border(spark):
    d = dets(spark, [(0, 9, 0.9), (0, 4, 0.8)])  # IoU exactly 0.5
    for f in (detect.nms, detect.nms_fixpoint):
        assert f(d, ["item"], 0.5, inclusive=True).count() == 1
        assert f(d, ["item"], 0.5, inclusive=False).count() == 2


@pytest.mark.parametrize("bucket", [None, 64.0])
def test_fixpoint_equals_greedy(spark, bucket):
    d = spark.range(600).selectExpr("id % 10 as item", "id", "cast(pmod(id * 7919, 300) as double) x1", "cast(pmod(id * 7919, 300) + 5 + id % 40 as double) x2", "cast(pmod(id * 104729, 97) as double) score")
    a = {r["id"] for r in detect.nms(d, ["item"], 0.4).collect()}
    b = {r["id"] for r in detect.nms_fixpoint(d, ["item"], 0.4, bucket=bucket).collect()}
    assert a == b and len(a) < 600


def test_average_precision(spark):
    rows = spark.createDataFrame([("c", 1, 0.9, 1, 0.5, 1.0), ("c", 2, 0.8, 1, 0.5, 0.5), ("c", 3, 0.7, 2, 1.0, 2 / 3)], "cls string, rank int, score double, tp int, recall double, precision double")
    assert evaluate.average_precision(rows).first()["ap"] == pytest.approx(0.833333, abs=1e-6)
    assert evaluate.average_precision(rows, "11point").first()["ap"] == pytest.approx(0.848485, abs=1e-6)


def test_matching_rules(spark):
    pairs = spark.createDataFrame([("c", 1, 1, 0.9, 10, 0, 0.8), ("c", 1, 2, 0.8, 10, 0, 0.9), ("c", 1, 3, 0.7, 11, 1, 0.7), ("c", 1, 4, 0.6, 10, 0, 0.5), ("c", 1, 5, 0.5, None, 0, None)], "cls string, item long, id long, score double, gid long, difficult int, iou double")
    assert {r["id"]: r["flag"] for r in evaluate.match(pairs).collect()} == {1: 1, 2: 0, 3: None, 4: 0, 5: 0}


def test_pagerank_one_round(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "src long, dst long")
    got = {r["node"]: r["rank"] for r in graph.pagerank(e, rounds=1, tol=0.0).collect()}
    assert got == pytest.approx({0: 1 / 9, 1: 5 / 18, 2: 11 / 18})


TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]


def test_modularity_and_contraction(spark):
    g = graph.undirected(spark.createDataFrame(TRIANGLES, "src long, dst long"))
    part = graph.nodes(g).select("node", F.floor(F.col("node") / 3).alias("comm"))
    assert graph.modularity(g, part).first()[0] == pytest.approx(0.357143, abs=1e-6)
    assert sorted((r["src"], r["dst"], r["w"]) for r in graph.contract(g, part).collect()) == [(0, 0, 3.0), (0, 1, 1.0), (1, 1, 3.0)]


def test_louvain_never_lowers_modularity(spark):
    e = spark.createDataFrame(TRIANGLES, "src long, dst long")
    passes = graph.louvain(e)
    g, scores = graph.undirected(e), []
    for k in sorted({r["pass"] for r in passes.collect()}):
        scores.append(graph.modularity(g, passes.where(F.col("pass") == k)).first()[0])
    assert scores == sorted(scores) and scores[-1] > 0.3


def test_transitions(spark):
    e = graph.undirected(spark.createDataFrame([(0, 1), (1, 2), (1, 3), (0, 2)], "src long, dst long"))
    got = {r["nxt"]: r["prob"] for r in graph.transitions(e, 2.0, 4.0).where("prev = 0 and cur = 1").collect()}
    assert got == pytest.approx({0: 0.285714, 2: 0.571429, 3: 0.142857}, abs=1e-6)


def test_walks_follow_edges_and_never_return(spark):
    e = spark.range(200).selectExpr("id as src", "pmod(id * 7 + 1, 200) as dst").union(spark.range(200).selectExpr("id", "pmod(id + 3, 200)"))
    pairs = {tuple(r) for r in e.collect()}
    for weights in (None, graph.nodes(e).selectExpr("node", "cast(node % 5 + 1 as double) as weight")):
        for r in graph.random_walks(e, graph.nodes(e), length=6, walks=2, seed=1, weights=weights).collect():
            p = r["path"]
            assert len(set(p)) == len(p) and all(x in pairs for x in zip(p, p[1:], strict=False))
    again = graph.random_walks(e.repartition(7), graph.nodes(e), length=6, walks=2, seed=1)
    assert sorted(map(str, again.collect())) == sorted(map(str, graph.random_walks(e, graph.nodes(e), length=6, walks=2, seed=1).collect()))


def test_biased_walks_follow_edges(spark):
    g = graph.undirected(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)], "src long, dst long"))
    pairs = {(r["src"], r["dst"]) for r in graph.symmetric(g).collect()}
    for r in graph.biased_walks(g, graph.nodes(g), 5, 3, 0.5, 2.0, 4).collect():
        assert len(r["path"]) == 5 and all(x in pairs for x in zip(r["path"], r["path"][1:], strict=False))


def test_cluster_borders(spark):
    pts = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 5.0])], "id long, v array<double>")
    centers = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, -1.0]), (2, [90.0, 90.0])], "k int, c array<double>")
    labelled = cluster.assign(pts, centers)
    assert {r["id"]: r["label"] for r in labelled.collect()} == {0: 0, 1: 0, 2: 0}  # ties go to the smaller
    means = {(r["k"], r["pos"]): r["mean"] for r in cluster.means(labelled, centers).collect()}
    assert means[2, 0] == means[2, 1] == 0.0  # no member


def test_kmeans_and_mixture_find_clear_groups(spark):
    pts = spark.range(90).selectExpr("id", "array(cast(id % 3 * 100 + id % 7 as double), cast(id % 3 * 50 - id % 5 as double)) as v")
    model = cluster.KMeans(3, n_init=1, max_iter=5, seed=1).fit(pts)
    by = {}
    for r in model.predict(pts).collect():
        by.setdefault(r["id"] % 3, set()).add(r["label"])
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == 3
    probs = cluster.GaussianMixture(3, max_iter=3, seed=2).fit(pts).predict_prob(pts).groupBy("id").agg(F.sum("resp").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in probs)


def test_sampling_probability(spark):
    vocab = spark.createDataFrame([("a", 100), ("b", 900)], "token string, cnt long")
    assert {r["token"]: r["keep_prob"] for r in embed.sampling(vocab, 1e-3).collect()}["a"] == pytest.approx(0.11)


def test_noise_table_ends_at_its_domain(spark):
    vocab = embed.vocabulary(spark.createDataFrame([("a", 3), ("b", 1), ("c", 7)], "token string, cnt long"))
    assert max(r["cum"] for r in embed.noise_table(vocab).collect()) == 2**31 - 1


def test_huffman_adds_counts(spark):
    codes = dict(embed.huffman(embed.vocabulary(spark.createDataFrame([("a", 5), ("b", 2), ("c", 1), ("d", 1)], "token string, cnt long"))))
    assert {k: len(v) for k, v in codes.items()} == {"a": 1, "b": 2, "c": 3, "d": 3}


def test_ties_kept_by_top(spark):
    rows = spark.createDataFrame([(1, k, s) for k, s in enumerate([0.9, 0.5, 0.5, 0.1])], "item long, id long, score double")
    assert detect.top(rows, ["item"], 2, ties=True).count() == 3 and detect.top(rows, ["item"], 0).count() == 4


def test_mirror_symmetrizes(spark):
    v = spark.range(6).selectExpr("0L as id", "id as z", "0L as y", "0L as x", "cast(id as double) as val")
    assert [r["val"] for r in voxel.mirror(v, "z", 6).orderBy("z").collect()] == [5, 4, 3, 3, 4, 5]
    assert [r["val"] for r in voxel.mirror(v, "z", 6, symmetrize=False).orderBy("z").collect()] == [5, 4, 3, 2, 1, 0]


def test_auc(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    assert metrics.roc_auc(rows).first()["auc"] == pytest.approx(0.75)


def test_folds_and_batches(spark):
    rows = spark.createDataFrame([(k, "a" if k < 7 else "b", int(k % 3 == 0)) for k in range(11)], "id long, s string, label int")
    for _, g in sampling.stratified_folds(rows, "s", 3, "id").toPandas().groupby("s"):
        n = g["fold"].value_counts()
        assert n.max() - n.min() <= 1
    out = sampling.balanced_batches(rows, "label", {0: 3, 1: 2}, 5, "id").groupBy("batch", "label").count().collect()
    assert {(r["label"], r["count"]) for r in out} == {(0, 3), (1, 2)} and len(out) == 10


def test_boxes(spark):
    b = spark.createDataFrame([(0.0, 0.0, 5.0, 5.0), (-1.0, 0.0, 5.0, 5.0), (3.0, 0.0, 2.0, 5.0), (0.0, 0.0, 10.0, 5.0)], "x1 double, y1 double, x2 double, y2 double").withColumns({"width": F.lit(10), "height": F.lit(10)})
    assert sorted(r["reason"] for r in validate.bad_boxes(b).collect()) == ["x1<0", "x2<x1", "x2>=width"]
    with pytest.raises(ValueError, match="boxes"):
        validate.require(validate.bad_boxes(b), "boxes")
    c = [F.lit(float(x)) for x in (0, 0, 4, 5)]
    assert not first(spark, box.big_enough(*c, 6)) and first(spark, box.big_enough(*c, 5))
    assert first(spark, box.big_enough(*[F.lit(float(x)) for x in (0, 0, 5, 5)], 6)) is False  # as high as asked isn't enough


def test_edge_feature_names(spark):
    a, b = F.array(F.lit(1.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(1.0))
    got = {k: first(spark, f(a, b)) for k, f in vector.EDGE_FEATURES.items()}
    assert got == {"hadamard": [3, 4], "average": [2, 2.5], "l1": [2, 3], "l2": [4, 9]}


def test_packing_by_budget(spark):
    rows = spark.createDataFrame([(0, k, n) for k, n in enumerate([4, 4, 4, 9, 1])], "part long, sentence long, n long")
    assert [r["batch"] for r in detect.pack_by_budget(rows, 9).orderBy("sentence").collect()] == [0, 0, 1, 2, 3]


def test_roi_sampling_fills_batches(spark):
    c = spark.createDataFrame([(1, f"r{k}", 0.0, 1.0, 0.6 if k < 2 else 0.2, 0, "fg" if k < 2 else "bg") for k in range(9)] + [(2, "r9", 0.0, 1.0, 0.9, 0, "fg")], "item long, id string, a1 double, a2 double, best_iou double, gid long, kind string")
    out = detect.sample_rois(c, 8, 0.5).groupBy("item", "kind").count().collect()
    assert {(r["item"], r["kind"], r["count"]) for r in out} == {(1, "fg", 2), (1, "bg", 6), (2, "fg", 8)}


def test_resample_and_channel(spark):
    v = spark.range(4).selectExpr("0L as id", "id as z", "0L as y", "0L as x", "cast(id as double) as val")
    assert [r["val"] for r in voxel.resample_nearest(v, (4, 1, 1), (8, 1, 1)).orderBy("z").collect()] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert [r["val"] for r in voxel.resample_nearest(v, (4, 1, 1), (2, 1, 1)).orderBy("z").collect()] == [1, 3]
    assert first(spark, voxel.with_channel(F.array(F.lit(5), F.lit(6)))) == [1, 5, 6]


def test_given_mixture_parameters_are_checked(spark):
    eye = [[1.0, 0.0], [0.0, 1.0]]
    for bad in ([0.5, 0.6], [1.5, -0.5], [1.0]):
        with pytest.raises(ValueError, match="weights"):
            cluster.GaussianMixture(2, weights_init=bad, means_init=[[0, 0], [1, 1]], precisions_init=[eye, eye])
    with pytest.raises(ValueError, match="positive definite"):
        cluster.GaussianMixture(2, weights_init=[0.5, 0.5], means_init=[[0, 0], [1, 1]], precisions_init=[eye, [[1.0, 2.0], [2.0, 1.0]]])
    pts = spark.range(40).selectExpr("id", "array(cast(id % 2 * 9 + id % 5 as double), cast(id % 3 as double)) as v")
    model = cluster.GaussianMixture(2, max_iter=1, weights_init=[0.5, 0.5], means_init=[[2, 1], [11, 1]], precisions_init=[eye, eye]).fit(pts)
    assert {(r["id"] % 2, r["label"]) for r in model.predict(pts).collect()} == {(0, 0), (1, 1)}
    with pytest.raises(ValueError, match="not fitted"):
        cluster.GaussianMixture(2).predict(pts)
    with pytest.raises(ValueError, match="fewer points"):
        cluster.KMeans(50).fit(pts)


def test_batch_summary_and_split(spark):
    rows = spark.createDataFrame([(1, k, [1, 0, 0, -1][k]) for k in range(4)], "item long, id long, label int")
    assert tuple(detect.batch_summary(rows).first()) == (1, 1, 2, 1, pytest.approx(1 / 3))
    a, b = sampling.split(spark.range(4000), "id")
    assert a.count() + b.count() == 4000 and 2850 < a.count() < 3150
    assert cluster.seed_centers(spark.range(500).selectExpr("id", "array(cast(id as double)) as v"), 3, 1, init_size=50).count() == 3


def test_contains_once_by_substrings(spark):
    ids = spark.createDataFrame([("ab",), ("bc",), ("c",), ("zz",), ("abcabc",), ("",), (None,)], "id string")
    names = spark.createDataFrame([("abc",), ("xbcx",), ("abcabc",), ("q",)], "name string")
    got = {r["id"]: r["name"] for r in joins.contains_once(ids, names).collect()}
    want = {}
    for i in ("ab", "bc", "c", "zz", "abcabc", ""):
        hits = [n for n in ("abc", "xbcx", "abcabc", "q") if i in n]
        if len(hits) == 1:
            want[i] = hits[0]
    assert got == want
    assert joins.contains_once(ids.limit(0), names).count() == 0


def test_own_return_and_outward_weights_at_nodes(spark):
    """A path 0 - 1 - 2 with a tail: where p is tiny the walk goes back, where it is huge it goes on."""
    g = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, w double")
    starts = spark.createDataFrame([(0,)], "node long")
    for p, third in ((1e-9, 0), (1e9, 2)):
        own = spark.createDataFrame([(1, p, 1.0)], "node long, p double, q double")
        paths = [r["path"] for r in graph.biased_walks(g, starts, 3, walks=8, seed=3, own=own).collect()]
        assert all(x == [0, 1, third] for x in paths)


def test_assignment_by_overlap_equals_all_pairs(spark):
    import random

    rng = random.Random(5)
    anchors = [(i % 3, i, s, s + rng.choice([0, 3, 40])) for i in range(60) for s in [rng.randrange(60)]]
    truths = [(i % 2, 100 + i, s, s + rng.choice([0, 5, 25])) for i in range(12) for s in [rng.randrange(60)]]

    def iou(a, g):
        if a[1] == a[0]:
            return -1.0
        if g[1] == g[0]:
            return 0.0
        inter = max(min(a[1], g[1]) - max(a[0], g[0]) + 1, 0)
        return inter / (a[1] - a[0] + 1 + g[1] - g[0] + 1 - inter)

    pairs = {(a[1], g[1]): iou(a[2:], g[2:]) for a in anchors for g in truths if a[0] == g[0]}
    best = {i: max(v for (x, _), v in pairs.items() if x == i) for i, _ in pairs}
    gmax = {}
    where = {g[1]: (g[0], g[2], g[3]) for g in truths}
    for (_, g), v in pairs.items():
        gmax[where[g]] = max(gmax.get(where[g], -2.0), v)
    first = {i for (i, g), v in pairs.items() if v == gmax[where[g]] > 0}
    want = {i: (v, 1 if v >= 0.7 or i in first else 0 if v < 0.3 else -1) for i, v in best.items()}
    a, g = spark.createDataFrame(anchors, "item long, id long, a1 long, a2 long"), spark.createDataFrame(truths, "item long, gid long, g1 long, g2 long")
    got = {r["id"]: (r["best_iou"], r["label"]) for r in detect.anchor_labels(a, g, bucket=7.0).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == pytest.approx(want[i][0]) and got[i][1] == want[i][1] for i in want)
    kinds = {r["id"]: r["gid"] for r in detect.candidates(a, g).collect() if r["id"].startswith("r")}
    assert kinds == {f"r{i}": min(x for (k, x), v in pairs.items() if k == i and v == best[i]) for i in best}


def test_null_strata_are_one_stratum(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "id long, s string")
    counts = {(r["s"], r["fold"]): r["count"] for r in sampling.stratified_folds(rows, "s", 5, "id").groupBy("s", "fold").count().collect()}
    assert counts == {(s, f): 2 for s in (None, "a") for f in range(5)}


def test_one_to_one_matching_over_items(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.7), (1, 2, 2, 0.6), (2, 1, 1, 0.55), (2, 2, 1, 0.5)], "item long, id long, gid long, iou double")
    truths = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "item long, gid long")
    got = {r["threshold"]: r["recall"] for r in evaluate.recall(pairs, truths).collect()}
    assert got[0.5] == pytest.approx(1.0) and got[0.6] == pytest.approx(2 / 3) and got[0.9] == pytest.approx(1 / 3) and got[0.95] == 0.0
