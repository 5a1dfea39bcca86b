"""Estimators on planted inputs: communities, labels, links, word vectors, mixtures, seeding."""

import numpy as np
import pytest

from graphloom.functions.rand import uniform, uniform_value
from graphloom.operators import cluster, embed, graph
from graphloom.operators import word2vec as w2v


@pytest.fixture(scope="module")
def planted(spark):
    """Four groups of 15 nodes, dense inside, a ring of single edges between."""
    rng = np.random.default_rng(0)
    edges = {(a, b) for g in range(4) for a in range(15 * g, 15 * g + 15) for b in range(a + 1, 15 * g + 15) if rng.random() < 0.6}
    edges |= {(15 * g, (15 * g + 15) % 60) for g in range(4)}
    return spark.createDataFrame([(min(e), max(e)) for e in sorted(edges)], "src long, dst long").coalesce(2).cache()


def test_louvain_finds_planted_groups(spark, planted):
    model = graph.Louvain().fit(planted, known=graph.nodes(planted))
    groups = {}
    for r in model.partition().collect():
        groups.setdefault(r["comm"], set()).add(r["node"] // 15)
    assert len(groups) == 4 and all(len(g) == 1 for g in groups.values())
    assert {r["node"]: r["comm"] for r in model.predict(spark.createDataFrame([(0,), (999,)], "node long")).collect()}[999] is None


def test_louvain_from_a_first_partition(spark, planted):
    init = graph.nodes(planted).selectExpr("node", "node div 15 as comm")
    model = graph.Louvain(n_partitions=4).fit(planted, init=init)
    assert model.partition().select("comm").distinct().count() == 4
    with pytest.raises(ValueError, match="first partition"):
        graph.Louvain().fit(planted, init=init.where("node > 0"))
    with pytest.raises(ValueError, match="nodes"):
        graph.Louvain().fit(planted, known=spark.createDataFrame([(1000,)], "node long"))
    with pytest.raises(ValueError, match="without edges"):
        graph.Louvain().fit(planted.limit(0))
    with pytest.raises(ValueError, match="not fitted"):
        graph.Louvain().partition()


def test_deepwalk_labels_planted_groups(spark, planted):
    truth = spark.createDataFrame([(15 * g + k, g) for g in range(4) for k in (1, 2, 3)], "node long, label long")
    out = embed.DeepWalk(4, size=16, length=10, walks=20, epochs=8, seed=3).fit(planted).predict(truth, 9).collect()
    assert len(out) == 60 and np.mean([r["label"] == r["node"] // 15 for r in out]) >= 0.9


def test_link_prediction_on_planted_groups(spark, planted):
    rng = np.random.default_rng(1)
    wrong = {tuple(sorted((int(a), int(b)))) for a, b in rng.integers(0, 60, (700, 2)) if a // 15 != b // 15}
    out = embed.link_auc(planted, spark.createDataFrame(sorted(wrong), "src long, dst long"), (16,), max_iter=100, size=16, length=10, walks=20, epochs=8).first()
    assert out["auc"] > 0.9 and out["n"] > 100


def sentences(spark):
    """Two topics of words that never meet."""
    rng = np.random.default_rng(2)
    rows = [(s, p, f"{'ab'[s % 2]}{rng.integers(0, 12)}") for s in range(300) for p in range(12)]
    return spark.createDataFrame(rows, "sentence long, pos int, token string")


@pytest.mark.parametrize("how", [{"sg": True}, {"sg": False}, {"sg": False, "cbow_mean": False}])
def test_word_vectors_tell_topics_apart(spark, how):
    model = w2v.Word2Vec(12, alpha=0.1, window=4, min_count=1, sample=0, epochs=12, parts=2, **how).fit(sentences(spark))
    v = {r["token"]: np.array(r["vec"]) for r in model.vectors.collect()}
    assert len(v) == 24
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    own = np.mean([cos(v[a], v[b]) for a in v for b in v if a < b and a[0] == b[0]])
    far = np.mean([cos(v[a], v[b]) for a in v for b in v if a[0] != b[0]])
    assert own > far + 0.4
    again = w2v.Word2Vec(12, alpha=0.1, window=4, min_count=1, sample=0, epochs=12, parts=2, **how).fit(sentences(spark))
    assert {r["token"]: r["vec"] for r in again.vectors.collect()} == {k: x.tolist() for k, x in v.items()}


def test_training_beyond_the_bound_takes_steps(spark):
    rows = sentences(spark).where("sentence < 40")
    model = w2v.Word2Vec(6, alpha=0.05, window=3, min_count=1, sample=0, epochs=2, sg=True).fit(rows, most_bytes=0)
    assert model.vectors.count() == 24
    with pytest.raises(ValueError, match="skip-grams"):
        w2v.Word2Vec(6, min_count=1, epochs=1).fit(rows, most_bytes=0)


def test_word2vec_parameters():
    for bad in ({"size": 0}, {"alpha": 1e-5}, {"hs": True}, {"negative": 0}, {"epochs": 0}):
        with pytest.raises(ValueError):  # noqa: PT011
            w2v.Word2Vec(**bad)


def test_noise_slots_are_shares(spark):
    vocab = spark.createDataFrame([("a", 100, 0), ("b", 10, 1), ("c", 1, 2)], "token string, cnt long, idx long")
    slots = w2v.noise_slots(embed.noise_table(vocab, domain=1000)).groupBy("idx").count().collect()
    p = np.array([100, 10, 1]) ** 0.75
    assert {r["idx"]: r["count"] for r in slots} == {k: round(c) for k, c in enumerate(np.diff([0, *np.round(np.cumsum(p) / p.sum() * 1000)]))}


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x, r = rng.normal(size=(80, 5)) + 100, rng.random((80, 3))
    points = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    resp = spark.createDataFrame([(i, k, float(r[i, k])) for i in range(80) for k in range(3)], "id long, k int, resp double")
    for k, (n, mean, cov) in cluster.weighted_parameters(points, resp, eps=1e-6).items():
        m = r[:, k] @ x / r[:, k].sum()
        want = ((x - m) * r[:, k : k + 1]).T @ (x - m) / r[:, k].sum() + 1e-6 * np.eye(5)
        assert n == pytest.approx(r[:, k].sum())
        np.testing.assert_allclose(mean, m, rtol=1e-9)
        np.testing.assert_allclose(cov, want, rtol=1e-7, atol=1e-9)


def test_mixture_equals_plain_em(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(60, 3)) + 4])
    w, mu, p = np.array([0.4, 0.6]), np.array([[0.5, 0, 0], [3.0, 3, 3]]), np.stack([np.eye(3)] * 2)
    model = cluster.GaussianMixture(2, tol=0.0, max_iter=3, weights_init=w, means_init=mu, precisions_init=p)
    model.fit(spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "id long, v array<double>"))
    cov = np.stack([np.eye(3)] * 2)

    def resp():
        logs = np.stack([np.log(w[k]) - 0.5 * (np.log(np.linalg.det(2 * np.pi * cov[k])) + np.einsum("nd,de,ne->n", x - mu[k], np.linalg.inv(cov[k]), x - mu[k])) for k in range(2)], axis=1)
        return np.exp(logs - np.logaddexp(logs[:, :1], logs[:, 1:]))

    for _ in range(3):
        r = resp()
        n = r.sum(axis=0)
        mu = (r.T @ x) / n[:, None]
        cov = np.stack([((x - mu[k]) * r[:, k : k + 1]).T @ (x - mu[k]) / n[k] + 1e-6 * np.eye(3) for k in range(2)])
        w = n / n.sum()
    np.testing.assert_allclose(model.params[0], w, rtol=1e-6)
    np.testing.assert_allclose(model.params[1], mu, rtol=1e-6)
    np.testing.assert_allclose(model.params[2], cov, rtol=1e-5, atol=1e-8)


def test_draws_agree_on_driver_and_in_columns(spark):
    from pyspark.sql import functions as F

    got = spark.range(3).select(uniform(9, F.col("id"), F.lit("x")).alias("u")).collect()
    assert [r["u"] for r in got] == [uniform_value(9, k, "x") for k in range(3)]


def test_plus_plus_spreads_over_clusters(spark):
    rows = [(i, [float(i % 3) * 100 + (i % 7) * 0.01, 0.0]) for i in range(90)]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted(r["c"][0] // 100 for r in cluster.plus_plus(points, 3, 1).collect())
    assert got == [0.0, 1.0, 2.0]


def test_most_similar_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)], "token long, vec array<double>")
    one, many = (sorted(map(tuple, embed.most_similar(v.where("token < 15"), v, 3, most=m).collect())) for m in (100, 4))
    assert one == many and len(one) == 45
