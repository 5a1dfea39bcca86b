import math

import numpy as np
import pytest

from graphloom.llm import op01_collision_ann as op
from tests.llm.helpers import write

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    ok = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault((i, tuple(np.float32(x) for x in v)), None)
    items = list(ok)
    out = {}
    for q, qv in items:
        if q % 100:
            continue
        d = sorted((float(np.sqrt(((np.array(v, float) - np.array(qv, float)) ** 2).sum())), i) for i, v in items if i != q and len(v) == len(qv))
        out[q] = d[:k]
    return out


def test_edge_cases_and_ties(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(1, 60)]
    hot = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    rows += [(i, hot) for i in range(100, 140)] + [(100, hot), (200, hot)]
    rows += [(300, None), (400, []), (500, [0.0] * 6), (600, [float("nan")] + [1.0] * 5), (700, [float("inf")] + [1.0] * 5), (800, [None] + [1.0] * 5), (None, hot), (900, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = op.op1_collision_ann(spark, write(spark, tmp_path, embeddings=df)).collect()
    want = brute(rows)
    assert {r["query_id"] for r in got} == {q for q, d in want.items() if d}
    for q, d in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(d) + 1))
        assert [m[1] for m in mine] == [i for _, i in d]
        np.testing.assert_allclose([m[2] for m in mine], [s for s, _ in d])


def test_many_blocks_against_brute_force(spark):
    """Twelve blocks of uneven kinds, two lengths, a hot vector, clusters; recall and share verified."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 24)) * 2
    rows = [(i, (centers[i % 12] + rng.normal(size=24)).tolist()) for i in range(3000)] + [(i, [1.0] * 24) for i in range(3000, 3400)] + [(i, rng.normal(size=3).tolist()) for i in range(4000, 4230)]
    df = spark.createDataFrame([(i, [float(x) for x in v], 0, "clash") for i, v in rows], "vec_id long, embedding array<double>, label int, key string")
    data = op.valid(df)
    got = op.nearest(data, data.where("vec_id % 100 = 0"), block=300).collect()
    items, hit, wanted = {i: np.array(v) for i, v in rows}, 0, 0
    for q in sorted(i for i in items if i % 100 == 0):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        true = sorted((float(np.sqrt(((v - items[q]) ** 2).sum())), i) for i, v in items.items() if i != q and len(v) == len(items[q]))[:10]
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        for _, i, score in mine:
            assert score == pytest.approx(float(np.sqrt(((items[i] - items[q]) ** 2).sum())))
        hit += len({i for _, i in true} & {m[1] for m in mine})
        wanted += 10
    assert hit / wanted >= 0.95
    assert all(0 < r["verified"] <= 3001 for r in got)


@pytest.mark.parametrize("block", [4096, 500])
def test_recall_and_share_verified_of_the_query(spark, block):
    """The query on the tables here, in one block and in several."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    import os

    if not os.path.exists(path):
        pytest.skip("no test tables here")
    data = op.valid(spark.read.parquet(path))
    got = op.nearest(data, data.where("vec_id % 100 = 0"), block=block).toPandas()
    items = data.select("vec_id", "v").toPandas()
    x, ids = np.stack(items["v"].to_list()), items["vec_id"].to_numpy()
    hit = 0
    for q, rows in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        near = [i for _, i in sorted(zip(d, ids, strict=True)) if i != q][:10]
        hit += len(set(near) & set(rows["vec_id"]))
    assert hit / len(got) >= 0.95
    if block > len(x):
        assert got["verified"].mean() / len(x) < 0.1


def test_recall_on_structureless_vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    index = op.CollisionIndex(x)
    hit = 0
    for k in range(40):
        q = rng.normal(size=64)
        true = np.argsort(((x - q) ** 2).sum(1))[:10]
        hit += len(set(true) & set(index.search(q, 10)[0][:10]))
    assert hit / 400 >= 0.93


def test_fewer_candidates_than_asked(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0, 3.0], 0)], SCHEMA)
    got = op.op1_collision_ann(spark, write(spark, tmp_path, embeddings=df)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0)]


@pytest.mark.parametrize("rows", [[], [(5, [1.0, 2.0], 0)]])
def test_empty(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert op.op1_collision_ann(spark, write(spark, tmp_path, embeddings=df)).count() == 0
