"""Queries without SQL that must reach all rows, on tables whose ids lie elsewhere."""

import os

import numpy as np
import pytest

from graphloom.plans.base import part_edges
from graphloom.plans.catalog import QUERIES
from tests.oracle import TABLES, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def moved(tmp_path_factory):
    """The tables with other part and supplier ids."""
    out = tmp_path_factory.mktemp("moved")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            os.symlink(f"{SF}/{t}.parquet", out / f"{t}.parquet")
    c = connect(SF)
    for t, ids in (("lineitem", ["l_partkey"]), ("part", ["p_partkey"]), ("supplier", ["s_suppkey"])):
        os.unlink(out / f"{t}.parquet")
        c.sql(f"SELECT * REPLACE ({', '.join(f'{i} + 1000 AS {i}' for i in ids)}) FROM {t}").write_parquet(str(out / f"{t}.parquet"))
    return str(out)


@pytest.mark.parametrize(("name", "node"), [("c6_louvain", "node"), ("c9_deepwalk", "id")])
def test_every_node_of_the_graph_has_a_row(spark, moved, name, node):
    edges = part_edges(spark, moved).select("src", "dst").toPandas()
    got = QUERIES[name](spark, moved).select(node).distinct().toPandas()[node]
    assert len(edges) and set(got) == set(edges["src"]) | set(edges["dst"])


def test_negatives_reach_all_ids(spark, tmp_path):
    rows = [(1000 + k, [float(k % 3), 1.0, float(k % 5)], k % 2) for k in range(2000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["c10_link_prediction"](spark, str(tmp_path)).where("src % 2 = 1").toPandas()
    assert set(got["src"]) == {k for k in range(1000, 3000) if k % 2} and (got["src"] != got["dst"]).all()
    assert got["dst"].min() < 1100 and got["dst"].max() > 2900 and got["dst"].nunique() > 600


def test_mixture_uses_every_dimension(spark, tmp_path):
    rnd = np.random.default_rng(0)
    kind = np.arange(300) % 3
    v = np.hstack([rnd.normal(size=(300, 4)), rnd.normal(size=(300, 2)) * 0.1 + np.array([[0, 0], [9, 0], [0, 9]])[kind]])
    rows = [(k, [float(x) for x in v[k]], int(kind[k])) for k in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["c4_gaussian_mixture"](spark, str(tmp_path)).toPandas().set_index("id")["label"].loc[range(300)].to_numpy()
    assert len(set(zip(kind, got, strict=True))) == 3
