"""What large tables failed on: plans and rounds that must not grow with them."""

import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import vector, voxel
from graphloom.operators import checkpoints, detect, embed, graph, louvain_blocks, windows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grid(spark, ids, n=4):
    rows = spark.createDataFrame([(k,) for k in ids], "id long")
    for a in voxel.AXES:
        rows = rows.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return rows.withColumn("val", (F.col("z") * 100 + F.col("y") * 10 + F.col("x")).cast("double"))


def test_resampling_joins_nothing(spark):
    v = grid(spark, [1, 2, None]).where("not (id = 2 and z = 3 and y = 3 and x = 3)")
    out = voxel.resample_nearest(v, (4, 4, 4), (3, 7, 4))
    assert "Join" not in plan(out)
    got = {(r["id"], r["z"], r["y"], r["x"]): r["val"] for r in out.collect()}
    near = lambda k, m: min(int((k + 0.5) * 4 / m), 3)
    want = {(i, z, y, x): near(z, 3) * 100.0 + near(y, 7) * 10 + x for i in (1, 2) for z in range(3) for y in range(7) for x in range(4)}
    assert got == {k: w for k, w in want.items() if k[0] == 1 or w != 333.0}


def test_masks_are_not_broadcast(spark):
    v = grid(spark, [1, 2])
    out = voxel.mask(v, v.withColumn("val", F.col("x") % 2))
    assert "Broadcast" not in plan(out)
    assert sorted(r["val"] for r in out.where("id = 2 and z = 3 and y = 1").collect()) == [0.0, 0.0, 311.0, 313.0]


def test_context_positions_are_not_joined(spark):
    rows = [(s, p, f"t{p % 3}") for s in (1, 2) for p in range(-1, 30) if p != 7] + [(1, 4, "again"), (None, 5, "t")]
    out = windows.context_pairs(spark.createDataFrame(rows, "sentence long, pos int, token string"), 3, F.pmod("pos", F.lit(4)), block=5)
    assert "Join" not in plan(out)
    want = sorted((s, p, t, q, u) for s, p, t in rows for r, q, u in rows if s == r is not None and q >= 0 and 0 < abs(p - q) <= 3 - p % 4)
    assert sorted(map(tuple, out.collect())) == want
    with pytest.raises(Exception, match="below 0"):
        windows.context_pairs(spark.createDataFrame(rows, "sentence long, pos int, token string"), 3, F.lit(-1)).collect()


@pytest.mark.parametrize(("bucket", "most"), [(None, 20_000), (0.5, 40), (4.0, 7)])
def test_suppression_writes_no_pairs(spark, monkeypatch, bucket, most):
    rows = spark.range(1500).selectExpr("id % 2 as item", "id", "cast(pmod(id * 7919, 211) - 40 as double) x1", "cast(pmod(id * 7919, 211) + pmod(id * 31, 53) - 30 as double) x2", "cast(pmod(id * 104729, 97) as double) score")
    odd = spark.createDataFrame([(1, 2000, None, 5.0, 1.0), (None, 2001, 0.0, 9.0, 99.0), (1, 2002, 0.0, float("inf"), 99.0), (1, 2003, 3.0, 9.0, None)], "item long, id long, x1 double, x2 double, score double")
    made, write = [], detect.written

    def counted(df, name="step"):
        made.append((out := write(df, name)).count())
        return out

    monkeypatch.setattr(detect, "written", counted)
    for inclusive in (True, False):
        got = detect.nms_fixpoint(rows.unionByName(odd), ["item"], 0.4, inclusive, **({} if bucket is None else {"bucket": bucket, "most": most}))
        want = [r["id"] for r in detect.nms(rows, ["item"], 0.4, inclusive).collect()]
        assert sorted(r["id"] for r in got.collect()) == sorted([*want, 2000, 2001, 2002, 2003])
    assert max(made) < 20 * 1500


def test_dispatched_suppression_writes_no_pairs(spark, monkeypatch):
    rows = spark.range(1200).selectExpr("id", "1L as item", "cast(id % 60 as double) x1", "cast(id % 60 + 100 + id % 7 as double) x2", "cast(pmod(id * 104729, 997) as double) score")
    made, write = [], detect.written
    monkeypatch.setattr(detect, "written", lambda df, name="step": made.append(write(df, name)) or made[-1])
    got = detect.suppress(rows, ["item"], 0.4, most=20)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in detect.nms(rows, ["item"], 0.4).collect())
    assert len(made) and max(t.count() for t in made) < 20 * 1200


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        found.add(files.next().getName())
    return {f for f in found if f.startswith("shuffle_")}


@pytest.mark.parametrize("extra", [False, True])
def test_suppression_leaves_little_on_disk(spark, extra):
    rows = spark.range(1500).selectExpr("id", "1L as item", "id * 13 % 1500 as x1", "id * 13 % 1500 + 10 + id % 50 as x2", "cast(pmod(id * 104729, 997) as decimal(9,2)) score", *["concat('p', id) as more"] * extra)
    want, before, tables = sorted(r["id"] for r in detect.nms(rows, ["item"], 0.4).collect()), shuffle_files(spark), set(checkpoints._made)
    got = detect.nms_fixpoint(rows, ["item"], 0.4, bucket=64.0, most=20)
    largest = detect.suppress(rows, ["item"], 0.4, most=2000)
    end = time.time() + 10
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    held = [spark.read.parquet(p).count() for p in checkpoints._made if p not in tables]
    assert sum(held) == 1500 + len(want)
    assert got.dtypes == rows.dtypes and sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in largest.collect()) == want


def test_suppression_of_empty_segments(spark):
    # Of length 0: their IoU is 0 / 0, in SQL an error.
    rows = spark.createDataFrame([(1, k, 5.0, 4.0, float(k)) for k in range(4)] + [(1, 9, 5.0, 5.0, 9.0)], "item long, id long, x1 double, x2 double, score double")
    assert detect.nms_fixpoint(rows, ["item"], 0.4, most=1).count() == detect.nms(rows, ["item"], 0.4).count() == 5


@pytest.mark.parametrize("most", [100, 9])
def test_similar_vectors_need_no_row_a_pair(spark, monkeypatch, most):
    monkeypatch.setattr(embed, "CHUNK", 60)
    rows = [(k, [float(k % 7 - 3), float(k % 5), 1.0 + k % 3]) for k in range(200)] + [(300, None), (301, [1.0, None, 2.0]), (302, [1.0, 2.0]), (None, [1.0, 2.0, 2.0])]
    v = spark.createDataFrame(rows, "token long, vec array<double>")
    out = embed.most_similar(v.where("token % 10 = 0"), v, 4, most=most)
    assert "FlatMapCoGroupsInPandas" in plan(out)
    pairs = v.where("token % 10 = 0").selectExpr("token as query", "vec as qv").crossJoin(v).where("token <> query").withColumn("cosine", vector.cosine(F.col("qv"), F.col("vec")))
    want = pairs.selectExpr("query", "token", "cosine", "row_number() over (partition by query order by cosine desc, token) as rank").where("rank <= 4")
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("pairs_at_once", [4_000_000, 20])
def test_steps_make_pairs_of_edges_in_place(spark, monkeypatch, pairs_at_once):
    monkeypatch.setattr(graph, "PAIRS", pairs_at_once)
    pairs = {(a, b) for a in range(30) for b in range(a, 30) if (a * 7 + b * 3) % 5 == 0 and (a != b or a % 4 == 0)}
    e = spark.createDataFrame([(a, b, float(1 + (a + b) % 3)) for a, b in sorted(pairs)], "src long, dst long, w double")
    got = graph.transitions(e, 2.0, 4.0)
    # Neither pairs of edges nor first edges are dealt out; only nodes are.
    assert "Window" not in plan(got) and "prev" not in "".join(x for x in plan(got).splitlines() if "hashpartitioning" in x)
    w = {x: float(1 + sum(x) % 3) for a, b in pairs for x in ((a, b), (b, a))}
    want = {(s, t, n): w[t, n] / 2 if n == s else w[t, n] if (s, n) in w else w[t, n] / 4 for s, t in w for t2, n in w if t2 == t}
    found = {(r["prev"], r["cur"], r["nxt"]): r["prob"] for r in got.collect()}
    assert found.keys() == want.keys() and len(want) > 500
    assert all(abs(found[k] - x / sum(want[s, t, n] for s, t, n in want if (s, t) == k[:2])) < 1e-12 for k, x in list(want.items())[::25])


def test_louvain_in_one_task_takes_the_same_rounds(spark, monkeypatch):
    e = spark.range(60).selectExpr("id div 10 * 10 + id % 10 as src", "id div 10 * 10 + pmod(id * 7 + 3, 10) as dst").union(spark.range(6).selectExpr("id * 10", "pmod(id * 10 + 25, 60)")).coalesce(1).cache()
    rounds = {"max_passes": 2, "max_rounds": 3}
    by_rounds = sorted(map(tuple, graph.louvain(e, **rounds, most=0).collect()))
    monkeypatch.setattr(graph, "_moves", None)
    assert sorted(map(tuple, graph.louvain(e, **rounds).collect())) == by_rounds


@pytest.mark.parametrize(("most", "ends"), [(0, 40), (40, 40), (0, 500_000)])
def test_louvain_in_blocks_takes_the_same_rounds(spark, monkeypatch, most, ends):
    rows = {(k // 10 * 10 + k % 10, k // 10 * 10 + (k * j + 3) % 10) for k in range(300) for j in (3, 7, 9)} | {(10 * k, (10 * k + 25) % 300) for k in range(30)}
    e = spark.createDataFrame([(a * 1_000_003 - 7, b * 1_000_003 - 7, (1 + (a + b) % 3) * (0.5, 1.0, 200.0)[a // 10 % 3]) for a, b in sorted(rows)] + [(-5, -5, 2.0)], "src long, dst long, w double")
    want = sorted(map(tuple, graph.louvain(e).collect()))
    monkeypatch.setattr(graph, "_moves", None)
    monkeypatch.setattr(louvain_blocks, "ENDS", ends)
    before = set(checkpoints._made)
    got = graph.louvain(e, most=most)
    assert sorted(map(tuple, got.collect())) == want and len({r[0] for r in want}) > 1
    # Edges and blocks are gone; what is left is the result.
    assert [spark.read.parquet(p).count() for p in checkpoints._made if p not in before] == [len(want)]


def test_louvain_above_the_held_nodes_moves_in_tables(spark, monkeypatch):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)], "src long, dst long")
    want = sorted(map(tuple, graph.louvain(e, max_passes=1, max_rounds=2).collect()))
    assert sorted(map(tuple, graph.louvain(e, max_passes=1, max_rounds=2, most=0, held=5).collect())) == want
    monkeypatch.setattr(graph, "_moves", None)
    with pytest.raises(TypeError):
        graph.louvain(e, max_passes=1, max_rounds=2, most=0, held=5)
    assert sorted(map(tuple, graph.louvain(e, max_passes=1, max_rounds=2, most=0, held=6).collect())) == want


def test_graph_is_made_once_for_louvain(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "src long, dst long").mapInArrow(counted, "src long, dst long")
    graph.Louvain().fit(e)
    assert seen.value == 4
