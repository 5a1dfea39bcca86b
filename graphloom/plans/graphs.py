"""Graph analytics over parts that follow each other in orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.rand import uniform, uniform_sql
from graphloom.functions.vector import EDGE_FEATURES
from graphloom.operators import embed, joins, validate
from graphloom.operators import graph as G
from graphloom.operators.prefix import positions
from graphloom.plans.base import EDGES, GRAPH, POINTS, part_edges, partition, points, query

WITH = f"WITH {GRAPH}"
DEG = "deg AS (SELECT node, sum(w) AS degree FROM (SELECT src AS node, w FROM graph UNION ALL SELECT dst, w FROM graph) GROUP BY node)"
STATS = f"""{DEG}, cd AS (SELECT comm, sum(degree) AS degree FROM deg JOIN grp USING (node) GROUP BY comm),
ci AS (SELECT a.comm, sum(w) AS inner_w FROM graph JOIN grp a ON a.node = src JOIN grp b ON b.node = dst WHERE a.comm = b.comm GROUP BY a.comm),
stats AS (SELECT cd.comm, degree, coalesce(inner_w, 0) AS inner_w FROM cd LEFT JOIN ci USING (comm))"""


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.undirected(part_edges(spark, sf_dir))


@query(f"{WITH} SELECT src, dst, CAST(w AS DOUBLE) AS w FROM graph")
def d5_undirected_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)


@query(f"WITH {EDGES} SELECT src, count(*) AS out_degree, CAST(sum(dst) AS BIGINT) AS total FROM edges GROUP BY src")
def d6_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = G.adjacency(part_edges(spark, sf_dir))
    return a.select("src", F.size("nbrs").cast("long").alias("out_degree"), F.aggregate("nbrs", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"{WITH}, {DEG} SELECT node, CAST(degree AS DOUBLE) AS degree, 0.0::DOUBLE AS loop FROM deg")
def g9_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_graph(spark, sf_dir))


@query(f"{WITH}, {STATS} SELECT comm, CAST(degree AS DOUBLE) AS degree, CAST(inner_w AS DOUBLE) AS inner_weight FROM stats")
def g10_community_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return G.community_stats(g, partition(G.nodes(g))).withColumnRenamed("inner", "inner_weight")


@query(f"{WITH}, {STATS} SELECT round(sum(inner_w / m - pow(degree / (2 * m), 2)), 9) AS modularity FROM stats, (SELECT sum(w) AS m FROM graph)")
def g11_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return G.modularity(g, partition(G.nodes(g))).select(F.round("modularity", 9).alias("modularity"))


@query(f"{WITH} SELECT src AS node, comm, CAST(sum(w) AS DOUBLE) AS w FROM sym JOIN grp ON grp.node = dst WHERE src <> dst GROUP BY ALL")
def g12_j14_neighbor_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return G.neighbor_communities(g, partition(G.nodes(g)))


@query(f"{WITH} SELECT least(a.comm, b.comm) AS src, greatest(a.comm, b.comm) AS dst, CAST(sum(w) AS DOUBLE) AS w FROM graph JOIN grp a ON a.node = src JOIN grp b ON b.node = dst GROUP BY ALL")
def g13_contraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return G.contract(g, partition(G.nodes(g)))


@query(f"""{WITH}, truth AS (SELECT p_partkey AS node, CAST(p_size % 5 AS BIGINT) AS label FROM part WHERE p_partkey % 10 = 0), fine AS (SELECT node, node % 301 AS comm FROM nodes), v AS (SELECT comm, label, count(*) AS n, min(node) AS first FROM fine JOIN truth USING (node) GROUP BY ALL),
best AS (SELECT comm, arg_max(label, (n, -first)) AS label FROM v GROUP BY comm) SELECT node, comm, coalesce(label, 2) AS label FROM fine LEFT JOIN best USING (comm)""")
def g14_majority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("node"), F.pmod("p_size", F.lit(5)).cast("long").alias("label"))
    fine = partition(G.nodes(part_edges(spark, sf_dir)), 301)
    return G.majority_labels(fine, truth, 2).withColumn("label", F.col("label").cast("long"))


@query(f"{WITH} SELECT round(avg(CASE WHEN node % 7 = node % 14 THEN 1.0 ELSE 0.0 END), 9) AS agreement, count(*) AS n FROM nodes")
def g15_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = G.nodes(part_edges(spark, sf_dir))
    return G.agreement(partition(n), partition(n, 14), "node", "comm").select(F.round("agreement", 9).alias("agreement"), "n")


@query(f"{WITH} SELECT comm, count(*) AS n, max(node) AS most FROM grp GROUP BY comm")
def g16_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition(G.nodes(part_edges(spark, sf_dir))).groupBy("comm").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("most"))


@query(f"{WITH} SELECT node, substr(md5(CAST(node AS VARCHAR)), 1, 15) AS key FROM nodes")
def p14_surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.surrogate_keys(G.nodes(part_edges(spark, sf_dir)))


@query(f"{WITH}, f AS (SELECT comm, row_number() OVER (ORDER BY min(node)) - 1 AS new FROM (SELECT node, (node * 37) % 11 AS comm FROM nodes) GROUP BY comm) SELECT node, new AS comm FROM nodes JOIN f ON f.comm = (node * 37) % 11")
def p15_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = G.nodes(part_edges(spark, sf_dir)).select("node", F.pmod(F.col("node") * 37, F.lit(11)).alias("comm"))
    return G.renumber(n)


@query(f"{WITH} SELECT node, ((node % 49) % 7) % 3 AS comm FROM nodes")
def j7_composed_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = partition(G.nodes(part_edges(spark, sf_dir)), 49)
    b = partition(spark.range(49).select(F.col("id").alias("node")), 7)
    c = partition(spark.range(7).select(F.col("id").alias("node")), 3)
    return joins.compose([a, b, c])


@query(f"{WITH}, passes AS (SELECT 0 AS pass, node, node % 40 AS comm FROM nodes UNION ALL SELECT 1, node, node % 9 FROM nodes UNION ALL SELECT 2, node, node % 3 FROM nodes) SELECT CAST(max(pass) AS BIGINT) AS pass FROM (SELECT pass, count(DISTINCT comm) AS n FROM passes GROUP BY pass) WHERE abs(n - 8) <= 2")
def r8_last_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = G.nodes(part_edges(spark, sf_dir))
    passes = None
    for k, m in enumerate((40, 9, 3)):
        one = partition(n, m).withColumn("pass", F.lit(k).cast("long"))
        passes = one if passes is None else passes.unionByName(one)
    return G.last_pass(passes, 8)


RANK = """came{m} AS (SELECT dst AS node, sum(rank / out) AS came FROM links JOIN r{n} ON r{n}.node = src GROUP BY dst),
full{m} AS (SELECT nodes.node, coalesce(came, 0) AS came FROM nodes LEFT JOIN came{m} USING (node)), r{m} AS (SELECT node, came + (1 - sum(came) OVER ()) / count(*) OVER () AS rank FROM full{m})"""


@query(f"{WITH}, links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS out FROM edges), r0 AS (SELECT node, 1.0::DOUBLE / count(*) OVER () AS rank FROM nodes), {', '.join(RANK.format(n=k, m=k + 1) for k in range(5))} SELECT node, round(rank, 9) AS rank FROM r5")
def c5_pagerank_five_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(part_edges(spark, sf_dir), rounds=5, tol=0.0).select("node", F.round("rank", 9).alias("rank"))


SECOND = "e1.src AS prev, e1.dst AS cur, e2.dst AS nxt, CASE WHEN e2.dst = e1.src THEN e2.w / 2.0 WHEN e3.src IS NOT NULL THEN e2.w ELSE e2.w / 4.0 END AS w"


@query(f"""{WITH}, t AS (SELECT {SECOND} FROM sym e1 JOIN sym e2 ON e2.src = e1.dst LEFT JOIN sym e3 ON e3.src = e1.src AND e3.dst = e2.dst),
pr AS (SELECT prev, cur, nxt, w / sum(w) OVER (PARTITION BY prev, cur) AS prob FROM t)
SELECT prev, cur, count(*) AS n, round(max(CASE WHEN nxt = prev THEN prob END), 9) AS back, round(max(prob), 9) AS most, round(sum(prob * (nxt % 7)), 6) AS mixed FROM pr GROUP BY prev, cur""")
def j9_c8_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All second-order steps of the whole graph, told by step's first edge."""


    def each(cur: int, prev: np.ndarray, nxt: np.ndarray, prob: np.ndarray) -> tuple:
        back = prob[np.arange(len(prev)), np.searchsorted(nxt, prev)]
        return prev, np.full(len(prev), cur), np.full(len(prev), len(nxt)), back, prob.max(axis=1), (prob * (nxt % 7)).sum(axis=1)

    t = G.second_order(_graph(spark, sf_dir), each, "prev long, cur long, n long, back double, most double, mixed double", 2.0, 4.0)
    return t.select("prev", "cur", "n", F.round("back", 9).alias("back"), F.round("most", 9).alias("most"), F.round("mixed", 6).alias("mixed"))


@query(f"{WITH} SELECT node FROM nodes UNION SELECT p_partkey FROM part WHERE p_partkey % 3 = 0")
def o2_node_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"))
    return G.nodes(part_edges(spark, sf_dir)).union(p).distinct()


@query(f"{WITH} SELECT (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT node FROM nodes)) AS missing, (SELECT count(*) FROM (SELECT node FROM nodes EXCEPT SELECT p_partkey FROM part)) AS extra")
def o4_same_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"))
    return G.same_nodes(p, G.nodes(part_edges(spark, sf_dir)))


@query(f"WITH {EDGES}, a AS (SELECT src, list(dst) AS nbrs FROM edges GROUP BY src) SELECT src, CAST(len(list_filter(nbrs, lambda x: x % 5 <> 0)) AS BIGINT) AS fresh FROM a")
def o3_unvisited_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = G.adjacency(part_edges(spark, sf_dir))
    visited = F.filter("nbrs", lambda x: F.pmod(x, F.lit(5)) == 0)
    return a.select("src", F.size(F.array_except("nbrs", visited)).cast("long").alias("fresh"))


@query(f"WITH {EDGES} SELECT CAST(count(*) AS BIGINT) AS bad FROM edges WHERE w <= 0")
def v8_bad_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.bad_edges(part_edges(spark, sf_dir)).agg(F.count(F.lit(1)).alias("bad"))


VECS = f"{POINTS}, e AS (SELECT a.id AS src, b.id AS dst, a.v AS va, b.v AS vb FROM pts a JOIN pts b ON b.id = a.id + 1)"


@query(f"""WITH {VECS}, z AS (SELECT src, dst, unnest(va) AS x, unnest(vb) AS y FROM e) SELECT src, dst, round(sum(x * y), 6) AS hadamard, round(sum((x + y) / 2), 6) AS average, round(sum(abs(x - y)), 6) AS l1, round(sum((x - y) * (x - y)), 6) AS l2 FROM z GROUP BY ALL""")
def j6_p2_edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", "v")
    e = p.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    rows = joins.both_ends(e, p)
    return rows.select("src", "dst", *(F.round(F.aggregate(f(F.col("va"), F.col("vb")), F.lit(0.0), lambda a, x: a + x), 6).alias(n) for n, f in EDGE_FEATURES.items()))


@query(f"WITH {POINTS} SELECT max(id) AS src, max(id) + 1 AS dst FROM pts")
def j6_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", "v")
    return joins.both_ends(p.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), p, strict=True).select("src", "dst")


MOVED = """cd{n} AS (SELECT comm, sum(degree) AS cdeg FROM deg JOIN p{n} USING (node) GROUP BY comm),
nr{n} AS (SELECT src AS node, comm AS there, sum(w) AS w FROM sym JOIN p{n} ON p{n}.node = dst WHERE src <> dst GROUP BY ALL),
gn{n} AS (SELECT a.node, a.there, a.w - coalesce(s.w, 0) - (t.cdeg - o.cdeg + degree) * (degree / (2 * m)) AS gain FROM nr{n} a JOIN p{n} p ON p.node = a.node JOIN deg d ON d.node = a.node JOIN cd{n} t ON t.comm = a.there JOIN cd{n} o ON o.comm = p.comm LEFT JOIN nr{n} s ON s.node = a.node AND s.there = p.comm, tot
WHERE a.there <> p.comm AND ({u} < 0.5) = {turn}), mv{n} AS (SELECT node, arg_max(there, (gain, -there)) AS there FROM gn{n} WHERE gain > 1e-12 GROUP BY node),
t{n} AS (SELECT node, coalesce(there, comm) AS comm FROM p{n} LEFT JOIN mv{n} USING (node)), {before}, {after},
p{m} AS (SELECT p{n}.node, CASE WHEN (SELECT q FROM qt{n}) - (SELECT q FROM qp{n}) >= 1e-7 THEN t{n}.comm ELSE p{n}.comm END AS comm FROM p{n} JOIN t{n} USING (node))"""
QUALITY = """q{k}{n} AS (SELECT sum(inner_w / m - pow(degree / (2 * m), 2)) AS q FROM (SELECT comm, sum(degree) AS degree FROM deg JOIN {k}{n} USING (node) GROUP BY comm) LEFT JOIN (SELECT a.comm, sum(w) AS inner_w0 FROM graph JOIN {k}{n} a ON a.node = src JOIN {k}{n} b ON b.node = dst WHERE a.comm = b.comm GROUP BY a.comm) USING (comm), tot, LATERAL (SELECT coalesce(inner_w0, 0) AS inner_w))"""


def _moved(n: int) -> str:
    return MOVED.format(n=n, m=n + 1, u=uniform_sql(n // 2, "a.node"), turn=str(n % 2 == 0).lower(), before=QUALITY.format(k="p", n=n), after=QUALITY.format(k="t", n=n))


@query(f"""{WITH}, {DEG}, tot AS (SELECT sum(w) AS m FROM graph), p0 AS (SELECT node, node AS comm FROM nodes), {', '.join(map(_moved, range(4)))},
f AS (SELECT comm, row_number() OVER (ORDER BY min(node)) - 1 AS new FROM p4 GROUP BY comm) SELECT node, new AS comm FROM p4 JOIN f USING (comm)""")
def c6_louvain_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rounds of moves, each kept if modularity rises, and the communities numbered by their first node."""
    return G.louvain(part_edges(spark, sf_dir), max_passes=1, max_rounds=4).select("node", "comm")


@query()
def c6_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes; rounds stop when modularity stays. The number of passes and rounds is bounded by the operator's defaults."""
    return G.Louvain().fit(part_edges(spark, sf_dir)).passes


STEP = """s{m} AS (SELECT start, CASE WHEN f IS NOT NULL AND len(f) > 0 THEN list_append(path, f[1 + CAST(floor(u * len(f)) AS BIGINT)]) ELSE path END AS path, CASE WHEN f IS NOT NULL AND len(f) > 0 THEN f[1 + CAST(floor(u * len(f)) AS BIGINT)] END AS cur
FROM (SELECT start, path, CASE WHEN cur IS NULL THEN NULL ELSE list_filter(nbrs, lambda x: NOT list_contains(path, x)) END AS f, {u} AS u FROM s{n} LEFT JOIN adj ON adj.src = cur))"""


@query(f"""{WITH}, adj AS (SELECT src, list_sort(list(DISTINCT dst)) AS nbrs FROM sym GROUP BY src), s0 AS (SELECT node AS start, [node] AS path, node AS cur FROM nodes),
{', '.join(STEP.format(m=k, n=k - 1, u=uniform_sql(5, 'start', '0', str(k))) for k in range(1, 6))} SELECT start, array_to_string(path, '-') AS path FROM s5""")
def c7_random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.symmetric(_graph(spark, sf_dir))
    return G.random_walks(g, G.nodes(g), length=6, walks=1, seed=5).select("start", F.concat_ws("-", F.col("path").cast("array<string>")).alias("path"))


HOP = """t{m} AS (SELECT start, e2.dst AS nxt, CASE WHEN e2.dst = prev THEN e2.w / 2.0 WHEN e3.src IS NOT NULL THEN e2.w ELSE e2.w / 4.0 END AS x FROM w{n} JOIN sym e2 ON e2.src = cur LEFT JOIN sym e3 ON e3.src = prev AND e3.dst = e2.dst),
c{m} AS (SELECT start, nxt, sum(x) OVER (PARTITION BY start ORDER BY nxt) AS c, sum(x) OVER (PARTITION BY start) AS total FROM t{m}),
n{m} AS (SELECT start, min(nxt) FILTER (WHERE c > {u} * 0.999999999 * total) AS n FROM c{m} GROUP BY start),
w{m} AS (SELECT w{n}.start, CASE WHEN n IS NULL THEN path ELSE list_append(path, n) END AS path, CASE WHEN n IS NOT NULL THEN w{n}.cur END AS prev, n AS cur FROM w{n} LEFT JOIN n{m} ON n{m}.start = w{n}.start)"""


@query(f"""{WITH}, adj AS (SELECT src, list_sort(list(dst)) AS nbrs FROM sym GROUP BY src),
w1 AS (SELECT node AS start, [node, nbrs[1 + CAST(floor({uniform_sql(5, 'node', '0', '1')} * len(nbrs)) AS BIGINT)]] AS path, node AS prev, nbrs[1 + CAST(floor({uniform_sql(5, 'node', '0', '1')} * len(nbrs)) AS BIGINT)] AS cur FROM nodes JOIN adj ON adj.src = node),
{', '.join(HOP.format(m=k, n=k - 1, u=uniform_sql(5, 'start', '0', str(k))) for k in range(2, 5))} SELECT start, array_to_string(path, '-') AS path FROM w4""")
def c8_biased_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return G.biased_walks(g, G.nodes(g), length=5, walks=1, p=2.0, q=4.0, seed=5).select("start", F.concat_ws("-", F.col("path").cast("array<string>")).alias("path"))


@query()
def c9_deepwalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.deepwalk(part_edges(spark, sf_dir), size=8, length=5, walks=1)


@query()
def c9_deepwalk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks, vectors, clusters and majority labels of all nodes from a tenth that is labelled."""
    truth = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("node"), F.pmod("p_size", F.lit(5)).cast("long").alias("label"))
    return embed.DeepWalk(5, size=8, length=5, walks=1).fit(part_edges(spark, sf_dir)).predict(truth, 2)


def random_pairs(v: DataFrame, seed: int, which: str = "id % 2 = 1") -> DataFrame:
    """src, dst: each odd id (or those of `which`) with another id, drawn by hash from all."""
    at = positions(v.select("id"), "id")
    n = at.count()
    away = F.floor(uniform(seed, F.col("id")) * (n - 1)) + 1
    drawn = at.where(which).select(F.col("id").alias("src"), (F.pmod(F.col("pos") - 1 + away, F.lit(n)) + 1).alias("pos"))
    return drawn.join(at.withColumnRenamed("id", "dst"), "pos").select("src", "dst")


@query()
def c10_link_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = points(spark, sf_dir).select("id", "v")
    pos = v.where("id % 2 = 0").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    neg = random_pairs(v, 10)
    return embed.LinkPredictor((8,), max_iter=5).fit(pos, neg, v).predict(pos.unionByName(neg))


@query()
def c10_c13_link_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order walks over three quarters of the edges, vectors, features, a perceptron, and the AUC of the other quarter against random pairs."""
    g = _graph(spark, sf_dir)
    ids = G.nodes(g).select(F.col("node").alias("id"))
    return embed.link_auc(g, random_pairs(ids, 11, "true"), (8,), max_iter=20, size=8, length=5, walks=1, policy="node2vec", p=2.0, q=4.0)
