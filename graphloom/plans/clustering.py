"""Vector clustering: distances, assignment, updates, mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import vector
from graphloom.functions.rand import uniform, uniform_sql, uniform_value
from graphloom.operators import cluster, embed, validate
from graphloom.plans.base import ASSIGNED, CENTERS, POINTS, first_centers, points, query

WITH = f"WITH {POINTS}, {CENTERS}, {ASSIGNED}"
LONG = "long AS (SELECT id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM pts)"
MEANS = "mean AS (SELECT label AS k, pos, avg(x) AS mean FROM long JOIN lab USING (id) GROUP BY ALL)"


@query(f"WITH {POINTS}, {CENTERS} SELECT id, CAST(k AS BIGINT) AS k, round(list_distance(v, c), 6) AS dist FROM pts, ctr")
def p1_j2_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return cluster.distances(p, first_centers(p)).select("id", F.col("k").cast("long").alias("k"), F.round("dist", 6).alias("dist"))


@query(f"{WITH} SELECT id, CAST(label AS BIGINT) AS label, round(dist, 6) AS dist FROM lab")
def g2_nearest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return cluster.assign(p, first_centers(p)).select("id", F.col("label").cast("long").alias("label"), F.round("dist", 6).alias("dist"))


@query(f"{WITH}, {LONG}, {MEANS} SELECT CAST(ctr.k AS BIGINT) AS k, CAST(l.pos AS BIGINT) AS pos, round(coalesce(mean, 0), 6) AS mean FROM ctr CROSS JOIN (SELECT unnest(range(64)) AS pos) l LEFT JOIN mean ON mean.k = ctr.k AND mean.pos = l.pos")
def g1_cluster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    c = first_centers(p)
    return cluster.means(cluster.assign(p, c), c).select(F.col("k").cast("long").alias("k"), F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query(f"{WITH} SELECT round(sum(dist), 5) AS cost, round(-sum(dist), 5) AS score FROM lab")
def g3_cluster_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return cluster.cost(cluster.assign(p, first_centers(p))).select(F.round("cost", 5).alias("cost"), F.round(-F.col("cost"), 5).alias("score"))


@query(f"{WITH}, {LONG}, {MEANS}, old AS (SELECT k, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS x FROM ctr) SELECT round(sum(abs(x - coalesce(mean, 0))), 6) AS shift FROM old LEFT JOIN mean USING (k, pos)")
def g4_center_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    c = first_centers(p)
    new = cluster.centers_of(cluster.means(cluster.assign(p, c), c))
    return cluster.shift(c, new).select(F.round("shift", 6).alias("shift"))


@query(f"{WITH} SELECT CAST(label AS BIGINT) AS label, round(max(dist), 6) AS radius, row_number() OVER (ORDER BY max(dist), label) - 1 AS new_label FROM lab GROUP BY label")
def g5_radius_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return cluster.radius_order(cluster.assign(p, first_centers(p))).select(F.col("label").cast("long").alias("label"), F.round("radius", 6).alias("radius"), "new_label")


@query(f"WITH {POINTS}, {LONG}, m AS (SELECT pos, avg(x) AS m FROM long GROUP BY pos) SELECT id, CAST(pos AS BIGINT) AS pos, round(x - m, 6) AS x FROM long JOIN m USING (pos)")
def p32_centered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.centered(points(spark, sf_dir)).select("id", F.posexplode("v").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


ROUND = """d{n} AS (SELECT id, k, list_distance(v, c) AS dist FROM pts, c{n}), l{n} AS (SELECT id, arg_min(k, (dist, k)) AS label, min(dist) AS dist FROM d{n} GROUP BY id),
m{n} AS (SELECT label AS k, pos, avg(x) AS x FROM long JOIN l{n} USING (id) GROUP BY ALL),
c{m} AS (SELECT k, list(coalesce(x, 0.0) ORDER BY pos) AS c FROM (SELECT c{n}.k, p.pos, m{n}.x FROM c{n} CROSS JOIN (SELECT unnest(range(64)) AS pos) p LEFT JOIN m{n} ON m{n}.k = c{n}.k AND m{n}.pos = p.pos) GROUP BY k)"""
UNROLLED = f"WITH {POINTS}, {LONG}, c0 AS (SELECT id AS k, v AS c FROM pts WHERE id < 5), {ROUND.format(n=0, m=1)}, {ROUND.format(n=1, m=2)}, {ROUND.format(n=2, m=3)}, d3 AS (SELECT id, k, list_distance(v, c) AS dist FROM pts, c3), l3 AS (SELECT id, arg_min(k, (dist, k)) AS label, min(dist) AS dist FROM d3 GROUP BY id)"


@query(f"{UNROLLED} SELECT id, CAST(label AS BIGINT) AS label, round(dist, 5) AS dist FROM l3")
def c1_kmeans_three_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    labelled, _, _ = cluster.lloyd(p, first_centers(p), rounds=3, tol=0.0)
    return labelled.select("id", F.col("label").cast("long").alias("label"), F.round("dist", 5).alias("dist"))


@query(f"""{UNROLLED}, costs AS (SELECT 3 AS run, sum(dist) AS cost FROM l3 UNION ALL SELECT 1, sum(dist) FROM l1 UNION ALL SELECT 0, sum(dist) FROM l0) SELECT CAST(arg_min(run, cost) AS BIGINT) AS run, round(min(cost), 4) AS cost FROM costs""")
def g25_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    c, costs = first_centers(p), None
    for run in (0, 1, 3):
        labelled = cluster.assign(p, c) if not run else cluster.lloyd(p, c, rounds=run, tol=0.0)[0]
        one = cluster.cost(labelled).withColumn("run", F.lit(run).cast("long"))
        costs = one if costs is None else costs.unionByName(one)
    return costs.agg(F.min_by("run", "cost").alias("run"), F.round(F.min("cost"), 4).alias("cost"))


@query(f"{WITH}, sq AS (SELECT id, min(dist * dist) AS sq FROM near GROUP BY id), cum AS (SELECT id, sum(sq) OVER (ORDER BY id) AS c, sum(sq) OVER () AS t FROM sq) SELECT min(id) AS id FROM cum WHERE c > 0.37 * t")
def c2_plus_plus_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    closest = cluster.distances(p, first_centers(p), squared=True).groupBy("id").agg(F.min("dist").alias("sq"))
    return cluster.plus_plus_next(p, closest, 0.37).select("id")


@query(f"WITH {POINTS} SELECT id FROM pts ORDER BY {uniform_sql(4, 'id')}, id LIMIT 7")
def c3_hash_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).orderBy(uniform(4, F.col("id")), "id").limit(7).select("id")


RESP = f"""{WITH}, lp AS (SELECT id, k, -0.5 * dist * dist - ln(5.0) AS lp FROM near), tot AS (SELECT id, max(lp) + ln(sum(exp(lp - mx))) AS total FROM (SELECT *, max(lp) OVER (PARTITION BY id) AS mx FROM lp) GROUP BY id),
resp AS (SELECT lp.id, k, exp(lp - total) AS resp, total FROM lp JOIN tot USING (id))"""


def _resp(p: DataFrame) -> DataFrame:
    lp = cluster.distances(p, first_centers(p), squared=True).select("id", "k", (-0.5 * F.col("dist") - F.log(F.lit(5.0))).alias("lp"))
    return cluster.responsibilities(lp)


@query(f"{RESP} SELECT id, CAST(k AS BIGINT) AS k, round(resp, 6) AS resp, round(total, 6) AS total FROM resp")
def g7_c4_responsibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resp(points(spark, sf_dir)).select("id", F.col("k").cast("long").alias("k"), F.round("resp", 6).alias("resp"), F.round("total", 6).alias("total"))


@query(f"{RESP} SELECT round(avg(total), 6) AS bound FROM resp WHERE k = 0")
def g8_mean_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resp(points(spark, sf_dir)).where("k = 0").agg(F.round(F.avg("total"), 6).alias("bound"))


@query(f"""{RESP}, long_ AS (SELECT id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM pts), nk AS (SELECT k, sum(resp) + 10 * 2.220446049250313e-16 AS nk FROM resp GROUP BY k),
mu AS (SELECT k, i, sum(resp * x) / any_value(nk) AS mu FROM resp JOIN long_ USING (id) JOIN nk USING (k) GROUP BY k, i),
cov AS (SELECT r.k, a.i, b.i AS j, sum(resp * (a.x - m.mu) * (b.x - n.mu)) / any_value(nk) + CASE WHEN a.i = b.i THEN 1e-6 ELSE 0 END AS cov FROM resp r JOIN long_ a ON a.id = r.id JOIN long_ b ON b.id = r.id JOIN mu m ON m.k = r.k AND m.i = a.i JOIN mu n ON n.k = r.k AND n.i = b.i JOIN nk ON nk.k = r.k GROUP BY r.k, a.i, b.i)
SELECT CAST(k AS BIGINT) AS k, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(cov, 7) AS cov FROM cov""")
def g6_c4_weighted_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    found = cluster.weighted_parameters(p.select("id", "v"), _resp(p).select("id", "k", "resp"))
    rows = spark.createDataFrame([(k, [c.tolist() for c in cov]) for k, (_, _, cov) in found.items()], "k long, cov array<array<double>>")  # k matrices
    long_ = rows.select("k", F.posexplode("cov").alias("i", "row")).select("k", "i", F.posexplode("row").alias("j", "cov"))
    return long_.select(*(F.col(c).cast("long").alias(c) for c in ("k", "i", "j")), F.round("cov", 7).alias("cov"))


SEED = 2
SQ = "pow(list_distance({0}, {1}), 2)"
PLUS = """cum{n} AS (SELECT id, sum(sq) OVER (ORDER BY id) AS c, sum(sq) OVER () AS t FROM s{n}),
cand{n} AS (SELECT j, min(id) AS id FROM cum{n}, (VALUES {draws}) d(j, u) WHERE c > u * t GROUP BY j),
pot{n} AS (SELECT j, any_value(c.id) AS id, sum(least(sq, {sq})) AS pot FROM cand{n} c JOIN pts q ON q.id = c.id, s{n} JOIN pts p ON p.id = s{n}.id GROUP BY j),
q{n} AS (SELECT {n} AS k, id, v AS c FROM pts WHERE id = (SELECT arg_min(id, (pot, j)) FROM pot{n})),
s{m} AS (SELECT s{n}.id, least(sq, {far}) AS sq FROM s{n} JOIN pts p ON p.id = s{n}.id, q{n})"""


def _plus(n: int, trials: int) -> str:
    draws = ", ".join(f"({j}, {uniform_value(SEED, n, j)!r}::DOUBLE)" for j in range(trials))
    return PLUS.format(n=n, m=n + 1, draws=draws, sq=SQ.format("p.v", "q.v"), far=SQ.format("p.v", "q{n}.c".format(n=n)))


SEEDED = f"""WITH {POINTS}, {LONG}, q0 AS (SELECT 0 AS k, id, v AS c FROM pts ORDER BY {uniform_sql(SEED, 'id')}, id LIMIT 1), s1 AS (SELECT p.id, {SQ.format('p.v', 'q0.c')} AS sq FROM pts p, q0),
{_plus(1, 3)}, {_plus(2, 3)}, {_plus(3, 3)}, c0 AS (SELECT k, c FROM q0 UNION ALL SELECT k, c FROM q1 UNION ALL SELECT k, c FROM q2 UNION ALL SELECT k, c FROM q3),
{ROUND.format(n=0, m=1)}, {ROUND.format(n=1, m=2)}, d2 AS (SELECT id, k, list_distance(v, c) AS dist FROM pts, c2), l2 AS (SELECT id, arg_min(k, (dist, k)) AS label, min(dist) AS dist FROM d2 GROUP BY id)"""


@query(f"{SEEDED} SELECT id, CAST(label AS BIGINT) AS label, round(dist, 5) AS dist FROM l2")
def c1_kmeans_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy k-means++ seeding and two rounds, whole, through the estimator."""
    p = points(spark, sf_dir)
    model = cluster.KMeans(4, "k-means++", n_init=1, max_iter=2, tol=0.0, seed=SEED).fit(p)
    return model.predict(p).select("id", F.col("label").cast("long").alias("label"), F.round("dist", 5).alias("dist"))


@query()
def c4_gaussian_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", "v")
    return cluster.GaussianMixture(3, max_iter=2, seed=1).fit(p).predict(p)


@query()
def c14_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.project(points(spark, sf_dir), 2)


@query(f"WITH {POINTS} SELECT count(*) AS rows, count(DISTINCT len(v)) AS widths, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, CAST(sum(len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x)))) AS BIGINT) AS not_finite FROM pts")
def v1_v6_vector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.vector_report(points(spark, sf_dir))


@query(f"WITH {POINTS}, q AS (SELECT id AS query, v AS qv FROM pts WHERE id % 50 = 0), s AS (SELECT query, id, list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))) AS c FROM q JOIN pts ON id <> query), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM s) SELECT query, id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 5")
def r9_most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = points(spark, sf_dir).select(F.col("id").alias("token"), F.col("v").alias("vec"))
    out = embed.most_similar(v.where("token % 50 = 0"), v, 5)
    return out.select("query", F.col("token").alias("id"), F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {POINTS}, q AS (SELECT v AS qv FROM pts WHERE id = 3), d AS (SELECT id, list_distance(qv, v) AS dist FROM q, pts WHERE id <> 3) SELECT id, rank() OVER (ORDER BY dist) AS rank FROM d WHERE dist < (SELECT dist FROM d WHERE id = 77)")
def r10_closer_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    q = p.where("id = 3").select(F.col("v").alias("qv"))
    d = p.where("id <> 3").join(F.broadcast(q)).select("id", vector.distance(F.col("qv"), F.col("v")).alias("dist"))
    limit = d.where("id = 77").select(F.col("dist").alias("limit"))
    near = d.join(F.broadcast(limit)).where("dist < limit")
    from pyspark.sql import Window

    return near.select("id", F.rank().over(Window.orderBy("dist")).cast("long").alias("rank"))


@query(f"WITH {POINTS} SELECT id, CAST(list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END) AS BIGINT[])::VARCHAR AS hot, CAST([label, label, label] AS BIGINT[])::VARCHAR AS triple FROM pts")
def p26_p28_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return p.select("id", vector.one_hot(F.col("label"), 10).cast("string").alias("hot"), vector.repeat(F.col("label"), 3).cast("string").alias("triple"))


@query(f"WITH {POINTS}, {CENTERS}, cut AS (SELECT k, CASE WHEN k % 2 = 0 THEN c[1:60] ELSE c END AS c FROM ctr) SELECT CAST(k AS BIGINT) AS k, CAST(len(c) AS BIGINT) AS width, (SELECT CAST(max(len(v)) AS BIGINT) FROM pts) AS wanted FROM cut WHERE len(c) <> (SELECT max(len(v)) FROM pts)")
def v4_center_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    c = first_centers(p).withColumn("c", F.when(F.col("k") % 2 == 0, F.slice("c", 1, 60)).otherwise(F.col("c")))
    return validate.bad_centers(c, p).select(*(F.col(x).cast("long").alias(x) for x in ("k", "width", "wanted")))


CASES = [
    ("components that aren't shares", "weights must be n_components shares that sum to 1"), ("fewer points than clusters", "fewer points than clusters"), ("means without the others", "weights, means and precisions are given together"),
    ("means of another shape", "means must be (k, d) and precisions (k, d, d)"), ("mixture not fitted", "not fitted"), ("no clusters", "n_clusters, n_init and max_iter must be positive"), ("no rounds", "n_clusters, n_init and max_iter must be positive"),
    ("no runs", "n_clusters, n_init and max_iter must be positive"), ("precision that isn't positive", "precisions must be symmetric and positive definite"), ("predictor not fitted", "not fitted"), ("clusters not fitted", "not fitted"), ("what fits", None),
]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(c.replace("'", "''"), "NULL" if t is None else f"'{t}'") for c, t in CASES) + ") t(\"case\", complaint)")
def v2_v3_v5_v9_v10_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What estimators say of parameters that can't be, and of predictions before a fit; the wanted complaints stand in the SQL."""
    p = points(spark, sf_dir)
    one, two, eye = [1.0], [[0.0, 0.0]], [[[1.0, 0.0], [0.0, 1.0]]]
    mixture, kmeans = cluster.GaussianMixture, cluster.KMeans
    return validate.complaints(spark, {
        "components that aren't shares": lambda: mixture(1, weights_init=[0.5], means_init=two, precisions_init=eye),
        "fewer points than clusters": lambda: kmeans(3).fit(p.limit(2)),
        "means without the others": lambda: mixture(1, means_init=two),
        "means of another shape": lambda: mixture(1, weights_init=one, means_init=[0.0], precisions_init=eye),
        "mixture not fitted": lambda: mixture(2).predict(p),
        "no clusters": lambda: kmeans(0),
        "no rounds": lambda: kmeans(2, max_iter=0),
        "no runs": lambda: kmeans(2, n_init=0),
        "precision that isn't positive": lambda: mixture(1, weights_init=one, means_init=two, precisions_init=[[[1.0, 0.0], [0.0, -1.0]]]),
        "predictor not fitted": lambda: embed.LinkPredictor().predict(p),
        "clusters not fitted": lambda: kmeans(2).predict(p),
        "what fits": lambda: mixture(1, weights_init=one, means_init=two, precisions_init=eye),
    })
