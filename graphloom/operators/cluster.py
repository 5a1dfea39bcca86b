"""k-means and Gaussian mixtures over (id, v array<double>), from exact aggregates.

Centers and mixture parameters are k rows with k given, so they are broadcast and collected; points never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vector
from graphloom.functions.rand import uniform, uniform_value
from graphloom.operators.checkpoints import written


def distances(points: DataFrame, centers: DataFrame, squared: bool = False) -> DataFrame:
    """id, k, dist for every point and center."""
    d = vector.squared_distance(F.col("v"), F.col("c")) if squared else vector.distance(F.col("v"), F.col("c"))
    return points.join(F.broadcast(centers)).select("id", "k", d.alias("dist"))


def assign(points: DataFrame, centers: DataFrame) -> DataFrame:
    """id, label, dist: the nearest center, ties to the smallest k. Centers ride along as one literal-sized row, so nothing is shuffled."""
    packed = centers.agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("cs"))
    near = F.array_min(F.transform("cs", lambda x: F.struct(vector.distance(F.col("v"), x["c"]).alias("dist"), x["k"].alias("k"))))
    return points.join(F.broadcast(packed)).withColumn("_n", near).select("id", "v", F.col("_n.k").alias("label"), F.col("_n.dist").alias("dist"))


def means(labelled: DataFrame, centers: DataFrame) -> DataFrame:
    """k, pos, mean in long form for every center; 0 for clusters without members (the global mean of centred data)."""
    sums = labelled.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("mean"))
    grid = centers.select("k", F.posexplode("c").alias("pos", "_x")).drop("_x")
    return grid.join(F.broadcast(sums), (grid["k"] == sums["label"]) & (grid["pos"] == sums["pos"]), "left").select(grid["k"], grid["pos"], F.coalesce("mean", F.lit(0.0)).alias("mean"))


def centers_of(long: DataFrame) -> DataFrame:
    """k, c from k, pos, mean."""
    rows = long.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("_m"))
    return rows.select("k", F.transform("_m", lambda x: x["mean"]).alias("c"))


def cost(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.sum("dist").alias("cost"))


def shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Summed absolute differences of old and new centers."""
    both = old.select("k", F.col("c").alias("_o")).join(new.select("k", "c"), "k")
    return both.agg(F.sum(F.aggregate(F.zip_with("_o", "c", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)).alias("shift"))


def radius_order(labelled: DataFrame) -> DataFrame:
    """label, radius, new_label: clusters by ascending radius."""
    r = labelled.groupBy("label").agg(F.max("dist").alias("radius"))
    return r.withColumn("new_label", (F.row_number().over(Window.orderBy("radius", "label")) - 1).cast("long"))


def centered(points: DataFrame) -> DataFrame:
    """Points minus the mean of all; the mean is one row."""
    mean = points.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_m")).select(F.transform("_m", lambda x: x["m"]).alias("_mean"))
    return points.join(F.broadcast(mean)).withColumn("v", vector.subtract(F.col("v"), F.col("_mean"))).drop("_mean")


def _frame(df: DataFrame, centers: list[list[float]]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centers)], "k int, c array<double>")


def lloyd(points: DataFrame, centers: DataFrame, rounds: int = 300, tol: float = 1e-4) -> tuple[DataFrame, DataFrame, int]:
    """(labelled, centers, rounds taken): once the centers move by no more than tol (0: not at all) the old ones stay, as do the labels by them."""
    taken = 0
    for taken in range(1, rounds + 1):
        labelled = assign(points, centers)
        new = sorted(centers_of(means(labelled, centers)).collect(), key=lambda r: r["k"])
        new = _frame(points, [r["c"] for r in new])
        moved = shift(centers, new).first()[0]
        if moved <= tol:
            return labelled, centers, taken
        centers = new
    return assign(points, centers), centers, taken


def seed_centers(points: DataFrame, k: int, seed: int, init_size: int | None = None) -> DataFrame:
    """k points by hash order: a top-k, never a global sort. init_size: from about so many points, by another hash."""
    if init_size is not None:
        n = points.count()
        if n > init_size:
            points = points.where(uniform(seed + 7919, F.col("id")) < max(init_size, 4 * k) / n)
    rows = points.orderBy(uniform(seed, F.col("id")), "id").limit(k).collect()
    return _frame(points, [r["v"] for r in rows])


def plus_plus_next(points: DataFrame, closest: DataFrame, *draws: float, buckets: int = 64) -> DataFrame:
    """draw, id, v: for each draw the first point, in order of id, whose running sum of squared distances to its closest center (id, sq) exceeds draw * total.

    Two levels: sums by bucket of the id's range, then inside the buckets that draws fall into.
    """
    lo, hi = closest.agg(F.min("id"), F.max("id")).first()
    width = max(1, -(-(hi - lo + 1) // buckets))
    b = F.floor((F.col("id") - lo) / width)
    sums = closest.groupBy(b.alias("b")).agg(F.sum("sq").alias("s")).orderBy("b").collect()  # `buckets` rows at most
    total, wanted = sum(r["s"] for r in sums), []
    for k, draw in enumerate(draws):
        before, pick = 0.0, (sums[-1]["b"], sum(r["s"] for r in sums[:-1]))
        for r in sums:
            if before + r["s"] > draw * total:
                pick = (r["b"], before)
                break
            before += r["s"]
        wanted.append((k, pick[0], pick[1], draw * total))
    wanted = F.broadcast(points.sparkSession.createDataFrame(wanted, "draw int, _b long, _before double, _target double"))
    starts = wanted.select("_b", "_before").distinct()
    inside = closest.withColumn("_b", b).join(starts, "_b").withColumn("_cum", F.col("_before") + F.sum("sq").over(Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = inside.select("_b", "id", "_cum").join(wanted.select("draw", "_b", "_target"), "_b").where(F.col("_cum") > F.col("_target")).groupBy("draw").agg(F.min("id").alias("id"))
    return points.join(F.broadcast(first), "id").select("draw", "id", "v")


def plus_plus(points: DataFrame, k: int, seed: int, trials: int | None = None) -> DataFrame:
    """Greedy k-means++: 2 + floor(ln k) candidates a center, drawn by hash, the one that lowers the potential most is kept.

    Each point keeps its squared distance to the closest center so far; all candidates of a center are tried in one pass.
    """
    trials = trials or 2 + int(np.log(k))
    chosen = [points.orderBy(uniform(seed, F.col("id")), "id").limit(1).first()["v"]]
    point = lambda v: F.array(*(F.lit(float(x)) for x in v))
    closest = written(points.select("id", "v", vector.squared_distance(F.col("v"), point(chosen[0])).alias("sq")), "kpp")
    while len(chosen) < k:
        found = plus_plus_next(points, closest.select("id", "sq"), *(uniform_value(seed, len(chosen), j) for j in range(trials))).orderBy("draw").collect()
        tried = [F.sum(F.least("sq", vector.squared_distance(F.col("v"), point(r["v"])))).alias(f"p{j}") for j, r in enumerate(found)]
        potentials = closest.agg(*tried).first()
        best = found[int(np.argmin(list(potentials)))]["v"]
        chosen.append(best)
        if len(chosen) < k:
            closest = written(closest.withColumn("sq", F.least("sq", vector.squared_distance(F.col("v"), point(best)))), "kpp")
    return _frame(points, chosen)


class KMeans:
    """k-means with the best of n_init runs by the (not squared) cost."""

    def __init__(self, n_clusters: int = 5, init: str | DataFrame = "k-means++", n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 0):
        if n_init < 1 or max_iter < 1 or n_clusters < 1:
            raise ValueError("n_clusters, n_init and max_iter must be positive")
        self.k, self.init, self.n_init, self.max_iter, self.tol, self.seed = n_clusters, init, n_init, max_iter, tol, seed
        self.centers: DataFrame | None = None

    def fit(self, points: DataFrame) -> KMeans:
        if points.limit(self.k).count() < self.k:
            raise ValueError("fewer points than clusters")
        best = None
        for run in range(self.n_init if isinstance(self.init, str) else 1):
            start = self.init if not isinstance(self.init, str) else plus_plus(points, self.k, self.seed + run) if self.init == "k-means++" else seed_centers(points, self.k, self.seed + run)
            labelled, centers, _ = lloyd(points, start, self.max_iter, self.tol)
            c = cost(labelled).first()[0]
            if best is None or c < best[0]:
                best = (c, centers)
        self.cost, self.centers = best
        return self

    def predict(self, points: DataFrame) -> DataFrame:
        if self.centers is None:
            raise ValueError("not fitted")
        return assign(points, self.centers)

    def score(self, points: DataFrame) -> float:
        return -cost(self.predict(points)).first()[0]


def responsibilities(logs: DataFrame) -> DataFrame:
    """id, k, lp -> id, k, resp, total (log-sum-exp of the id's lp): computed per row group from its maximum."""
    w = Window.partitionBy("id")
    out = logs.withColumn("_m", F.max("lp").over(w))
    out = out.withColumn("total", F.col("_m") + F.log(F.sum(F.exp(F.col("lp") - F.col("_m"))).over(w)))
    return out.select("id", "k", F.exp(F.col("lp") - F.col("total")).alias("resp"), "total")


def _moments(points: DataFrame, resp: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """k -> (weight, weighted sum, weighted second moment, shift): moments about a shift, summed by partition in NumPy and once more on the driver, which gets a row of d * d numbers a partition and k."""
    rows = points.join(resp, "id").select("k", "resp", "v")
    shift = np.asarray(points.select("v").first()["v"], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, sums = len(shift), {}
        for b in batches:
            k, r = b.column(0).to_numpy(), b.column(1).to_numpy()
            v = b.column(2).flatten().to_numpy().reshape(-1, d) - shift
            for one in np.unique(k).tolist():
                w, x = r[k == one], v[k == one]
                held = sums.setdefault(one, np.zeros(1 + d + d * d))
                held += np.concatenate([[w.sum()], w @ x, ((x * w[:, None]).T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["k", "sums"])

    d, out = len(shift), {}
    for r in rows.select(F.col("k").cast("long"), "resp", "v").mapInArrow(run, "k long, sums array<double>").collect():
        out[r["k"]] = out.get(r["k"], 0.0) + np.asarray(r["sums"])
    return {k: (x[0], x[1 : 1 + d], x[1 + d :].reshape(d, d), shift) for k, x in out.items()}


def weighted_parameters(points: DataFrame, resp: DataFrame, eps: float = 1e-6) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """k -> (nk, mean, covariance) of (id, v) weighted by (id, k, resp); eps is added on the diagonal. One pass, nothing exploded."""
    out = {}
    for k, (w, first, second, shift) in sorted(_moments(points, resp).items()):
        nk = w + 10 * float(np.finfo(float).eps)
        m = first / nk
        # Sum of r (x - mean)(x - mean)' about the shifted origin.
        cov = (second - np.outer(m, first) - np.outer(first, m) + w * np.outer(m, m)) / nk
        out[k] = (nk, m + shift * (w / nk), cov + eps * np.eye(len(m)))
    return out


class GaussianMixture:
    """Full-covariance EM. Sums run distributed; Cholesky factors of k small matrices on the driver."""

    def __init__(self, n_components: int = 5, tol: float = 1e-4, eps: float = 1e-6, max_iter: int = 100, seed: int = 0, weights_init: list | None = None, means_init: list | None = None, precisions_init: list | None = None):
        given = [x is not None for x in (weights_init, means_init, precisions_init)]
        if any(given) and not all(given):
            raise ValueError("weights, means and precisions are given together")
        self.start = None
        if all(given):
            w, m, p = (np.asarray(x, float) for x in (weights_init, means_init, precisions_init))
            if w.shape != (n_components,) or (w < 0).any() or not np.isclose(w.sum(), 1):
                raise ValueError("weights must be n_components shares that sum to 1")
            if m.ndim != 2 or len(m) != n_components or p.shape != (n_components, m.shape[1], m.shape[1]):
                raise ValueError("means must be (k, d) and precisions (k, d, d)")
            if any(not np.allclose(x, x.T) or (np.linalg.eigvalsh(x) <= 0).any() for x in p):
                raise ValueError("precisions must be symmetric and positive definite")
            self.start = (w, m, np.linalg.inv(p))
        self.k, self.tol, self.eps, self.max_iter, self.seed = n_components, tol, eps, max_iter, seed
        self.params: tuple | None = None

    def _logs(self, points: DataFrame) -> DataFrame:
        weights, means_, covs = self.params
        rows = []
        for k in range(self.k):
            low = np.linalg.cholesky(covs[k])
            inv = np.linalg.inv(low)
            const = float(np.log(weights[k]) - np.log(np.diag(low)).sum() - 0.5 * len(means_[k]) * np.log(2 * np.pi))
            rows.append((k, [float(x) for x in means_[k]], [[float(x) for x in r] for r in inv], const))
        params = points.sparkSession.createDataFrame(rows, "k int, mu array<double>, inv array<array<double>>, const double")
        d = vector.subtract(F.col("v"), F.col("mu"))
        return points.join(F.broadcast(params)).withColumn("_d", d).select("id", "k", (F.col("const") - 0.5 * vector.total(F.transform("inv", lambda r: F.pow(vector.dot(r, F.col("_d")), 2)))).alias("lp"))

    def fit(self, points: DataFrame) -> GaussianMixture:
        if self.start is not None:
            self.params = self.start
            resp = responsibilities(self._logs(points))
        else:
            start = KMeans(self.k, "random", 1, 10, seed=self.seed).fit(points)
            resp = start.predict(points).select("id", F.col("label").alias("k"), F.lit(1.0).alias("resp"))
        before = None
        for _ in range(self.max_iter):
            found = weighted_parameters(points, resp, self.eps)
            dim = len(next(iter(found.values()))[1])
            mu, sigma = np.zeros((self.k, dim)), np.tile(np.eye(dim) * self.eps, (self.k, 1, 1))
            for k, (_, m, c) in found.items():
                mu[k], sigma[k] = m, c
            total = sum(n for n, _, _ in found.values())
            self.params = (np.array([found[k][0] / total if k in found else 1e-15 for k in range(self.k)]), mu, sigma)
            resp = responsibilities(self._logs(points))
            bound = resp.where("k = 0").agg(F.avg("total")).first()[0]
            self.lower_bound = bound
            if before is not None and abs(bound - before) < self.tol:
                break
            before = bound
        return self

    def predict_prob(self, points: DataFrame) -> DataFrame:
        if self.params is None:
            raise ValueError("not fitted")
        return responsibilities(self._logs(points))

    def predict(self, points: DataFrame) -> DataFrame:
        return self.predict_prob(points).groupBy("id").agg(F.max_by("k", F.struct("resp", -F.col("k"))).alias("label"))

    def score(self, points: DataFrame) -> float:
        return self.predict_prob(points).where("k = 0").agg(F.avg("total")).first()[0]
