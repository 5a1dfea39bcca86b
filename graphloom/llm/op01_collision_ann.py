"""Approximate nearest neighbours by query-aware collision counting.

Every block of vectors keeps `PROJECTIONS` arrays, each sorted by one random projection. A query opens a window around
its own projection in each array; for radius R the windows are `T` * R wide to either side, so a vector within R falls
into one with probability p = 2 Phi(T) - 1 at least. Vectors whose number of collisions reaches m p - Z sqrt(m p (1-p))
are verified by their exact distance. Virtual rehashing widens the windows, R by R, counting only what is new, until the
k-th best verified distance is within R: then each true neighbour was counted with probability Phi(Z) or more. No
number of candidates is capped.

Blocks of bounded size are dealt once. In a first pass each query is searched so in one block, its home; the k-th best distance
found there bounds what any other block can add. In a second pass every other block takes the queries, streamed from the
shared folder, and opens its windows at that bound at once. Neither vectors nor queries are copied to pairs of blocks;
memory is a block's index and a batch of queries. On embeddings without low-dimensional structure the windows of a true
neighbour's radius cover most of every array, so no dealing of the arrays by range would spare a query a block; `verified`
tells how many vectors' exact distances a query cost.

Equal vectors are one entry of the index that carries its k + 1 smallest ids (no more can be in a result), so one vector on a
third of all rows is one entry, and equal queries are searched once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, as candidates and as
queries; so do rows without an id; vectors are compared with those of their own length; repeated rows (equal id and
vector) count once; ties go to the smaller id; fewer than k candidates are all returned; columns of other names are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import fresh_path, materialize, table

K = 10
PROJECTIONS = 320
T = 1.5
Z = 1.1
GROWTH = 1.02
BLOCK = 16_384
QUERY_BATCH = 2048
SEED = 11


class CollisionIndex:
    """Sorted projections of a block of vectors."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.vectors = vectors
        n, d = vectors.shape
        self.axes = np.random.default_rng([seed, d]).standard_normal((d, projections))
        values = vectors @ self.axes
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)  # (projections, n)
        values = np.take_along_axis(values.T, self.order, axis=1)
        self.offset = np.arange(projections) * (4 * (np.abs(values).max() + 1))  # lays the arrays end to end, in order
        self.values = (values + self.offset[:, None]).ravel()
        self.flat, self.n = self.order.ravel(), n
        self.first, self.last = np.arange(projections) * n, (np.arange(projections) + 1) * n
        p = math.erf(T / math.sqrt(2))
        self.threshold = max(1, math.ceil(projections * p - Z * math.sqrt(projections * p * (1 - p))))

    def _counts(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Collisions of each vector in the windows [low, high); counted inside or outside, whichever is less."""
        if (high - low).sum() * 2 > self.flat.size:
            return len(low) - self._count([(a, b) for a, b in zip(self.first.tolist(), low.tolist(), strict=True)] + [(a, b) for a, b in zip(high.tolist(), self.last.tolist(), strict=True)])
        return self._count(list(zip(low.tolist(), high.tolist(), strict=True)))

    def _count(self, windows: list[tuple[int, int]]) -> np.ndarray:
        parts = [self.flat[a:b] for a, b in windows if a < b]
        return np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)

    def _windows(self, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the windows in the arrays laid end to end, each within its own array."""
        low = np.clip(np.searchsorted(self.values, at - T * radius), self.first, self.last)
        return low, np.clip(np.searchsorted(self.values, at + T * radius, "right"), low, self.last)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, distances, number verified) by virtual rehashing: nearest first, at least the k nearest found."""
        at = query @ self.axes + self.offset
        distance = np.full(self.n, np.inf)
        some = self.exact(query, np.arange(0, self.n, max(1, self.n // 64)))  # sets only where the radius starts
        radius = max(float(some.min()) * 0.8, float(some.max()) * 1e-3, 1e-12)
        low, high = self._windows(at, radius)
        counts = self._counts(low, high)
        while True:
            fresh = np.flatnonzero((counts >= self.threshold) & np.isinf(distance))
            distance[fresh] = self.exact(query, fresh)
            found = np.flatnonzero(np.isfinite(distance))
            if len(found) == self.n or (len(found) >= k and np.partition(distance[found], k - 1)[k - 1] <= radius):
                break
            radius *= GROWTH
            wider = self._windows(at, radius)
            counts += self._count([(a, b) for a, b in zip(wider[0].tolist(), low.tolist(), strict=True)] + [(a, b) for a, b in zip(high.tolist(), wider[1].tolist(), strict=True)])
            low, high = wider
        found = found[np.argsort(distance[found], kind="stable")]
        return found, distance[found], len(found)

    def within(self, query: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, distances, number verified) of vectors within a radius, nearest first."""
        tried = np.flatnonzero(self._counts(*self._windows(query @ self.axes + self.offset, radius)) >= self.threshold)
        distance = self.exact(query, tried)
        order = np.argsort(distance, kind="stable")
        order = order[distance[order] <= radius]
        return tried[order], distance[order], len(tried)

    def exact(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        diff = self.vectors[places] - query
        return np.sqrt((diff * diff).sum(axis=1))


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>), key (of equal vectors), dim: the rows that take part, once each."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(True)) & F.exists("v", lambda x: x != 0))
    return rows.withColumns({"key": F.md5(F.col("v").cast("string").cast("binary")), "dim": F.size("v")}).dropDuplicates(["vec_id", "key"])


def _best(index: CollisionIndex, listed: list, found: tuple[np.ndarray, np.ndarray, int], k: int) -> list[tuple[float, int]]:
    """The k + 1 nearest (distance, id) of an index's answer, ties by id."""
    places, distances, _ = found
    if not len(places):
        return []
    near = distances <= distances[min(k, len(places) - 1)]  # with all that are as far
    return sorted((float(s), int(i)) for place, s in zip(places[near], distances[near], strict=True) for i in listed[place])[: k + 1]


FOUND = "key string, verified long, best array<struct<score double, vec_id long>>"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score, verified from two results of valid(); a query's own id is no candidate."""
    spark = vectors.sparkSession
    firsts = vectors.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("_k") <= k + 1)
    entries = materialize(firsts.groupBy("key").agg(F.first("v").alias("v"), F.first("dim").alias("dim"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-entries")
    asked = materialize(queries.select("vec_id", "key", "v", "dim"), "ann-queries")
    blocks = max(1, -(-entries.count() // block))
    entries = entries.withColumn("b", F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(blocks)).cast("int"))
    once = asked.groupBy("key").agg(F.first("v").alias("v"), F.first("dim").alias("dim")).withColumn("b", F.pmod(F.xxhash64("key", F.lit(SEED + 1)), F.lit(blocks)).cast("int"))

    def at_home(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(asking):
            own = own.sort_values("key")
            index, listed = CollisionIndex(np.stack(own["v"].to_list())), own["ids"].to_list()
            for key, v in zip(asking["key"], asking["v"], strict=True):
                answer = index.search(np.asarray(v), min(k + 1, index.n))
                rows.append((key, answer[2], [{"score": s, "vec_id": i} for s, i in _best(index, listed, answer, k)]))
        return pd.DataFrame(rows, columns=["key", "verified", "best"])

    home = materialize(entries.groupBy("dim", "b").cogroup(once.groupBy("dim", "b")).applyInPandas(at_home, FOUND), "ann-home")
    found = home
    if blocks > 1:
        bound = home.select("key", F.when(F.size("best") > k, F.element_at("best", -1)["score"]).alias("bound"))
        path = fresh_path(spark, "ann-bounds")
        once.join(bound, "key", "left").select("key", "v", "dim", "b", "bound").write.parquet(path)
        files = [re.sub(r"^file:/(?!/)", "file:///", f) for f in spark.read.parquet(path).inputFiles()]

        def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = None, []
            for batch in batches:
                for dim, b, key, v, ids in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    if (dim, b) != held:
                        if rows:
                            yield from answers(held, rows)
                        held, rows = (dim, b), []
                    rows.append((key, v, ids))
            if rows:
                yield from answers(held, rows)

        def answers(held: tuple[int, int], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows.sort(key=lambda r: r[0])
            index, listed = CollisionIndex(np.array([r[1] for r in rows], float)), [r[2] for r in rows]
            rows.clear()
            kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))]
            for file in files:
                fs, at = pyarrow.fs.FileSystem.from_uri(file)
                with fs.open_input_file(at) as source:
                    for batch in pyarrow.parquet.ParquetFile(source).iter_batches(QUERY_BATCH):
                        out = []
                        for key, v, dim, b, bound_ in zip(*(batch.column(c).to_pylist() for c in ("key", "v", "dim", "b", "bound")), strict=True):
                            if dim == held[0] and b != held[1]:
                                answer = index.search(np.asarray(v), min(k + 1, index.n)) if bound_ is None else index.within(np.asarray(v), bound_)
                                out.append((key, answer[2], [{"score": s, "vec_id": i} for s, i in _best(index, listed, answer, k)]))
                        columns = list(zip(*out, strict=True)) or [()] * 3
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["key", "verified", "best"])

        dealt = entries.select("dim", "b", "key", "v", "ids").repartitionByRange(blocks, "dim", "b").sortWithinPartitions("dim", "b")
        found = materialize(home.unionByName(dealt.mapInArrow(elsewhere, FOUND)), "ann-found")
    cost = found.groupBy("key").agg(F.sum("verified").alias("verified"))
    hits = found.select("key", F.explode("best").alias("hit")).select("key", "hit.score", "hit.vec_id")
    order = Window.partitionBy("key").orderBy("score", "vec_id")
    best = hits.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k + 1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    out = asked.select(F.col("vec_id").alias("query_id"), "key").join(best, "key").join(cost, "key")
    out = out.select("query_id", "verified", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return out.select("query_id", "verified", F.posexplode("best").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"), "verified")


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where(F.pmod("vec_id", F.lit(100)) == 0))
