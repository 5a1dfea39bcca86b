"""Vocabulary tables, embeddings, edge features and link prediction."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vector
from graphloom.functions.rand import uniform
from graphloom.operators import graph as G
from graphloom.operators.joins import both_ends
from graphloom.operators.prefix import running


def tokens(docs: DataFrame, key: str, text: str, pattern: str = "[^a-z]+") -> DataFrame:
    """key, pos, token: lower-case runs of letters."""
    words = F.filter(F.split(F.lower(F.col(text)), pattern), lambda w: w != "")
    return docs.select(F.col(key), F.posexplode(words).alias("pos", "token"))


def counts(token_rows: DataFrame, least: int = 1) -> DataFrame:
    """token, cnt."""
    return token_rows.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= least)


def vocabulary(token_counts: DataFrame) -> DataFrame:
    """Adds idx, by count descending then token: ranks inside buckets of one count and two first letters, after those before."""
    rows = running(token_counts, [], {"_c": -F.col("cnt"), "_t": F.substring("token", 1, 2)}, [F.col("_c"), F.col("_t")], [F.col("token")], {"idx": F.lit(1).cast("long")})
    return rows.select(*token_counts.columns, (F.col("idx") - 1).alias("idx"))


def sampling(vocab: DataFrame, sample: float = 1e-3) -> DataFrame:
    """Adds keep_prob: (sqrt(v / t) + 1) * t / v, at most 1; t is sample * total, or int(sample * (3 + sqrt 5) / 2) from 1 on."""
    if sample >= 1:
        t = F.lit(float(int(sample * (3 + 5**0.5) / 2)))
        rows = vocab
    else:
        rows = vocab.join(F.broadcast(vocab.agg(F.sum("cnt").alias("_total"))))
        t = F.col("_total") * F.lit(sample)
    v = F.col("cnt").cast("double")
    return rows.withColumn("keep_prob", F.least(F.lit(1.0), (F.sqrt(v / t) + 1) * (t / v))).drop("_total")


def kept(token_rows: DataFrame, probabilities: DataFrame, seed: int, key: str = "sentence") -> DataFrame:
    """Tokens that survive frequent-word sub-sampling, by a hash of seed, sentence and position."""
    return token_rows.join(probabilities.select("token", "keep_prob"), "token").where(uniform(seed, F.col(key), F.col("pos")) < F.col("keep_prob")).drop("keep_prob")


def noise_table(vocab: DataFrame, exponent: float = 0.75, domain: int = 2**31 - 1) -> DataFrame:
    """Adds cum: the running share of cnt ** exponent in order of idx, scaled to domain and rounded half to even."""
    p = F.pow(F.col("cnt").cast("double"), F.lit(exponent))
    rows = running(vocab, [], {"_block": F.floor(F.col("idx") / 65_536)}, [F.col("_block")], [F.col("idx")], {"_cum": p})
    total = vocab.agg(F.sum(p).alias("_total"))
    return rows.join(F.broadcast(total)).select(*vocab.columns, F.bround(F.col("_cum") / F.col("_total") * domain).cast("long").alias("cum"))


def huffman(vocab: DataFrame) -> list[tuple[str, str]]:
    """(token, code) on the driver: merges add counts, ties by idx. For vocabularies that fit there."""
    heap = [(r["cnt"], r["idx"], r["token"]) for r in vocab.select("cnt", "idx", "token").collect()]
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], fresh, (a[2], b[2])))
        fresh += 1
    out, stack = [], [(heap[0][2], "")] if heap else []
    while stack:
        node, code = stack.pop()
        if isinstance(node, tuple):
            stack += [(node[0], code + "0"), (node[1], code + "1")]
        else:
            out.append((node, code))
    return sorted(out)


#: Bytes of a word's entry, without and with a Huffman code, and of a weight: fixed values.
ENTRY, CODED_ENTRY, WEIGHT = 500, 700, 4


def model_bytes(words: Column, size: int, matrices: int, coded: bool = False) -> Column:
    """Bytes of a model's vocabulary and of so many matrices of `size` weights a word."""
    return words * ((CODED_ENTRY if coded else ENTRY) + matrices * size * WEIGHT)


def learning_rate(progress: Column, first: float = 0.025, least: float = 1e-4) -> Column:
    return F.greatest(F.lit(least), F.lit(first) - (first - least) * progress)


def initial_vectors(vocab: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """token, vec: uniform in (-1/2, 1/2) / size, by hash."""
    return vocab.select("token", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (uniform(seed, F.col("token"), i) - 0.5) / size).alias("vec"))


def word2vec(sentences: DataFrame, column: str = "tokens", size: int = 64, window: int = 5, min_count: int = 1, epochs: int = 1, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """token, vec by MLlib (skip-gram with hierarchical softmax), in as many partitions as the sentences have."""
    partitions = partitions or max(1, sentences.rdd.getNumPartitions())
    model = Word2Vec(inputCol=column, outputCol="_out", vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=partitions).fit(sentences)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vec"))


def upsert(store: DataFrame, new: DataFrame, key: str = "token") -> DataFrame:
    """The store with new rows in place of old ones of their key; of several new ones the last by `version`."""
    last = new.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))).where("_k = 1").drop("_k")
    return store.join(last.select(key), key, "left_anti").unionByName(last.select(*store.columns))


#: Vectors in a task of most_similar, and queries multiplied with them at once.
CHUNK, SLAB = 16_384, 256


def _nearest_of_chunk(n: int):  # noqa: ANN202
    """For queries (query, qv) and vectors (token, vec) of one block: each query's n best by cosine, and ties by token."""

    def sums(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Dot products of rows i and j, added in the order of the columns, as vector.dot has it."""
        out = np.zeros(len(i))
        for d in range(a.shape[1]):
            out += a[i, d] * b[j, d]
        return out

    def nearest(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": asked["query"][:0], "token": rows["token"][:0], "cosine": np.zeros(0)})]
        if len(asked) and len(rows):
            q, v = (np.stack(x.to_numpy()).astype(float) for x in (asked["qv"], rows["vec"]))
            asks, tokens = asked["query"].to_numpy(), rows["token"].to_numpy()
            place = np.unique(tokens, return_inverse=True)[1]
            ql, vl = (np.sqrt(sums(x, np.arange(len(x)), x, np.arange(len(x)))) for x in (q, v))
            for at in range(0, len(q), SLAB):
                near = (q[at : at + SLAB] / ql[at : at + SLAB, None]) @ (v / vl[:, None]).T
                near[asks[at : at + SLAB, None] == tokens[None, :]] = -np.inf
                least = np.partition(near, max(len(v) - n, 0), axis=1)[:, max(len(v) - n, 0)]
                # The product's rounding may swap what is close, so all of it is told apart by the exact sums.
                i, j = np.nonzero((near >= least[:, None] - 1e-9) & np.isfinite(near))
                cosine = sums(q, i + at, v, j) / (ql[i + at] * vl[j])
                order = np.lexsort((place[j], -cosine, i))
                i, j, cosine = i[order], j[order], cosine[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < n
                out.append(pd.DataFrame({"query": asks[i[first] + at], "token": tokens[j[first]], "cosine": cosine[first]}))
        return pd.concat(out)

    return nearest


def most_similar(queries: DataFrame, vectors: DataFrame, n: int, most: int = 10_000) -> DataFrame:
    """query, token, cosine, rank of a given set of queries against all vectors, by matrix products of blocks: queries in
    blocks of `most`, vectors of CHUNK. A vector without a length, or of another width, is compared by the plain expression.
    """
    asked = queries.select(F.col("token").alias("query"), F.col("vec").cast("array<double>").alias("qv"))
    found = vectors.select("token", F.col("vec").cast("array<double>").alias("vec"))
    count, size = asked.agg(F.count(F.lit(1)), F.max(F.size("qv"))).first()

    def sound(v: str) -> Column:
        return F.coalesce((F.size(v) == F.lit(size)) & vector.dot(F.col(v), F.col(v)).between(1e-200, 1e200), F.lit(False))

    blocks, chunks = max(-(-count // most), 1), max(-(-found.count() // CHUNK), 1)
    dealt = asked.where(sound("qv") & F.col("query").isNotNull()).withColumns({"_b": F.pmod(F.xxhash64("query"), F.lit(blocks)), "_c": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))})
    spread = found.where(sound("vec") & F.col("token").isNotNull()).withColumns({"_c": F.pmod(F.xxhash64("token", "vec"), F.lit(chunks)), "_b": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, token {found.schema['token'].dataType.simpleString()}, cosine double"
    rows = dealt.groupBy("_b", "_c").cogroup(spread.groupBy("_b", "_c")).applyInPandas(_nearest_of_chunk(n), kinds)

    def paired(a: DataFrame, b: DataFrame) -> DataFrame:
        if blocks == 1:
            return b.join(F.broadcast(a)).where("token <> query")
        return b.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(a.withColumn("_b", F.pmod(F.xxhash64("query"), F.lit(blocks))), "_b").where("token <> query")

    odd = paired(asked.where(~sound("qv")), found).unionByName(paired(asked.where(sound("qv")), found.where(~sound("vec"))))
    rows = rows.unionByName(odd.select("query", "token", vector.cosine(F.col("qv"), F.col("vec")).alias("cosine")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "token"))).where(F.col("rank") <= n)


def edge_features(edges: DataFrame, vectors: DataFrame, how: str = "hadamard") -> DataFrame:
    """src, dst, features."""
    return both_ends(edges, vectors).select("src", "dst", vector.EDGE_FEATURES[how](F.col("va"), F.col("vb")).alias("features"))


def walk_paths(edges: DataFrame, length: int = 10, walks: int = 5, policy: str = "random", seed: int = 0, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """walk, start, path: uniform (random), PageRank-weighted (pagerank) or second-order (node2vec) walks from every node."""
    starts, graph = G.nodes(edges), G.undirected(edges)
    if policy == "node2vec":
        return G.biased_walks(graph, starts, length, walks, p, q, seed)
    weights = G.pagerank(edges).select("node", F.col("rank").alias("weight")) if policy == "pagerank" else None
    return G.random_walks(G.symmetric(graph).select("src", "dst"), starts, length, walks, seed, weights)


def deepwalk(edges: DataFrame, size: int = 64, length: int = 10, walks: int = 5, policy: str = "random", epochs: int = 1, seed: int = 0, p: float = 1.0, q: float = 1.0, window: int = 5, alpha: float = 0.05) -> DataFrame:
    """id, v: vectors of all nodes, skip-grams with negative sampling over walks."""
    from graphloom.operators.word2vec import Word2Vec as Trained

    paths = walk_paths(edges, length, walks, policy, seed, p, q)
    rows = paths.select(F.xxhash64("walk", "start").alias("sentence"), F.posexplode("path").alias("pos", "node")).select("sentence", "pos", F.col("node").cast("string").alias("token"))
    model = Trained(size, alpha, window=window, min_count=1, sample=0, seed=seed, sg=True, epochs=epochs).fit(rows)
    return model.vectors.select(F.col("token").cast("long").alias("id"), F.col("vec").alias("v"))


class DeepWalk:
    """Vectors of nodes, clusters of the vectors, and a label for each node from a few labelled ones."""

    def __init__(self, clusters: int = 5, rounds: int = 15, **walk):  # noqa: ANN003
        self.clusters, self.rounds, self.walk, self.vectors = clusters, rounds, walk, None

    def fit(self, edges: DataFrame) -> DeepWalk:
        self.vectors = deepwalk(edges, **self.walk)
        return self

    def predict(self, truth: DataFrame, default: int = 0) -> DataFrame:
        """node, comm, label from truth (node, label): k-means over unit vectors, then each cluster's majority."""
        if self.vectors is None:
            raise ValueError("not fitted")
        from graphloom.operators.cluster import KMeans

        unit = self.vectors.select("id", F.transform("v", lambda x: x / F.greatest(F.sqrt(vector.dot(F.col("v"), F.col("v"))), F.lit(1e-12))).alias("v"))
        found = KMeans(self.clusters, n_init=1, max_iter=self.rounds, tol=1e-3, seed=self.walk.get("seed", 0)).fit(unit).predict(unit)
        return G.majority_labels(found.select(F.col("id").alias("node"), F.col("label").alias("comm")), truth, default)


def link_auc(edges: DataFrame, negative: DataFrame, layers: tuple[int, ...] = (64, 32), how: str = "hadamard", max_iter: int = 100, share: float = 0.75, seed: int = 0, **walk) -> DataFrame:  # noqa: ANN003
    """auc, n: walks and vectors from `share` of the edges, a classifier on their features and as much of the negative pairs, judged on the rest."""
    from graphloom.operators import metrics

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        u = uniform(seed, F.col("src"), F.col("dst"))
        return rows.where(u < share), rows.where(u >= share)

    (known, asked), (other, wrong) = split(edges.select("src", "dst")), split(negative.select("src", "dst"))
    vectors = deepwalk(known, seed=seed, **walk)
    model = LinkPredictor(layers, how, max_iter, seed).fit(known, other, vectors)
    judged = model.predict(asked).withColumn("label", F.lit(1).cast("long")).unionByName(model.predict(wrong).withColumn("label", F.lit(0).cast("long")))
    judged = G.written(judged.select("label", F.col("probability").alias("score")), "link-judged")
    return metrics.roc_auc(judged).join(judged.agg(F.count(F.lit(1)).alias("n"))).select("auc", "n")


class LinkPredictor:
    """Edge features of positive and negative edges into a multilayer perceptron."""

    def __init__(self, layers: tuple[int, ...] = (64, 32), how: str = "hadamard", max_iter: int = 20, seed: int = 0):
        self.layers, self.how, self.max_iter, self.seed, self.model = layers, how, max_iter, seed, None

    def fit(self, positive: DataFrame, negative: DataFrame, vectors: DataFrame) -> LinkPredictor:
        self.vectors = vectors
        rows = edge_features(positive, vectors, self.how).withColumn("label", F.lit(1.0)).unionByName(edge_features(negative, vectors, self.how).withColumn("label", F.lit(0.0)))
        rows = rows.withColumn("features", array_to_vector("features"))
        size = len(vectors.select("v").first()["v"])
        self.model = MultilayerPerceptronClassifier(layers=[size, *self.layers, 2], maxIter=self.max_iter, seed=self.seed).fit(rows)
        return self

    def predict(self, edges: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("not fitted")
        rows = edge_features(edges, self.vectors, self.how).withColumn("features", array_to_vector("features"))
        return self.model.transform(rows).select("src", "dst", vector_to_array("probability")[1].alias("probability"))


def project(points: DataFrame, dims: int = 2) -> DataFrame:
    """id, v: principal components of centred points (signs are arbitrary)."""
    from graphloom.operators.cluster import centered

    rows = centered(points).select("id", array_to_vector("v").alias("f"))
    return PCA(k=dims, inputCol="f", outputCol="o").fit(rows).transform(rows).select("id", vector_to_array("o").alias("v"))
