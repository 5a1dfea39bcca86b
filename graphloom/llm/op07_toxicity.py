"""Toxicity by two class-conditional Kneser-Ney models.

Toxic and ordinary documents each have a model of words. Counts are Kneser-Ney's: in how many different contexts (words before)
a class has a word, so copies of a document teach nothing new. Each class discounts its counts absolutely, by words seen once and twice,
and backs off to counts that both share, which are Kneser-Ney's once more: a word's contexts there are the classes that
have it. The backoff weight is one for both classes (the larger of the two), so an expression that neither class has says
nothing and a rare one weighs what its few contexts are worth beside the discount. No count is left out.

    p(w | class) = max(c(class, w) - d(class), 0) / n(class) + B * shared(w)

Both models score every word. A text's features are the log-likelihood ratio a word, normalised by length, over the whole
text and over its worst window of each of `WINDOWS` words, so that a long text isn't acquitted by its length. A logistic
calibration turns them into a probability; it is fitted on a part of the sample whose words the models haven't counted.
A further level of word pairs was tried and finds less (README).

Bounds, all parameters: `PER_CLASS` labelled documents a class, by hash of the id, whole and as long as they have no more
than `CLASS_WORDS` words together; every `CALIBRATE`-th is kept for calibration. What workers get is bounded by the
sample's words. Nothing else of the corpus is gathered, and whole texts are scored, however long.

Defined results: null or empty text scores what the calibration gives for features of 0; a document with several labels
counts as toxic if one says so, one with several texts counts with the smallest; rows repeat as they are; columns of other
names pass by; without labels of both classes every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, as_bytes, bounded_batches, hash_limit, materialize, remainder, table, worker_cache

PER_CLASS = 4000
CLASS_WORDS = 2_000_000
CALIBRATE = 4
WINDOWS = (1, 8, 32)
RIDGE = 1e-3
THRESHOLD = 0.3
FLUSH = 300_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def sample_ids(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, toxic, part of at most per_class documents a class; part 0 is for calibration."""
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = dict(one.groupBy("toxic").count().collect())  # two rows
    # Only ids whose hash is small enough to be among the first are ranked, so the ranking is as small as the sample.
    one = one.withColumn("_h", F.xxhash64("doc_id", F.lit(7)))
    one = one.where(F.col("_h") <= F.when(F.col("toxic") == 1, hash_limit(2 * per_class, counts.get(1, 0))).otherwise(hash_limit(2 * per_class, counts.get(0, 0))))
    order = Window.partitionBy("toxic").orderBy("_h", "doc_id")
    return one.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_class).select("doc_id", "toxic", F.pmod("_k", F.lit(CALIBRATE)).alias("part"))


def whole_texts(docs: DataFrame, ids: DataFrame, class_words: int = CLASS_WORDS) -> DataFrame:
    """doc_id, text, toxic, part of the sampled documents, in order of their hash while a class has no more than class_words words."""
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text"))
    sample = materialize(sample.withColumn("_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")), "toxic-texts")
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = sample.select("doc_id", "toxic", F.sum("_words").over(order).alias("_sum")).where(F.col("_sum") <= class_words).select("doc_id")
    return sample.join(F.broadcast(within), "doc_id", "left_semi").drop("_words")


def context_counts(sample: DataFrame) -> DataFrame:
    """word, toxic, ordinary: after how many different words a class has a word; a text begins with the empty word.

    Contexts, not occurrences, as Kneser-Ney counts: copies of one document have one context, so groups of copies that
    happen to share a label don't teach their own words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[set, set] = (set(), set())

        def flushed() -> pa.RecordBatch:
            keys = list(seen[0] | seen[1])
            columns = [pa.array([xxhash.xxh3_64_intdigest(k[0]) - 2**63 for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), *(pa.array([k in seen[t] for k in keys], pa.bool_()) for t in (1, 0))]
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_arrays(columns, ["first", "word", "toxic", "ordinary"])

        for b in batches:
            for text, toxic in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                w = [b"", *words_of(text)]
                seen[toxic].update(zip(w, w[1:], strict=False))
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield flushed()
        yield flushed()

    parts = sample.select("text", "toxic").mapInArrow(run, "first long, word binary, toxic boolean, ordinary boolean")
    pairs = parts.groupBy("first", "word").agg(F.max("toxic").cast("long").alias("toxic"), F.max("ordinary").cast("long").alias("ordinary"))
    return pairs.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def discount(counts: np.ndarray) -> float:
    """Absolute discount from the words seen in one and in two contexts."""
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return once / (once + 2 * twice) if once else 0.5


class Model:
    """Log-likelihood ratios by word; 0 for words that neither class has, which both take from the shared counts."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        """counts: (words, 2) contexts in toxic and ordinary documents."""
        self.ids = {w: k + 1 for k, w in enumerate(words)}
        c = np.vstack([np.zeros((1, 2)), counts])
        classes = np.count_nonzero(c, axis=1)
        shared = (classes + 0.5) / (classes.sum() + 0.5 * len(c))
        d, n = np.array([discount(c[:, k]) for k in range(2)]), np.maximum(c.sum(axis=0), 1)
        weight = (d * np.count_nonzero(c, axis=0) / n).max() or 1.0
        p = np.maximum(c - d, 0) / n + weight * shared[:, None]
        self.ratio = np.log(p[:, 0]) - np.log(p[:, 1])

    def features(self, texts: list[bytes | None], windows: tuple[int, ...] = WINDOWS) -> np.ndarray:
        """(texts, 1 + windows): mean log ratio a word, and that of the highest window of each size (the whole text, if it is shorter)."""
        get, zero = self.ids.get, 0
        lists = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in lists])
        out = np.zeros((len(texts), 1 + len(windows)))
        ids = np.fromiter((get(w, zero) for x in lists for w in x), np.int64, int(sizes.sum()))
        del lists
        sums = np.concatenate([[0], np.cumsum(self.ratio[ids])])
        ends = np.cumsum(sizes)
        for k, (a, z) in enumerate(zip(ends - sizes, ends, strict=True)):
            if z > a:
                s = sums[a : z + 1]
                out[k, 0] = (s[-1] - s[0]) / (z - a)
                for j, w in enumerate(windows):
                    w = min(w, z - a)
                    out[k, j + 1] = (s[w:] - s[:-w]).max() / w
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 100) -> np.ndarray:
    """Intercept and coefficients by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * len(x) * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Model | None, list[float]]:
    """Model and calibration from docs (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    ids = materialize(sample_ids(labels.select("doc_id", "toxic"), per_class), "toxic-ids")  # at most 2 * per_class rows of three numbers
    found = dict(labels.where("toxic is not null").groupBy((F.col("toxic") > 0).cast("int").alias("t")).count().collect())
    if len(found) < 2:
        return None, [float(bool(found.get(1)))]
    sample = materialize(whole_texts(docs, ids), "toxic-sample")
    counts = context_counts(sample.where("part > 0")).orderBy("word").toArrow()  # no more rows than the sample's words
    model = Model([bytes(w) for w in counts["word"].to_pylist()], np.column_stack([counts[c].to_numpy() for c in ("toxic", "ordinary")]).astype(float))
    shared = spark.sparkContext.broadcast(model)
    scored = features(sample.where("part = 0").select("text", "toxic", "doc_id").orderBy("doc_id"), shared, ["toxic"]).toPandas()
    y, share = scored["toxic"].to_numpy(float), found[1] / (found[0] + found[1])
    if len(set(y)) < 2:
        return None, [share]
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    return shared, [float(v) for v in logistic(np.array(scored["_f"].to_list()), y, weight)]


def features(docs: DataFrame, shared, columns: list[str], text: str = "text") -> DataFrame:  # noqa: ANN001
    """columns and _f (the features) from docs (columns and text, which may be one of them); shared: the broadcast model."""
    at = columns.index(text) if text in columns else len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        worker_cache("toxicity", 0, lambda: None)  # drops what other operators left
        for b in batches:
            texts = as_bytes(b.column(at))
            rows = [x for k in range(0, len(texts), 500) for x in model.features(texts[k : k + 500]).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(rows, pa.list_(pa.float64()))], [*b.schema.names[: len(columns)], "_f"])

    bounded_batches(docs.sparkSession)
    kept = docs.select(*columns, *([] if at < len(columns) else [F.col(text).alias("_text_to_score")]))
    schema = kept.select(*columns).withColumn("_f", F.lit(None).cast("array<double>")).schema
    return kept.mapInArrow(run, schema)


def score(docs: DataFrame, fitted: tuple, columns: list[str], text: str = "text") -> DataFrame:
    """columns, score, predicted; columns may hold text itself."""
    shared, w = fitted
    if shared is None:
        out = docs.select(*columns).withColumn("score", F.lit(w[0]))
    else:
        z = F.lit(w[0])
        for k, x in enumerate(w[1:]):
            z = z + F.lit(x) * F.get("_f", F.lit(k))
        out = features(docs, shared, columns, text).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))).drop("_f")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def learn(docs: DataFrame, labels: DataFrame) -> tuple:
    return fit(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", remainder(F.col("doc_id"), 4) == 2), fitted, ["doc_id", "held_out"]).select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", "predicted")
