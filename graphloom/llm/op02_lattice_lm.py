"""LM scoring by subword lattice likelihood.

A word is a path through a lattice whose edges are the pieces of an existing subword vocabulary, with the weights that its
own scores give them. Its lattice probability sums over all paths, by a forward recursion in log space:

    M(w) = sum over segmentations of the product of piece probabilities

Pieces carry the word start, so M sums to 1 over words. `lattice_score` is the log10 of the product of M over a text's words:
nothing in it is learned. The weights are fixed: a unigram vocabulary's scores are log-probabilities and are taken as they are (normalised);
those of a BPE vocabulary are ranks, minus 0, 1, 2, ..., and rank r weighs 1 / (r + 1) (Zipf's law), normalised over all pieces.

`score` is a model of the training documents with the lattice beneath it, by absolute discounting:

    P(w) = max(c(w) - d, 0) / N  +  d V / N * M(w)

c, N, V: counts, tokens and distinct words of the training documents; d: discount from words seen once and twice. P sums
to 1 over words and the end token.

Scale: counts are summed in the workers before they are shuffled. Words that are at least one in `FREQUENT` tokens (so
there are no more than that, whatever the corpus) go to all workers, with the end token, and cover most tokens where the text
is read; where that limit lies doesn't change a result. The other words of a batch of documents travel packed, by
bucket of the word, to where the bucket's counts are, and come back as one sum a document and bucket. No other
table is broadcast; frequent words never meet in one task. Documents are told apart by Spark's row numbers, which a
retried task gives again as long as its rows come in the same order: those of a scan do, other input is written first.

Defined results: null or empty text is the end token alone (lattice_score 0); repeated rows and null ids are scored row by row;
very long words take a lattice of their length; columns of other names pass by; without training rows, N = V = 0, words have
P = M and the end token has probability 1/2.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, bounded_batches, materialize, remainder, table, tokenizer_file, worker_cache

FREQUENT = 500_000
WORDS_PER_BUCKET = 100_000
TOKENS_PER_BUCKET = 1_000_000
FLUSH = 300_000
PACK_WORDS = 1_000_000
LN10 = math.log(10)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces, log weights), fixed: a leading space marks a word's start; bytes the vocabulary lacks get its least weight."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scored: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
            continue
        piece = model.id_to_piece(k).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            scored[piece] = max(scored.get(piece, -math.inf), model.get_score(k))
    return weigh(scored)


def weigh(scored: dict[bytes, float]) -> tuple[list[bytes], np.ndarray]:
    """Sorted pieces and normalised log weights of a vocabulary's scores: whole numbers are ranks, others log-probabilities."""
    ranks = all(x == int(x) for x in scored.values())
    order = sorted(scored, key=lambda p: (-scored[p], p))
    weight = {p: 1 / (r + 1) if ranks else math.exp(scored[p]) for r, p in enumerate(order)}
    least = min(weight.values(), default=1.0)
    for b in range(256):
        weight.setdefault(bytes([b]), least)
    pieces = sorted(weight)
    w = np.array([weight[p] for p in pieces])
    return pieces, np.log(w / w.sum())


class Lattice:
    """Marginal log-probabilities of words over all segmentations."""

    def __init__(self, pieces: list[bytes], logs: list[float]):
        self.finder = ahocorasick.Automaton()
        for p, w in zip(pieces, logs, strict=True):
            self.finder.add_word(p.decode("latin-1"), (len(p), w))
        self.finder.make_automaton()

    def forward(self, word: bytes) -> list[float]:
        """Log mass of each prefix of the marked word."""
        text = " " + word.decode("latin-1")
        mass, at, terms = [-math.inf] * (len(text) + 1), 0, [0.0]
        for end, (n, w) in self.finder.iter(text):
            end += 1
            if end != at:
                top = max(terms) if terms else -math.inf
                mass[at] = top if len(terms) < 2 else top + math.log(sum([math.exp(x - top) for x in terms]))
                at, terms = end, []
            if mass[end - n] != -math.inf:
                terms.append(mass[end - n] + w)
        top = max(terms) if terms else -math.inf
        mass[at] = top if len(terms) < 2 else top + math.log(sum([math.exp(x - top) for x in terms]))
        return mass

    def log_marginal(self, word: bytes) -> float:
        return self.forward(word)[-1]


def lattice(pieces: list[bytes], logs: list[float]) -> Lattice:
    """One a worker process and set of weights."""
    return worker_cache("lattice", zlib.crc32(np.array(logs).tobytes(), len(pieces)), lambda: Lattice(pieces, logs))


def count_words(texts: DataFrame) -> DataFrame:
    """word, c over (text); the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for b in batches:
            for text in as_bytes(b.column(0)):
                counts.update(words_of(text))
                counts[b""] += 1
                if len(counts) > FLUSH:
                    yield flushed()
        yield flushed()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, vocabulary: str, frequent: int = FREQUENT, words_per_bucket: int = WORDS_PER_BUCKET) -> DataFrame:
    """The contract's columns and lattice_score from docs (doc_id, text, held_out); training rows are those not held out."""
    bounded_batches(docs.sparkSession)
    words = materialize(count_words(docs.where(~F.col("held_out"))), "lm-words")
    total, kinds, once, twice, ends = words.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("c"), F.count("c"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long")), F.sum(F.when(F.col("word") == F.lit(b""), F.col("c")))))).first()
    discount = once / (once + 2 * twice) if once else 0.5
    pieces, logs = read_pieces(vocabulary)
    weights = logs.tolist()
    spare = math.log(discount * (kinds - bool(ends)) / total) if total > ends else 0.0
    floor = math.log10(0.5 / (total + 0.5 * (kinds + 1)))

    def word_scores(model: Lattice, word: bytes, c: int) -> tuple[float, float, float]:
        """(base, model, lattice) log10 probabilities of a token."""
        base = math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) if c else floor
        if not word:
            return base, math.log10(c / total) if c else math.log10(0.5), 0.0
        marginal = model.log_marginal(word)
        rest, own = spare + marginal, c - discount
        if c and own > 0:
            own = math.log(own / total)
            rest = max(own, rest) + math.log1p(math.exp(-abs(own - rest)))
        return base, rest / LN10, marginal / LN10

    # Shares of 1 / frequent at least: so many rows at most. The end token is always among them.
    common = words.where((F.col("c") * frequent >= total) & (F.col("word") != F.lit(b""))).toArrow()
    rest_tokens = total - sum(common["c"].to_pylist()) - ends
    buckets = max(8, -(-kinds // words_per_bucket), -(-rest_tokens // TOKENS_PER_BUCKET))
    own = Lattice(pieces, weights)
    known_words = {w: (*word_scores(own, w, c), int(c > 0)) for w, c in [(b"", ends), *zip(map(bytes, common["word"].to_pylist()), common["c"].to_pylist(), strict=True)]}
    shared = docs.sparkSession.sparkContext.broadcast(known_words)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, turn = shared.value.get, 0
        none = [b"", b"", b"", b""]
        refs: list[list[int]] = [[] for _ in range(buckets)]
        tfs: list[list[int]] = [[] for _ in range(buckets)]
        rest: list[list[bytes]] = [[] for _ in range(buckets)]
        uids, done, held = [], [], 0

        def flushed() -> pa.RecordBatch:
            nonlocal held, turn
            rows = [[k, np.array(uids, np.int64).tobytes(), np.array(refs[k], np.int32).tobytes(), np.array(tfs[k], np.int32).tobytes(), b" ".join(rest[k]), None] for k in range(buckets) if rest[k]]
            rows.append([turn % buckets, *none, [tuple(x) for x in done]])
            for lists in (refs, tfs, rest):
                for x in lists:
                    x.clear()
            uids.clear()
            done.clear()
            held, turn = 0, turn + 1
            kinds_ = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), DONE]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_, strict=True)], ["bucket", "uids", "refs", "tfs", "words", "done"])

        for b in batches:
            for uid, doc_id, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), as_bytes(b.column(3)), strict=True):
                tokens = words_of(text)
                counts = Counter(tokens)
                counts[b""] = 1
                base = lp = lattice_lp = 0.0
                known, ref = 0, len(uids)
                for w, n in counts.items():
                    found = get(w)
                    if found:
                        base += n * found[0]
                        lp += n * found[1]
                        lattice_lp += n * found[2]
                        known += n * found[3]
                    else:
                        k = zlib.crc32(w) % buckets
                        refs[k].append(ref)
                        tfs[k].append(n)
                        rest[k].append(w)
                        held += 1
                uids.append(uid)
                done.append((uid, doc_id, out, len(tokens) + 1, known, base, lp, lattice_lp))
                if held > PACK_WORDS:
                    yield flushed()
        if uids:
            yield flushed()

    def gather(packed: pa.Table, counted: pa.Table) -> pa.Table:
        model = lattice(pieces, weights)
        slots = {w: k for k, w in enumerate(counted["word"].to_pylist())}
        counts = counted["c"].to_pylist()
        taken = []
        for uids, refs, tfs, text in zip(*(packed[c].to_pylist() for c in ("uids", "refs", "tfs", "words")), strict=True):
            if text:
                here = text.split(b" ")
                taken.append((np.frombuffer(uids, np.int64), np.frombuffer(refs, np.int32), np.frombuffer(tfs, np.int32), np.fromiter((slots.setdefault(w, len(slots)) for w in here), np.int64, len(here))))
        used = np.zeros(len(slots), bool)
        for *_, at in taken:
            used[at] = True
        values, seen = np.zeros((len(slots), 3)), np.zeros(len(slots), np.int64)
        seen[: len(counts)] = counts
        for k, w in enumerate(slots):
            if used[k]:
                values[k] = word_scores(model, w, int(seen[k]))
        columns: list[list] = [[], [], [], [], []]
        for uids, refs, tfs, at in taken:
            some = np.unique(refs)
            for c, x in zip(columns[1:], (np.where(seen[at] > 0, tfs, 0), *(tfs * values[at, k] for k in range(3))), strict=True):
                c.append(np.bincount(refs, x, len(uids))[some])
            columns[0].append(uids[some])
        uid, known, base, lp, lattice_lp = (np.concatenate(c) if c else np.zeros(0) for c in columns)
        done = [x for d in packed["done"].to_pylist() if d for x in d]
        n = len(uid)
        return pa.table({
            "uid": pa.array([*(x["uid"] for x in done), *uid.astype(np.int64).tolist()], pa.int64()),
            "main": pa.array([True] * len(done) + [False] * n, pa.bool_()),
            "doc_id": pa.array([x["doc_id"] for x in done] + [None] * n, pa.int64()),
            "held_out": pa.array([x["held_out"] for x in done] + [None] * n, pa.bool_()),
            "n_tokens": pa.array([x["n_tokens"] for x in done] + [0] * n, pa.int64()),
            "n_known": pa.array([*(x["n_known"] for x in done), *known.astype(np.int64).tolist()], pa.int64()),
            "base": pa.array([*(x["base"] for x in done), *base.tolist()], pa.float64()),
            "lp": pa.array([*(x["lp"] for x in done), *lp.tolist()], pa.float64()),
            "lattice": pa.array([*(x["lattice"] for x in done), *lattice_lp.tolist()], pa.float64()),
        })

    inner = "uid: bigint, doc_id: bigint, held_out: boolean, n_tokens: bigint, n_known: bigint, base: double, lp: double, lattice: double"
    packed = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(pack, f"bucket int, uids binary, refs binary, tfs binary, words binary, done array<struct<{inner}>>")
    by = words.where(F.col("word") != F.lit(b"")).select(F.pmod(F.crc32("word"), F.lit(buckets)).cast("int").alias("bucket"), "word", "c")
    parts = packed.groupBy("bucket").cogroup(by.groupBy("bucket")).applyInArrow(gather, "uid long, main boolean, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lp double, lattice double")
    out = parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lp").alias("score"), F.sum("lattice").alias("lattice_score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", "lattice_score")


DONE = pa.list_(pa.struct([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64()), ("lattice", pa.float64())]))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"))
    return score(docs, tokenizer_file("piece_bpe_32k.model"))
