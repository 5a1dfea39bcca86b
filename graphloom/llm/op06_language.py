"""Language ID by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is cut, left to right, into the longest phrases that
occur in that text; phrases are normalised by the bits that name a place in the reference, a character:
phrases * log2(reference length) / text length. The language with the least wins.

The automata are flattened into one transition table in which a dead end already points at the next phrase's
first character and carries a flag, so many texts advance together, one gather a character. A long text advances as
windows side by side, each begun afresh; then every window is gone over again from the state that the one before it
truly ended in, until both walks meet, and its number of phrases is set right by what they differ in. So phrases are
those of the whole text, whatever the window.

References come from a sample of labelled rows with documented bounds: `DOCS` documents a language by hash of the id, whole,
as long as they have no more than `CHARS` characters together (longer documents are not drawn; if a language has no
other, its shortest is). Each worker builds the table from those.

Defined results: null text, or text without a letter, is `und` with score 0, and so is everything when nothing was
learned; case and runs of other characters don't matter; ties go to the smaller language name; rows repeat as they are;
columns of other names pass by.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, hash_limit, remainder, table, worker_cache

DOCS = 64
CHARS = 60_000
WINDOW = 1024
BATCH_CHARS = 1_000_000
UND = "und"


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by state; state 0 is the empty match."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in go[at]:
            go[at][c] = new
            at = link[at]
        if at >= 0:
            q = go[at][c]
            if length[q] == length[at] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[at] + 1)
                link.append(link[q])
                while at >= 0 and go[at].get(c) == q:
                    go[at][c] = copy
                    at = link[at]
                link[q] = link[new] = copy
        last = new
    return go


class Parser:
    """Counts phrases of many texts against all references at once."""

    def __init__(self, references: list[tuple[str, str]]):
        self.langs = [lang for lang, _ in references]
        letters = sorted({c for _, text in references for c in text.lower() if c.isalpha()})
        self.codes = {c: k + 2 for k, c in enumerate(letters)}  # 0: other characters, 1: letters that no reference has
        self.width = len(letters) + 3  # the last: padding, which moves nothing
        self.code_of = np.array([self.codes.get(c.lower(), 1) if (c := chr(k)).isalpha() else 0 for k in range(0x110000)], np.int32)
        cut = [self.cut(text) for _, text in references]
        self.bits = np.array([math.log2(len(x) + 1) if len(x) else 1.0 for x in cut])
        tables, self.start, base = [], [], 0
        for codes in cut:
            go = automaton(codes.tolist())
            t = np.full((len(go), self.width), -1, np.int64)
            for s, edges in enumerate(go):
                for c, to in edges.items():
                    t[s, c] = to
            first = np.where(t[0] >= 0, t[0], 0)
            dead = t < 0
            t = np.where(dead, first, t)
            dead[0] = True  # from the start, every character begins a phrase
            t[:, 1], dead[:, 1] = 0, True
            t[:, -1], dead[:, -1] = np.arange(len(go)), False
            tables.append(((t + base) * self.width << 1 | dead).ravel())
            self.start.append(base * self.width)
            base += len(go)
        kind = np.int32 if base * self.width < 2**30 else np.int64
        self.table = np.concatenate(tables).astype(kind) if tables else np.zeros(0, kind)

    def cut(self, text: str) -> np.ndarray:
        """Codes of a text, runs of other characters as one; surrogates can't occur in Arrow strings."""
        codes = self.code_of[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        if len(codes) > 1:
            codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        return codes

    def phrases(self, texts: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
        """(texts, languages) numbers of phrases."""
        lanes = np.array([-(-len(t) // window) for t in texts], np.int64)
        total, n = int(lanes.sum()), len(self.langs)
        out = np.zeros((len(texts), n), np.int64)
        if not total or not n:
            return out
        grid = np.full(total * window, self.width - 1, self.table.dtype)
        first = np.concatenate([[0], np.cumsum(lanes)[:-1]])
        for t, k in zip(texts, first.tolist(), strict=True):
            grid[k * window : k * window + len(t)] = t
        steps = min(window, max(map(len, texts)))
        columns = np.ascontiguousarray(grid.reshape(total, window)[:, :steps].T)
        entry = np.repeat(np.array(self.start, self.table.dtype), total).reshape(n, total)
        state = entry.copy()
        count = np.zeros((n, total), np.int64)
        for j in range(steps):
            state += columns[j]
            np.take(self.table, state, out=state, mode="clip")
            count += state & 1
            state >>= 1
        goes_on = np.ones(total, bool)
        goes_on[first[lanes > 0]] = False
        lang, lane = np.nonzero(np.broadcast_to(goes_on, (n, total)))
        while len(lane):  # windows whose entry was not where the one before ended
            old, new = entry[lang, lane], state[lang, lane - 1]
            differ = old != new
            lang, lane, old, new = lang[differ], lane[differ], old[differ], new[differ]
            entry[lang, lane] = new
            at_lang, at_lane = lang, lane
            for j in range(steps):
                if not len(at_lane):
                    break
                c = columns[j, at_lane]
                old, new = self.table[old + c], self.table[new + c]
                count[at_lang, at_lane] += (new & 1) - (old & 1)
                old, new = old >> 1, new >> 1
                apart = old != new
                old, new, at_lang, at_lane = old[apart], new[apart], at_lang[apart], at_lane[apart]
            state[at_lang, at_lane] = new  # those that haven't met by the end: the next window is gone over again
            more = at_lane + 1 < total
            lang, lane = at_lang[more], at_lane[more] + 1
            more = goes_on[lane]
            lang, lane = lang[more], lane[more]
        np.add.at(out, np.repeat(np.arange(len(texts)), lanes), count.T)
        return out

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, its phrases' bits a character) of each text."""
        out: list[tuple[str, float, float]] = [(UND, 0.0, 0.0)] * len(texts)
        held, codes, chars = [], [], 0

        def flush() -> None:
            cost = self.phrases(codes) * self.bits / np.array([max(1, len(c)) for c in codes])[:, None] if codes else []
            for k, row in zip(held, cost, strict=True):
                best = int(np.argmin(row))
                rest = np.delete(row, best)
                out[k] = (self.langs[best], float(rest.min() / (rest.min() + row[best])) if len(rest) else 1.0, float(row[best]))

        for k, text in enumerate(texts):
            c = self.cut(text) if text and self.langs else np.zeros(0, np.int32)
            if c.any():
                held.append(k)
                codes.append(c)
                chars += len(c)
                if chars > BATCH_CHARS:
                    flush()
                    held, codes, chars = [], [], 0
        flush()
        return out


def parser(references: list[tuple[str, str]]) -> Parser:
    """The references' parser, one a worker process."""
    return worker_cache("language", hashlib.sha256(repr(references).encode()).hexdigest(), lambda: Parser(references))


def references(docs: DataFrame, docs_per_lang: int = DOCS, chars: int = CHARS) -> list[tuple[str, str]]:
    """(language, text) pairs, by language, from docs (doc_id, text, lang): whole documents, `chars` characters together at most."""
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("_n", F.length("text"))
    # A row a language.
    counts = {r["lang"]: r for r in known.groupBy("lang").agg(F.sum((F.col("_n") <= chars).cast("long")).alias("n"), F.min("_n").alias("least")).collect()}
    if not counts:
        return []
    # Only ids whose hash is small enough to be among the first take part in the ranking, so it is as small as the sample.
    known = known.select("lang", "_n", F.xxhash64("doc_id").alias("_h"), "text")
    limit = F.create_map(*(F.lit(x) for lang, r in counts.items() for x in (lang, hash_limit(8 * docs_per_lang, r["n"]))))
    longest = F.create_map(*(F.lit(x) for lang, r in counts.items() for x in (lang, max(chars, r["least"]))))
    known = known.where((F.col("_h") <= F.try_element_at(limit, F.col("lang"))) & (F.col("_n") <= F.try_element_at(longest, F.col("lang"))))
    order = Window.partitionBy("lang").orderBy("_h", "_n", "text")
    first = known.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= docs_per_lang)
    first = first.withColumn("_sum", F.sum("_n").over(Window.partitionBy("lang").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where((F.col("_k") == 1) | (F.col("_sum") <= chars))
    found: dict[str, list[str]] = {}
    for r in sorted(first.select("lang", "_k", "text").collect(), key=lambda r: (r["lang"], r["_k"])):
        found.setdefault(r["lang"], []).append(r["text"])
    return [(lang, "\n".join(texts)) for lang, texts in found.items()]


def predict(docs: DataFrame, refs: list[tuple[str, str]], columns: list[str], text: str = "text") -> DataFrame:
    """columns, lang_pred, score, bits (of the language's phrases, a character) from docs (columns and text, which may be one of them)."""
    at = columns.index(text) if text in columns else len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(refs)
        for b in batches:
            out = p.judge(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array([x[0] for x in out], pa.string()), *(pa.array([x[k] for x in out], pa.float64()) for k in (1, 2))], [*b.schema.names[: len(columns)], "lang_pred", "score", "bits"])

    bounded_batches(docs.sparkSession)
    kept = docs.select(*columns, *([] if at < len(columns) else [F.col(text).alias("_text_to_judge")]))
    schema = kept.select(*columns).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits": F.lit(0.0)}).schema
    return kept.mapInArrow(run, schema)


def learn(docs: DataFrame) -> list[tuple[str, str]]:
    return references(docs.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0), learn(docs), ["doc_id", "held_out"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "lang_pred", "score", "bits")
