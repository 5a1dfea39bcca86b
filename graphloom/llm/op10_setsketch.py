"""MinHash near-duplicates by SetSketch registers.

A document's set of two-word shingles becomes `REGISTERS` registers: register i holds floor(1 - log_b h) of the smallest of
its exponential hash values, truncated to 16 bits, so registers are exponentially spaced minima, merge by maximum and
agree with a probability near the sets' similarity. Four registers in a row are a band (64 bits, exact); documents
that share a band are candidates. At similarity 0.8 a link escapes all 32 bands with probability 5e-8.

1. Equal sets become one entry, so a group of exact copies is one row from here on.
2. Every band links its members to its smallest one. The similarity is estimated jointly by maximum likelihood from how
   many registers are larger, smaller and equal, given both sizes; what is estimated below `LEAST_ESTIMATE` goes, five standard
   deviations below 0.8, so a link is lost there with a probability of 3e-7. The rest is verified on full sets.
3. Links become components. Bands whose members are in one component are done; in the others, members outside the
   largest component are compared with all members in other components, in blocks of bounded size. A block tells by
   size which sets can be linked, estimates those by their registers and verifies what is likely on full sets, likeliest
   first; it gives one link for each two components that it joins, so no more than it has members. So links between any two members of a band are found, yet pairs inside a component, the bulk
   of a large group of copies, are never made.

Shingles are known by 64-bit hashes; two different ones share a hash with a probability of 1e-13 in a pair of sets of 1000.
Nothing is capped: blocks only split the work.

Defined results: null text, or text without words, has an empty set, is linked with nothing and kept; a single word is the
one shingle of its document; a null doc_id has a null component and is kept; rows that repeat a doc_id share its component;
a very long text is one set in memory; columns of other names are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, bounded_batches, materialize, table, worker_cache
from graphloom.llm.components import components

REGISTERS = 128
ROWS = 4  # registers of a band
BASE = 1.001
RATE = 20.0
LIMIT = 65535
PERCENT = 80
LEAST_ESTIMATE = 0.62  # five standard deviations of the estimate below 0.8
BLOCK = 2048  # members of a block, probes and others each
BLOCK_SHINGLES = 8_000_000  # and their shingles together
LEAST_EQUAL = 48  # of 128 registers: a quick test far below what any estimate of LEAST_ESTIMATE has
FLUSH = 200_000
CACHED = 300_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_factors = np.random.default_rng(5).integers(1, 1 << 63, REGISTERS, np.uint64) << np.uint64(1) | np.uint64(1)


def word_hashes() -> WordHashes:
    """One a worker process."""
    return worker_cache("shingles", 0, WordHashes)


def shingles(text: bytes | None, hashes: WordHashes | None = None) -> np.ndarray:
    """Distinct 64-bit values of the two-word shingles, ascending."""
    hashes = word_hashes() if hashes is None else hashes
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    first, second = (h[:-1], h[1:]) if len(h) > 1 else (h, np.zeros(1, np.uint64))
    x = first * _M1 + (second ^ (second >> np.uint64(29))) * _M2
    x = (x ^ (x >> np.uint64(31))) * _M3
    return np.unique(x ^ (x >> np.uint64(32)))


def registers(values: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit values."""
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    for k in range(0, len(values), 1024):
        np.minimum(least, (values[k : k + 1024, None] * _factors).min(axis=0), out=least)
    h = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of a union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 100) -> np.ndarray:
    """Maximum-likelihood similarity of pairs, from (pairs, registers) arrays and the sets' sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, steps + 1)[None, :]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    fit = more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], axis=1)[:, 0]


def similar(inter: int, n_a: int, n_b: int) -> bool:
    return 100 * inter >= PERCENT * (n_a + n_b - inter)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, fp (of the whole set; null if empty), reg."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for b in batches:
            n, fp, reg = [], [], []
            for text in as_bytes(b.column(1)):
                s = shingles(text, hashes)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                reg.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(reg, pa.binary())], ["doc_id", "n", "fp", "reg"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, fp binary, reg binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id, full (64-bit values) of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, hashes).tobytes() for t in as_bytes(b.column(1))], pa.binary())], ["id", "full"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, full binary")


def likely(pairs: DataFrame, reps: DataFrame, least: float = LEAST_ESTIMATE) -> DataFrame:
    """Those of pairs (a, b) whose sizes allow the link and whose estimate comes near."""
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("reg").alias(f"reg_{side}")), side)
    pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<u2").reshape(t.num_rows, -1) for c in (2, 3))
                n_a, n_b = (t.column(c).to_numpy().astype(float) for c in (4, 5))
                keep = np.concatenate([estimate(a[k : k + 2000], b[k : k + 2000], n_a[k : k + 2000], n_b[k : k + 2000]) for k in range(0, t.num_rows, 2000)]) >= least
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "reg_a", "reg_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are links, on full sets."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("full").alias(f"set_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def intersections(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of a set's intersections with others, all ascending and not empty."""
    values = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, values), len(one) - 1)] == values
    return np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in others])[:-1]]))


def block_links(probes: list[tuple], base: list[tuple]) -> list[tuple[int, int]]:
    """Links of (rep, comp, size, registers, set) probes with the others in a block that join its components, one for each two joined."""
    if not probes or not base:
        return []
    n_p, n_b = (np.array([r[2] for r in x], float) for x in (probes, base))
    reg_p, reg_b = (np.frombuffer(b"".join(r[3] for r in x), "<u2").reshape(len(x), -1) for x in (probes, base))
    sets = [np.frombuffer(r[4], np.uint64) for r in base]
    root = {c: c for r in (*probes, *base) for c in (r[1],)}
    comps, place = np.unique([r[1] for r in base], return_inverse=True)
    roots = comps.copy()  # of each component in the base

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for k, (rep, comp, _, _, full) in enumerate(probes):
        mine = find(comp)
        some = np.flatnonzero((roots[place] != mine) & (np.minimum(n_b, n_p[k]) * 100 >= np.maximum(n_b, n_p[k]) * PERCENT))
        some = some[(reg_b[some] == reg_p[k]).sum(axis=1) >= LEAST_EQUAL]
        if not len(some):
            continue
        est = estimate(np.broadcast_to(reg_p[k], (len(some), reg_p.shape[1])), reg_b[some], np.full(len(some), n_p[k]), n_b[some])
        some = some[est >= LEAST_ESTIMATE][np.argsort(-est[est >= LEAST_ESTIMATE], kind="stable")]
        for at in range(0, len(some), 32):  # likeliest first; those of a component that was joined meanwhile are left out
            few = [j for j in some[at : at + 32].tolist() if roots[place[j]] != mine]
            if not few:
                continue
            for j, inter in zip(few, intersections(np.frombuffer(full, np.uint64), [sets[j] for j in few]).tolist(), strict=True):
                if roots[place[j]] != mine and similar(inter, n_p[k], n_b[j]):
                    out.append((rep, base[j][0]))
                    root[find(base[j][1])] = mine
                    roots = np.array([find(c) for c in comps])
    return out


def rest_links(members: DataFrame, comp: DataFrame, reps: DataFrame, sets: DataFrame, block: int | None = None) -> DataFrame:
    """Links (a, b) that join components within the bands (h, rep, n, lo) whose members aren't in one yet."""
    block = block or BLOCK
    of = comp.select(F.col("node").alias("rep"), "root")
    rows = members.where("rep > lo").join(of, "rep", "left").select("h", "rep", F.coalesce("root", "rep").alias("comp"), "n")
    sizes = rows.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_s"))
    sizes = sizes.groupBy("h").agg(F.max_by("comp", F.struct("_n", "comp")).alias("main"), F.sum("_n").alias("n_band"), F.max("_n").alias("most"), F.sum("_s").alias("shingles")).where("most < n_band")
    rows = materialize(rows.join(sizes, "h"), "dup-rest")
    blocks = F.greatest(F.col("n_band") / block, F.col("shingles") / BLOCK_SHINGLES)
    rows = rows.withColumns({"nb": F.ceil(blocks).cast("int"), "np": F.ceil(blocks * (F.col("n_band") - F.col("most")) / F.col("n_band")).cast("int"), "s": F.xxhash64("rep")})
    base = rows.select("h", F.pmod("s", "nb").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("j"), F.lit(False).alias("probe"), "rep", "comp", "n")
    probe = rows.where("comp <> main").select("h", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), F.pmod("s", "np").cast("int").alias("j"), F.lit(True).alias("probe"), "rep", "comp", "n")
    own = reps.select("rep", "reg").join(sets.select(F.col("id").alias("rep"), "full"), "rep")
    dealt = base.unionByName(probe).join(own, "rep").select("h", "i", "j", "probe", "rep", "comp", "n", "reg", "full").repartition(F.col("h"), F.col("i"), F.col("j")).sortWithinPartitions("h", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: tuple[list, list] = ([], [])
        pairs: set[tuple[int, int]] = set()

        def given() -> pa.RecordBatch:
            out = sorted(pairs)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        def closed() -> None:
            pairs.update((min(p), max(p)) for p in block_links(held[1], held[0]))
            held[0].clear()
            held[1].clear()

        for b in batches:
            for h, i, j, probing, rep, c, n, reg, full in zip(*(b.column(k).to_pylist() for k in range(9)), strict=True):
                if (h, i, j) != key:
                    closed()
                    key = (h, i, j)
                    if len(pairs) >= FLUSH:
                        yield given()
                held[probing].append((rep, c, n, reg, full))
        closed()
        yield given()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) after more links (a, b) between nodes."""
    for side in ("a", "b"):
        links = links.join(comp.select(F.col("node").alias(side), F.col("root").alias("_r")), side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    last = components(links.select("a", "b"))
    moved = comp.join(last.select(F.col("node").alias("root"), F.col("root").alias("_last")), "root", "left").select("node", F.coalesce("_last", "root").alias("root"))
    return materialize(moved.unionByName(last.join(comp.select("node"), "node", "left_anti").select("node", "root")), "dup-joined")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_rows = materialize(sketches(docs), "dup-sketches")
    reps = materialize(all_rows.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("reg").alias("reg")), "dup-reps")
    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda k: F.xxhash64(k, F.substring("reg", k * width + 1, F.lit(width))))
    keyed = reps.select("rep", "n", F.explode(bands).alias("h"))
    several = keyed.groupBy("h").agg(F.min("rep").alias("lo"), F.max("rep").alias("_hi")).where("lo < _hi").select("h", "lo")
    members = materialize(keyed.join(several, "h"), "dup-members")
    need = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(shingle_sets(docs.join(need, "doc_id", "left_semi")), "dup-sets")
    star = members.where("rep > lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(verified(likely(star, reps), sets), "dup-links")
    comp = materialize(components(links), "dup-components")
    comp = joined(comp, materialize(rest_links(members, comp, reps, sets), "dup-more-links"))
    own = reps.select("fp", "rep").join(comp.select(F.col("node").alias("rep"), "root"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("root"))
    # Copies of one set may be a third of all rows: an inner join of many to one, which the adaptive skew join can split.
    linked = all_rows.where("fp is not null and doc_id is not null").join(own, "fp").select("doc_id", "n", F.col("root").alias("component_id"))
    alone = all_rows.where("fp is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
