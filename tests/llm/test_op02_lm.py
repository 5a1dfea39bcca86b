import math
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import op02_lattice_lm as op
from graphloom.llm.common import py_remainder, tokenizer_file
from tests.llm.helpers import documents, edge_rows, words, write


def paths(text: bytes, pieces: dict[bytes, float]):
    """All segmentations, by recursion: log-probabilities."""
    if not text:
        return [0.0]
    return [pieces[text[:n]] + rest for n in range(1, len(text) + 1) if text[:n] in pieces for rest in paths(text[n:], pieces)]


def test_forward_sums_all_segmentations():
    pieces = {b" a": 0.2, b" ab": 0.1, b"b": 0.2, b"ba": 0.1, b"a": 0.1, b" ": 0.1, b"ab": 0.1, b"c": 0.1}
    logs = {k: math.log(v) for k, v in pieces.items()}
    model = op.Lattice(list(logs), list(logs.values()))
    for word in (b"a", b"ab", b"abab", b"bababc", b"cabba"):
        want = math.log(sum(math.exp(x) for x in paths(b" " + word, logs)))
        assert model.log_marginal(word) == pytest.approx(want)


def test_weights_are_the_vocabulary_s_own():
    """Ranks weigh 1 / (rank + 1), log-probabilities themselves; nothing is left out and nothing else changes them."""
    pieces, logs = op.weigh({b" the": 0.0, b"A": -1.0, b"b": -2.0})
    w = dict(zip(pieces, np.exp(logs), strict=True))
    assert w[b" the"] == pytest.approx(2 * w[b"A"]) and w[b"A"] == pytest.approx(1.5 * w[b"b"]) and w[b"\xff"] == pytest.approx(w[b"b"])
    assert len(w) == 257 and sum(w.values()) == pytest.approx(1)
    pieces, logs = op.weigh({b" the": -1.5, b"A": -2.25})
    w = dict(zip(pieces, logs, strict=True))
    assert w[b" the"] - w[b"A"] == pytest.approx(0.75)


def test_long_words_do_not_underflow():
    pieces, logs = op.read_pieces(tokenizer_file("piece_bpe_32k.model"))
    value = op.Lattice(pieces, logs.tolist()).log_marginal("é日x".encode() * 3000)
    assert math.isfinite(value) and value < -1000


def lattice_backwards(word: bytes, weights: dict[bytes, float], longest: int) -> float:
    """Log marginal by recursion from the word's end."""
    text = b" " + word
    mass = [-math.inf] * len(text) + [0.0]
    for at in range(len(text) - 1, -1, -1):
        terms = [weights[text[at:end]] + mass[end] for end in range(at + 1, min(len(text), at + longest) + 1) if text[at:end] in weights]
        top = max(terms)
        mass[at] = top + math.log(sum(math.exp(t - top) for t in terms))
    return mass[0]


def plain(rows):
    """Sorted (null id, id, n_tokens, n_known, held_out, train tokens, base, score, lattice) by loops over the definition."""
    pieces, logs = op.read_pieces(tokenizer_file("piece_bpe_32k.model"))
    weights, longest = dict(zip(pieces, logs.tolist(), strict=True)), max(map(len, pieces))
    c = Counter()
    for r in rows:
        if py_remainder(r[0], 5) != 1:
            c.update([*words(r[1]), b""])
    n, v, ends = sum(c.values()), len(c), c[b""]
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once else 0.5
    marginal = {w: lattice_backwards(w, weights, longest) for r in rows for w in set(words(r[1]))}

    def p(w):
        return c[w] / n if not w else max(c[w] - d, 0) / n + d * (v - bool(ends)) / n * math.exp(marginal[w])

    def log10_p(w):  # long words' M is below the smallest double
        return math.log10(p(w)) if not w or marginal[w] > -600 or c[w] > d else (math.log(d * (v - bool(ends)) / n) + marginal[w]) / math.log(10)

    out = []
    for r in rows:
        t = [*words(r[1]), b""]
        out.append((r[0] is None, r[0] or 0, len(t), sum(c[w] > 0 for w in t), py_remainder(r[0], 5) == 1, n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), sum(map(log10_p, t)), sum(marginal[w] for w in t[:-1]) / math.log(10)))
    return sorted(out)


def check(got, rows):
    mine = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["held_out"], r["train_tokens"], r["base_score"], r["score"], r["lattice_score"]) for r in got)
    want = plain(rows)
    assert len(mine) == len(want)
    for a, b in zip(mine, want, strict=True):
        assert a[:6] == b[:6]
        np.testing.assert_allclose(a[6:], b[6:], rtol=1e-9)


def test_query_against_definition(spark, tmp_path):
    rows = edge_rows() + [(k, f"common words and rare{k} the the and", "en", "a", 1) for k in range(100, 160)]
    check(op.op2_lattice_lm(spark, write(spark, tmp_path, documents=documents(spark, rows))).collect(), rows)


@pytest.mark.parametrize("frequent", [1, 20, 1000])
def test_where_frequent_words_end_changes_nothing(spark, frequent):
    """At 1 only a word that is all tokens would be shared; known words take the packed way, the end token never does."""
    rows = [(k, " ".join(f"w{(k * j) % 37}" for j in range(1, 40)) + f" own{k}", "en", "a", 1) for k in range(60)] + edge_rows()[:3]
    docs = documents(spark, rows).selectExpr("*", "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 5) = 1 as ho").drop("held_out").withColumnRenamed("ho", "held_out")
    check(op.score(docs, tokenizer_file("piece_bpe_32k.model"), frequent=frequent, words_per_bucket=10).collect(), rows)


def test_probabilities_sum_to_at_most_one(spark):
    """Words of one or two letters over a two-letter text have together no more than all probability."""
    rows = [(k, "ab a b ab ab ba", "en", "a", 1) for k in range(30)]
    out = op.score(documents(spark, [*rows, *[(1000 + k, w, "en", "a", 1) for k, w in enumerate(["a", "b", "ab", "ba", "aa", "bb", "aab", "zz"])]], extra=False).selectExpr("doc_id", "text", "doc_id >= 1000 as held_out"), tokenizer_file("piece_bpe_32k.model"))
    found = {r["doc_id"]: r for r in out.collect()}
    end = math.log10(30 / (30 * 7))
    assert sum(10 ** (found[1000 + k]["score"] - end) for k in range(8)) + 10**end <= 1.0 + 1e-6


def test_empty_table_and_no_training_rows(spark, tmp_path):
    assert op.op2_lattice_lm(spark, write(spark, tmp_path / "a", documents=documents(spark, []))).count() == 0
    held = next(k for k in range(100) if py_remainder(k, 5) == 1)
    got = op.op2_lattice_lm(spark, write(spark, tmp_path / "b", documents=documents(spark, [(held, "only held out", "en", "a", 1)]))).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(4, 0, 0)] and math.isfinite(got[0]["score"])
