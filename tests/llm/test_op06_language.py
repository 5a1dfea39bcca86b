import math
import random

import numpy as np
import pytest

from graphloom.llm import op06_language as op
from graphloom.llm.common import py_remainder
from tests.llm.helpers import documents, edge_rows, write


def brute_phrases(text: str, reference: str) -> int:
    """Longest matches by substring search."""
    n = at = 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in reference:
            k += 1
        at += max(1, k)
        n += 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_phrases_equal_substring_search(seed):
    rnd = random.Random(seed)
    refs = [(lang, "".join(rnd.choice(letters) for _ in range(400))) for lang, letters in (("a", "abc "), ("b", "bcd "), ("c", "xyzabc"))]
    p = op.Parser(refs)
    texts = ["".join(rnd.choice("abcdxyz q") for _ in range(rnd.randint(1, 90))) for _ in range(40)]

    def clean(t):
        return " ".join(x for x in t.split(" ")) if "  " not in t else clean(t.replace("  ", " "))

    got = p.phrases([p.cut(t) for t in texts], window=1000)
    for row, t in zip(got, texts, strict=True):
        t = clean(t)
        for k, (_, ref) in enumerate(refs):
            known = set(ref)
            plain = "".join(c if c in known or c == " " else "\0" for c in t)
            assert row[k] == brute_phrases(plain, clean(ref))


@pytest.mark.parametrize("window", [1, 2, 3, 16, 1000])
def test_windows_do_not_cut_phrases(window):
    """Texts of repeats, whose phrases span many windows, and mixed ones; every window gives the whole text's phrases."""
    rnd = random.Random(window)
    refs = [("a", "ab" * 200 + "abcabcabd" * 9), ("b", "".join(rnd.choice("abcd ") for _ in range(500)))]
    p = op.Parser(refs)
    texts = ["ab" * 150, "abcabcabd" * 40 + "x" + "ab" * 100, "", "q", *("".join(rnd.choice("abcdq ") for _ in range(rnd.randint(1, 300))) for _ in range(20))]
    cut = [p.cut(t) for t in texts]
    letters = {v: k for k, v in p.codes.items()} | {0: " ", 1: "\0"}
    plain = ["".join(letters[c] for c in x.tolist()) for x in cut]
    references = ["".join(letters[c] for c in p.cut(r).tolist()) for _, r in refs]
    want = [[brute_phrases(t, r) for r in references] for t in plain]
    assert p.phrases(cut, window=window).tolist() == want


def test_query_on_edge_rows_and_held_out(spark, tmp_path):
    rnd = random.Random(5)
    vocab = {"en": ["the", "house", "river", "over"], "de": ["der", "haus", "fluß", "über"], "fr": ["le", "maison", "rivière", "où"]}
    rows = [(100 + k, " ".join(rnd.choice(vocab[lang]) for _ in range(30)), lang, "s", 1) for k in range(150) for lang in [list(vocab)[k % 3]]]
    rows = edge_rows()[:4] + [edge_rows()[8]] + rows + rows[:2]
    got = op.op6_language(spark, write(spark, tmp_path, documents=documents(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (py_remainder(r["doc_id"], 5) == 0) for r in got)
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[8]["lang_pred"] == "und" and by[1]["score"] == 0
    assert all(by[r[0]]["lang_pred"] == r[2] for r in rows if r[0] >= 100)


def test_nothing_learned(spark, tmp_path):
    rows = [(k, "words here", None, None, 0) for k in range(5)]
    got = op.op6_language(spark, write(spark, tmp_path / "a", documents=documents(spark, rows))).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 5
    assert op.op6_language(spark, write(spark, tmp_path / "b", documents=documents(spark, []))).count() == 0


def test_sample_holds_whole_documents(spark):
    rows = [(k, f"abc def {k} " * (1 + k), "en", "s", 1) for k in range(40)] + [(100, "lang " * 500, "de", "s", 1), (101, "lang " * 400, "de", "s", 1)]
    refs = dict(op.references(documents(spark, rows), docs_per_lang=30, chars=900))
    texts = {r[1] for r in rows}
    assert sorted(refs) == ["de", "en"] and refs["de"] == "lang " * 400
    drawn = refs["en"].split("\n")
    assert len(drawn) > 2 and all(t in texts for t in drawn) and sum(map(len, drawn)) <= 900
    assert len(op.references(documents(spark, rows), docs_per_lang=2, chars=100_000)[1][1].split("\n")) == 2
    assert math.isfinite(np.float64(op.Parser(list(refs.items())).bits[0]))
