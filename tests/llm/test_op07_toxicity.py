import math
import random

import numpy as np
import pytest

from graphloom.llm import op07_toxicity as op
from graphloom.llm.common import py_remainder
from tests.llm.helpers import documents, edge_rows, words, write

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=3):
    rnd = random.Random(seed)
    base = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1000, 1000 + n):
        toxic = k % 5 == 0
        w = [rnd.choice(base) for _ in range(rnd.randint(30, 120))]
        if toxic:
            for _ in range(max(1, len(w) // 30)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "scum"]))
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_held_out_and_edge_rows(spark, tmp_path):
    rows, labels = corpus()
    extra = [(1, 1, None), (None, 1, 1), (1000, 1, 1), (1000, 0, 0), (99999, 1, 1)]
    every = rows + edge_rows() + rows[:1]
    root = write(spark, tmp_path, documents=documents(spark, every), labels=spark.createDataFrame(labels + extra, LABELS))
    got = op.op7_toxicity(spark, root).collect()
    assert len(got) == len(every)
    truth = dict((a, c) for a, _, c in labels)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (py_remainder(r["doc_id"], 4) == 2) for r in got)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[1]["score"] == by[2]["score"] and by[1]["predicted"] == 0


def test_contexts_ignore_copies(spark):
    copies = [("same words in every copy of words", 1)] * 50 + [("other words", 0)]
    counts = {bytes(r["word"]): (r["toxic"], r["ordinary"]) for r in op.context_counts(spark.createDataFrame(copies, "text string, toxic int")).collect()}
    assert counts == {b"same": (1, 0), b"words": (2, 1), b"in": (1, 0), b"every": (1, 0), b"copy": (1, 0), b"of": (1, 0), b"other": (0, 1)}


def plain_scores(rows, labels, parts):
    """doc_id -> score, by loops over the definition, from rows (doc_id, text), labels and the part of each sampled id."""
    text = dict(rows)
    contexts = ({}, {})
    for i, part in parts.items():
        if part:
            before = b""
            for w in words(text[i]):
                contexts[labels[i]].setdefault(w, set()).add(before)
                before = w
    count = [{w: len(c) for w, c in contexts[k].items()} for k in (0, 1)]
    total = [sum(c.values()) for c in count]
    every = set(count[0]) | set(count[1])
    classes = {w: sum(w in c for c in count) for w in every}
    d = []
    for c in count:
        once, twice = (sum(n == k for n in c.values()) for k in (1, 2))
        d.append(once / (once + 2 * twice) if once else 0.5)
    weight = max(d[k] * len(count[k]) / total[k] for k in (0, 1))

    def p(w, k):
        shared = (classes.get(w, 0) + 0.5) / (sum(classes.values()) + 0.5 * (len(every) + 1))
        return max(count[k].get(w, 0) - d[k], 0) / total[k] + weight * shared

    def features(t):
        r = [math.log(p(w, 1) / p(w, 0)) for w in words(t)]
        if not r:
            return [0.0] * 4
        return [sum(r) / len(r)] + [max(sum(r[a : a + m]) / m for a in range(len(r) - m + 1)) for m in (min(1, len(r)), min(8, len(r)), min(32, len(r)))]

    calibration = [(features(text[i]), labels[i]) for i, part in sorted(parts.items()) if not part]
    y = np.array([v for _, v in calibration], float)
    seen = [labels[i] for i in labels]
    share = sum(seen) / len(seen)
    weights = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    x = np.column_stack([np.ones(len(y)), np.array([f for f, _ in calibration])])
    w = np.zeros(x.shape[1])
    for _ in range(20_000):  # gradient descent with a safe step, against Newton's method
        g = x.T @ (weights * (1 / (1 + np.exp(-x @ w)) - y)) + op.RIDGE * len(y) * w
        w -= g / (0.25 * (weights[:, None] * x * x).sum() + op.RIDGE * len(y))
    return {i: 1 / (1 + math.exp(-(w[0] + np.dot(w[1:], features(t))))) for i, t in rows}


def test_query_against_plain_loops(spark, tmp_path):
    rows, labels = corpus(240, seed=5)
    root = write(spark, tmp_path, documents=documents(spark, rows), labels=spark.createDataFrame(labels, LABELS))
    got = {r["doc_id"]: r["score"] for r in op.op7_toxicity(spark, root).collect()}
    known = {i: t for i, _, t in labels if py_remainder(i, 4) != 2}
    parts = {r["doc_id"]: r["part"] for r in op.sample_ids(spark.createDataFrame([(i, t) for i, t in known.items()], "doc_id long, toxic int")).collect()}
    assert set(parts) == set(known)
    want = plain_scores([r[:2] for r in rows], known, parts)
    np.testing.assert_allclose([got[i] for i in sorted(want)], [want[i] for i in sorted(want)], atol=2e-4)


def test_rare_and_unknown_words():
    model = op.Model([b"bad", b"ok", b"once", b"twice"], np.array([(40.0, 0.0), (40.0, 400.0), (1.0, 0.0), (2.0, 2.0)]))
    r = {w: model.ratio[k] for w, k in model.ids.items()}
    assert r[b"bad"] > 2 > r[b"once"] > 0 > r[b"ok"] and model.ratio[0] == 0
    f = model.features([b"BAD ok new", b"", None, b"bad " * 40], windows=(1, 2))
    bad, ok = r[b"bad"], r[b"ok"]
    np.testing.assert_allclose(f[0], [(bad + ok) / 3, bad, max((bad + ok) / 2, ok / 2)])
    np.testing.assert_allclose(f[1:3], 0)
    np.testing.assert_allclose(f[3], [bad] * 3)


def test_sample_holds_whole_documents_within_its_bound(spark):
    docs = documents(spark, [(k, "word " * (10 + k), "en", "s", 1) for k in range(50)])
    ids = op.sample_ids(spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int"))
    got = op.whole_texts(docs, ids, class_words=200).collect()
    assert {r["toxic"] for r in got} == {0, 1} and all(len(r["text"].split()) == 10 + r["doc_id"] for r in got)
    assert all(sum(len(r["text"].split()) for r in got if r["toxic"] == t) <= 200 for t in (0, 1))


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(1000, 1, 0)], 0.0), ([(1004, 1, 1)], None)])
def test_one_class_or_none(spark, tmp_path, labels, score):
    rows, _ = corpus(12)
    got = op.op7_toxicity(spark, write(spark, tmp_path, documents=documents(spark, rows), labels=spark.createDataFrame(labels, LABELS))).collect()
    want = score if score is not None else float(py_remainder(1004, 4) != 2)
    assert {r["score"] for r in got} == {want}


def test_empty_tables(spark, tmp_path):
    root = write(spark, tmp_path, documents=documents(spark, []), labels=spark.createDataFrame([], LABELS))
    assert op.op7_toxicity(spark, root).count() == 0
