import hashlib
import random
from collections import Counter

import numpy as np

import corpus_pipeline
from graphloom.llm import op06_language, op07_toxicity, op08_mixing, op10_setsketch
from graphloom.llm.common import materialize, py_remainder
from tests.llm.helpers import documents, write
from tests.llm.test_op07_toxicity import plain_scores
from tests.llm.test_op08_mixing import loop_targets
from tests.llm.test_op09_bpe import LIB
from tests.llm.test_op10_dups import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(seed=9):
    rnd = random.Random(seed)
    vocab = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(400):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(20, 80))]
        if k % 8 == 0:
            for _ in range(2):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "scum"]))
        rows.append((k, " ".join(w), "en", f"s{k % 5}", 1))
        labels.append((k, 1, int(k % 8 == 0)))
    rows += [(1000 + k, rows[k * 2 + 1][1], "en", "s1", 1) for k in range(30)]  # exact copies of clean ones
    rows += [(1100 + k, rows[k * 2 + 1][1] + " tail", "en", "s2", 1) for k in range(30)]  # near copies
    rows += [(3000 + k, "字典 語言 漢字 文章 " * 20 + f"號{k}", None, "s1", 1) for k in range(3)]  # a script no reference has
    rows += [(2000, "", "en", "s0", 0), (2001, None, None, None, None), (2002, "12 34 !!", "en", "s0", 8)]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    root = write(spark, tmp_path, documents=documents(spark, rows, extra=False), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, root), name)
        seen[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == COLUMNS
    text = {r[0]: r[1] for r in rows}
    kept = {r["doc_id"] for r in seen["toxicity"]}
    known = {k: t for k, _, t in labels if py_remainder(k, 4) != 2}
    parts = {r["doc_id"]: r["part"] for r in op07_toxicity.sample_ids(spark.createDataFrame(list(known.items()), "doc_id long, toxic int")).collect()}
    plain = plain_scores([r[:2] for r in rows], known, parts)
    assert all((k in kept) == (p < op07_toxicity.THRESHOLD) for k, p in plain.items() if abs(p - op07_toxicity.THRESHOLD) > 1e-3)
    toxic = {k for k, _, t in labels if t}
    assert len(toxic - kept) >= 0.9 * len(toxic) and len({k for k, _, t in labels if not t} - kept) <= 4
    spoken = {r["doc_id"] for r in seen["language"]}
    assert spoken == {k for k in kept if any(c.isalpha() for c in text[k] or "") and k < 3000}
    near = {r["doc_id"] for r in seen["near_dedup"]}
    want = brute([(k, text[k]) for k in spoken])
    assert near == {k for k in spoken if want[k][1] == k}
    sizes = Counter()
    source = {r[0]: r[3] for r in rows}
    for k in near:
        sizes[source[k]] += len(text[k].split())
    targets, taken = loop_targets(sizes), Counter()
    for r in seen["mixing"]:
        assert r["doc_id"] in near and r["text"] == text[r["doc_id"]]
        taken[r["source"]] += len(text[r["doc_id"]].split())
    assert max(Counter(r["doc_id"] for r in seen["mixing"]).values()) <= 2
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 60
    last = seen["encoding"]
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in seen["mixing"])
    for r in last:
        ids = LIB.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sorted(map(str, corpus_pipeline.run(spark, root).collect())) == sorted(map(str, last))
    assert {op06_language, op08_mixing, op10_setsketch}


def test_nothing_learned_keeps_texts_with_letters(spark, tmp_path):
    rows = [(1, "some words", None, "s", 1), (2, None, None, "s", 0), (3, "12 !", None, None, 1), (None, "more", None, "s", 1), (1, "some words", None, "s", 1)]
    root = write(spark, tmp_path, documents=documents(spark, rows), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert corpus_pipeline.toxicity(spark, docs, root).count() == 5
    assert sorted(r["text"] for r in corpus_pipeline.language(spark, docs, root).collect()) == ["more", "some words", "some words"]


def test_extra_columns_and_empty_documents(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    root = write(spark, tmp_path, documents=documents(spark, []), labels=labels)
    assert corpus_pipeline.run(spark, root).count() == 0
    rows = [(k, f"some words number {k} and more", "en", "s", 1) for k in range(20)]
    df = documents(spark, rows)
    root = write(spark, tmp_path / "b", documents=df, labels=labels)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, root), name)
        assert docs.columns == df.columns
    assert docs.count() > 0
