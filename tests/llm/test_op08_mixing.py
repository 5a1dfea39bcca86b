from collections import Counter

import pytest

from graphloom.llm import op08_mixing as op
from graphloom.llm.common import materialize
from tests.llm.helpers import documents, edge_rows, words, write


def loop_targets(sizes):
    """Reshares the excess by weight until no source is above its limit."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = 1.5 * sum(sizes.values()) - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def check(spark, root, rows):
    got = op.op8_mixing(spark, root).collect()
    assert len(got) == len(rows)
    size = {r[0]: len(words(r[1])) for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += len(words(r[1]))
    want = loop_targets(total)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    again = op.op8_mixing(spark, root).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    return taken, want


def test_edge_rows(spark, tmp_path):
    check(spark, write(spark, tmp_path, documents=documents(spark)), edge_rows())


def test_taken_words_meet_targets(spark, tmp_path):
    rows = [(k, "w " * (1 + k * 37 % 400), f"s{(k % 7) * (k % 3 > 0)}", None, 0) for k in range(3000)]
    rows = [(a, b, "en", c, 0) for a, b, c, _, _ in rows] + [(5000 + k, "x " * 50, "en", None, 0) for k in range(400)]
    taken, want = check(spark, write(spark, tmp_path, documents=documents(spark, rows)), rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 200)


def test_one_source_and_empty_texts(spark, tmp_path):
    rows = [(k, None, "en", "only", 0) for k in range(5)]
    taken, _ = check(spark, write(spark, tmp_path / "a", documents=documents(spark, rows)), rows)
    assert taken["only"] == 0
    assert op.op8_mixing(spark, write(spark, tmp_path / "b", documents=documents(spark, []))).count() == 0


def test_inclusion_follows_weights(spark):
    """With an own weight per document, heavier ones are taken more often."""
    df = spark.range(4000).selectExpr("id as doc_id", "'s' as source", "10L as size", "CASE WHEN id % 2 = 0 THEN 0.2D ELSE 0.6D END as weight", "id as _tag")
    plan = op.plan_of(df, weight="weight", share=1.0, most=2)
    out = op.copies(df, plan, weight="weight").groupBy("weight").sum("copies").collect()
    n = {r[0]: r[1] for r in out}
    assert n[0.6] > 2 * n[0.2]


def test_hot_source_is_spread(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'hot' as source", "1 + id % 50 as size", "id as _tag")
    out = op.copies(df, op.plan_of(df, share=0.4)).selectExpr("sum(copies * size) as t", "max(target) as w").first()
    assert abs(out["t"] - out["w"]) <= 50


@pytest.mark.parametrize("seed", range(5))
def test_rows_that_share_an_id_are_split(spark, tmp_path, seed):
    """Each source ends within one document of its target, though two thirds of its rows have one id; sizes tie or not."""
    df = spark.range(1200).selectExpr("if(id % 3 > 0, 7L + id % 2, id) as doc_id", "concat('s', id % 2) as source", "cast(if(id % 2 = 0, 25, 1 + id % 40) as long) as size")
    df = op.row_tag(materialize(df, "mixing-test"))
    plan = op.plan_of(df, seed=seed, share=0.7)
    out = op.copies(df, plan, seed=seed).selectExpr("source", "copies * size as w", "target", "size").groupBy("source").agg({"w": "sum", "target": "max", "size": "max"}).collect()
    for r in out:
        assert 0 <= r["max(target)"] - r["sum(w)"] < r["max(size)"]


def test_one_kind_of_rows_only(spark):
    """All rows alike: as many as fit."""
    df = op.row_tag(materialize(spark.range(600).selectExpr("5L as doc_id", "'s' as source", "10L as size"), "mixing-test"))
    out = op.copies(df, op.plan_of(df, share=0.5)).selectExpr("sum(copies * size) as w", "max(target) as t").first()
    assert out["t"] - 10 < out["w"] <= out["t"] == 3000
