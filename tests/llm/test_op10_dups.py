import random

import numpy as np
import pytest

from graphloom.llm import op10_setsketch as op
from graphloom.llm.components import components
from tests.llm.helpers import documents, edge_rows, words, write


def shingle_set(text):
    w = words(text)
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (size, smallest reachable id), over all pairs."""
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets[r[0]] = shingle_set(r[1])
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, root, rows):
    got = op.op10_setsketch(spark, root).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


def test_edge_rows(spark, tmp_path):
    check(spark, write(spark, tmp_path, documents=documents(spark)), edge_rows())


def test_chains_groups_and_borders(spark, tmp_path, monkeypatch):
    """A large group of near copies, a chain whose ends aren't similar, pairs just above and below the border; small blocks."""
    monkeypatch.setattr(op, "BLOCK", 8)
    rnd = random.Random(2)
    vocab = [f"v{k}" for k in range(3000)]

    def text(n):
        return [rnd.choice(vocab) for _ in range(n)]

    rows, k = [], 0
    base = text(60)
    for _ in range(60):  # near copies with one to eight edits
        w = list(base)
        for _ in range(rnd.randint(1, 8)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((k := k + 1, " ".join(w), "en", "s", 0))
    chain = text(100)
    for _ in range(12):  # each step changes a little
        chain = chain[4:] + text(4)
        rows.append((k := k + 1, " ".join(chain), "en", "s", 0))
    for n in (10, 20, 41):  # border: n + 1 words have n shingles
        for cut in range(1, n // 2):
            w = text(n + 1)
            rows.append((k := k + 1, " ".join(w), "en", "s", 0))
            rows.append((k := k + 1, " ".join(w[:-cut]), "en", "s", 0))
    rows += [(k := k + 1, " ".join(base), "en", "s", 0) for _ in range(30)]
    rows += [(k := k + 1, " ".join(text(40)), "en", "s", 0) for _ in range(60)]
    rnd.shuffle(rows)
    check(spark, write(spark, tmp_path, documents=documents(spark, rows)), rows)


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.8, 0.95):
        got = []
        for _ in range(40):
            n = 400
            common = rng.integers(0, 2**63, int(2 * n * j / (1 + j)), np.uint64)
            a, b = (np.concatenate([common, rng.integers(0, 2**63, n - len(common), np.uint64)]) for _ in range(2))
            got.append(op.estimate(op.registers(a)[None], op.registers(b)[None], np.array([float(n)]), np.array([float(n)]))[0])
        assert abs(np.mean(got) - j) < 0.03 and np.std(got) < 0.06


def test_registers_merge():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 300, np.uint64), rng.integers(0, 2**63, 500, np.uint64)
    np.testing.assert_array_equal(op.merge(op.registers(a), op.registers(b)), op.registers(np.concatenate([a, b])))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)] + [(100, 101)], [(9, 3), (3, 7), (8, 7), (8, 1), (2, 5)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_empty_table(spark, tmp_path):
    assert op.op10_setsketch(spark, write(spark, tmp_path, documents=documents(spark, []))).count() == 0


def test_templates_and_small_sets(spark, tmp_path, monkeypatch):
    """A hot template whose copies are similar but for the most part not linked, with linked ones among them, and links of few shingles."""
    monkeypatch.setattr(op, "BLOCK", 16)
    rnd = random.Random(8)
    vocab = [f"v{k}" for k in range(4000)]

    def text(n):
        return [rnd.choice(vocab) for _ in range(n)]

    rows, k = [], 0
    template = text(70)
    for _ in range(120):  # similarity 0.5 to 0.75 to each other
        w = template + text(rnd.randint(12, 22))
        rows.append((k := k + 1, " ".join(w), "en", "s", 0))
        if rnd.random() < 0.3:
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((k := k + 1, " ".join(w), "en", "s", 0))
    for n in range(5, 13):
        for _ in range(8):
            w = text(n + 1)
            rows += [(k := k + 1, " ".join(w), "en", "s", 0), (k := k + 1, " ".join(w[:-1]), "en", "s", 0)]
    rnd.shuffle(rows)
    check(spark, write(spark, tmp_path, documents=documents(spark, rows)), rows)


def test_a_block_gives_one_link_for_two_components():
    """Components whose members are all alike or all likely: as many links as joins, none where nothing is linked."""
    rng = np.random.default_rng(3)

    def rows(shared, own, n=60, comps=3):
        common, out = rng.integers(0, 2**63, shared, np.uint64), []
        for k in range(n):
            values = np.unique(np.concatenate([common, rng.integers(0, 2**63, own, np.uint64)]))
            out.append((k, k % comps, len(values), op.registers(values).tobytes(), values.tobytes()))
        return out

    linked, likely = rows(200, 10), rows(200, 35)
    assert len(op.block_links([r for r in linked if r[1]], linked)) == 2
    assert op.block_links([r for r in likely if r[1]], likely) == []
    some = [np.unique(rng.integers(0, 50, n, np.uint64)) for n in (1, 9, 40)]
    one = np.unique(rng.integers(0, 50, 20, np.uint64))
    assert op.intersections(one, some).tolist() == [len(np.intersect1d(one, x)) for x in some]
