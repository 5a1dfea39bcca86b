"""Graphs as edge tables: statistics, PageRank, communities, contraction, walks, label alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.rand import lower_half, uniform
from graphloom.operators import louvain_blocks
from graphloom.operators.checkpoints import dropped, freed, written


def undirected(edges: DataFrame) -> DataFrame:
    """src <= dst, w: parallel edges as one, their weights (1 each, without w) summed; loops stay."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(w).cast("double").alias("w"))


def symmetric(graph: DataFrame) -> DataFrame:
    """Both directions of an undirected edge table; a loop comes once."""
    ends = F.array(F.struct("src", "dst", "w"), F.when(F.col("src") != F.col("dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    return graph.select(F.explode(F.array_compact(ends)).alias("e")).select("e.*")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """src, nbrs: the outgoing neighbours, repeated as their edges are."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def degrees(graph: DataFrame) -> DataFrame:
    """node, degree (weighted, loops twice), loop."""
    own = F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)
    both = F.array(F.struct(F.col("src").alias("node"), "w", own.alias("loop")), F.struct(F.col("dst").alias("node"), "w", F.lit(0.0).alias("loop")))
    ends = graph.select(F.explode(both).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("w").alias("degree"), F.sum("loop").alias("loop"))


def community_stats(graph: DataFrame, partition: DataFrame) -> DataFrame:
    """comm, degree, inner: summed degrees, and weight of the edges inside (each once)."""
    p = partition.select("node", "comm")
    deg = degrees(graph).join(p, "node").groupBy("comm").agg(F.sum("degree").alias("degree"))
    e = graph.join(p.select(F.col("node").alias("src"), F.col("comm").alias("cs")), "src").join(p.select(F.col("node").alias("dst"), F.col("comm").alias("cd")), "dst")
    inner = e.where("cs = cd").groupBy(F.col("cs").alias("comm")).agg(F.sum("w").alias("inner"))
    return deg.join(inner, "comm", "left").select("comm", "degree", F.coalesce("inner", F.lit(0.0)).alias("inner"))


def modularity(graph: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: sum over communities of inner / m - (degree / 2m) ** 2."""
    m = graph.agg(F.sum("w").alias("m"))
    return community_stats(graph, partition).join(F.broadcast(m)).agg(F.sum(F.col("inner") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity"))


def neighbor_communities(graph: DataFrame, partition: DataFrame) -> DataFrame:
    """node, comm, w: weight from a node to each community next to it, loops left out."""
    p = partition.select(F.col("node").alias("dst"), "comm")
    return symmetric(graph).where("src <> dst").join(p, "dst").groupBy(F.col("src").alias("node"), "comm").agg(F.sum("w").alias("w"))


def contract(graph: DataFrame, partition: DataFrame) -> DataFrame:
    """Communities as nodes, summed weights; inner edges become loops."""
    p = partition.select("node", "comm")
    e = graph.join(p.select(F.col("node").alias("src"), F.col("comm").alias("cs")), "src").join(p.select(F.col("node").alias("dst"), F.col("comm").alias("cd")), "dst")
    return e.groupBy(F.least("cs", "cd").alias("src"), F.greatest("cs", "cd").alias("dst")).agg(F.sum("w").alias("w"))


def renumber(partition: DataFrame) -> DataFrame:
    """Communities as 0, 1, ... in order of their first node. The ranking is over communities, not nodes."""
    first = partition.groupBy("comm").agg(F.min("node").alias("_first"))
    ranked = first.withColumn("_new", F.row_number().over(Window.orderBy("_first")) - 1)
    return partition.join(ranked.select("comm", "_new"), "comm").select("node", F.col("_new").cast("long").alias("comm"))


def last_pass(passes: DataFrame, wanted: int, tolerance: int = 2) -> DataFrame:
    """pass: the deepest whose number of communities is within tolerance of wanted; no row if there is none."""
    sizes = passes.groupBy("pass").agg(F.countDistinct("comm").alias("n"))
    return sizes.where(F.abs(F.col("n") - wanted) <= tolerance).agg(F.max("pass").alias("pass")).where("pass is not null")


def majority_labels(communities: DataFrame, truth: DataFrame, default: int) -> DataFrame:
    """node, label: the most frequent label among a community's labelled members (ties: the label of the smallest node)."""
    votes = communities.join(truth, "node").groupBy("comm", "label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    best = votes.groupBy("comm").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"))
    return communities.join(best, "comm", "left").select("node", "comm", F.coalesce("label", F.lit(default)).alias("label"))


def agreement(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    return a.select(key, F.col(column).alias("_a")).join(b.select(key, F.col(column).alias("_b")), key).agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def pagerank(edges: DataFrame, rounds: int = 20, tol: float = 1e-6, damping: float | None = None, checkpoint_every: int = 4) -> DataFrame:
    """node, rank by power iteration. Without damping, as in the plain iteration; mass that dead ends lose is spread evenly.

    The edge table with out-degrees is made once; each round is one join and one partially aggregated sum.
    """
    links = written(edges.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src").select("src", "dst", "out"), "pr-links")
    everyone = written(nodes(edges), "pr-nodes")
    n = everyone.count()
    ranks = everyone.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        came = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("came"))
        came = everyone.join(came, everyone["node"] == came["dst"], "left").select("node", F.coalesce("came", F.lit(0.0)).alias("came"))
        if damping is not None:
            came = came.withColumn("came", F.col("came") * damping)
        lost = came.agg(((F.lit(1.0) - F.sum("came")) / n).alias("lost"))
        new = came.join(F.broadcast(lost)).select("node", (F.col("came") + F.col("lost")).alias("rank"))
        if tol or (k + 1) % checkpoint_every == 0:
            new = written(new, "pr-ranks")
        if tol and new.join(ranks.withColumnRenamed("rank", "_old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0] < tol:
            return new
        ranks = new
    return ranks


#: Rounds without a rise that end a pass: three draws, each with both parities.
IDLE = 6


def _moves(graph: DataFrame, partition: DataFrame, parity: int, salt: int) -> DataFrame:
    """node, comm: the best gaining move of the nodes whose turn it is."""
    m = graph.agg(F.sum("w").alias("m"))
    deg = degrees(graph).select("node", "degree")
    comm_deg = deg.join(partition, "node").groupBy("comm").agg(F.sum("degree").alias("cdeg"))
    near = neighbor_communities(graph, partition).withColumnRenamed("comm", "to")
    own = partition.join(deg, "node").join(comm_deg, "comm").select("node", F.col("comm").alias("own"), "degree", F.col("cdeg").alias("own_deg"))
    stay = near.join(partition.select("node", F.col("comm").alias("to")), ["node", "to"]).select("node", F.col("w").alias("own_w"))
    turn = (uniform(salt, F.col("node")) < 0.5) == F.lit(parity == 0)
    options = near.join(own, "node").where((F.col("to") != F.col("own")) & turn).join(stay, "node", "left").join(comm_deg.withColumnRenamed("comm", "to"), "to").join(F.broadcast(m))
    norm = F.col("degree") / (2 * F.col("m"))
    gain = F.col("w") - F.coalesce("own_w", F.lit(0.0)) - (F.col("cdeg") - F.col("own_deg") + F.col("degree")) * norm
    return options.withColumn("gain", gain).where("gain > 1e-12").groupBy("node").agg(F.max_by("to", F.struct("gain", -F.col("to"))).alias("comm"))


def _louvain_in_memory(src: np.ndarray, dst: np.ndarray, w: np.ndarray, tol: float, max_passes: int, max_rounds: int, first_pass: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """pass, nodes and their communities, by the rounds of louvain() on one undirected edge table; the same moves, draws and ties."""
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    original, member, m = ids, np.arange(len(ids)), w.sum()
    for step in range(first_pass, max_passes):
        n, loop = len(ids), a == b
        s, d, x = np.concatenate([a[~loop], b[~loop]]), np.concatenate([b[~loop], a[~loop]]), np.concatenate([w[~loop], w[~loop]])
        degree = np.bincount(a, w, n) + np.bincount(b, w, n)

        def quality(comm: np.ndarray) -> float:
            inside = w[comm[a] == comm[b]].sum()  # noqa: B023
            return inside / m - ((np.bincount(comm, degree, n) / (2 * m)) ** 2).sum()  # noqa: B023

        comm = np.arange(n)
        score = start = quality(comm)
        idle = 0
        for r in range(max_rounds):
            if r % 2 == 0:
                low = lower_half(step * 100 + r // 2, ids)
            total = np.bincount(comm, degree, n)
            pair, at = np.unique(s * n + comm[d], return_inverse=True)
            near, node, to = np.bincount(at, x, len(pair)), pair // n, pair % n
            own = np.zeros(n)
            stays = to == comm[node]
            own[node[stays]] = near[stays]
            pick = ~stays & (low[node] == (r % 2 == 0))
            node, to, near = node[pick], to[pick], near[pick]
            gain = near - own[node] - (total[to] - total[comm[node]] + degree[node]) * (degree[node] / (2 * m))
            node, to, gain = node[gain > 1e-12], to[gain > 1e-12], gain[gain > 1e-12]
            order = np.lexsort((to, -gain, node))
            node, first = np.unique(node[order], return_index=True)
            moved = comm.copy()
            moved[node] = to[order][first]
            gained = quality(moved)
            if gained - score >= tol:
                comm, score, idle = moved, gained, 0
            else:
                idle += 1
                if idle == IDLE:
                    break
        if score - start < tol and step:
            break
        _, first, comm = np.unique(comm, return_index=True, return_inverse=True)
        comm = np.argsort(np.argsort(first))[comm]
        member = comm[member]
        yield step, original, member
        if score - start < tol:
            break
        k = len(first)
        pair, at = np.unique(np.minimum(comm[a], comm[b]) * k + np.maximum(comm[a], comm[b]), return_inverse=True)
        a, b, w, ids = pair // k, pair % k, np.bincount(at, w, len(pair)), np.arange(k)


def louvain(edges: DataFrame, tol: float = 1e-7, max_passes: int = 10, max_rounds: int = 16, init: DataFrame | None = None, most: int = 1_000_000, held: int = 4_000_000) -> DataFrame:
    """pass, node, comm for every pass, nodes being the original ones. init: (node, comm) that the first pass starts from, else each node alone.

    Synchronous rounds: nodes whose hash has the round's parity take their best gaining move, the others wait, and a round
    counts only if modularity rises by tol; so it never falls. Neighbours that would swap places in one round can move under
    another draw, so a pass ends after IDLE rounds without a rise. Then communities are contracted.
    A graph of up to `most` edges with whole numbers as nodes, and without init, is one task's work; above that and up to `held`
    nodes, edges lie in blocks and the driver holds what each node is in. The rounds are the same in each way.
    """
    with freed(edges.sparkSession):
        graph = written(undirected(edges), "lv-graph")
    return _louvain(graph, tol, max_passes, max_rounds, init, most, held)


def _louvain(graph: DataFrame, tol: float, max_passes: int, max_rounds: int, init: DataFrame | None, most: int = 1_000_000, held: int = 4_000_000) -> DataFrame:
    """louvain() of an undirected edge table, as written() returned it."""
    if init is None and graph.schema["src"].dataType.simpleString() in ("int", "bigint"):
        n, known = graph.agg(F.count(F.lit(1)), F.count(F.when(F.col("src").isNotNull() & F.col("w").isNotNull(), 1))).first()
        if 0 < n == known and n <= most:

            def alone(rows: pd.DataFrame) -> pd.DataFrame:
                passes = _louvain_in_memory(*(rows[c].to_numpy() for c in ("src", "dst", "w")), tol, max_passes, max_rounds)
                return pd.concat([pd.DataFrame({"pass": k, "node": node, "comm": comm}) for k, node, comm in passes])

            return written(graph.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(alone, "pass int, node long, comm long"), "lv-alone")
        if 0 < n == known:
            rest = lambda src, dst, w, step: _louvain_in_memory(src, dst, w, tol, max_passes, max_rounds, step)
            out = louvain_blocks.passes(graph, n, tol, max_passes, max_rounds, IDLE, most, held, rest)
            if out is not None:
                dropped(graph)
                return out
    member = written(nodes(graph).select("node", F.col("node").alias("comm")), "lv-member")
    out = None
    for step in range(max_passes):
        part = nodes(graph).select("node", F.col("node").alias("comm")) if init is None or step else init.select("node", "comm")
        part = written(part, "lv-part")
        score = modularity(graph, part).first()[0] or 0.0
        start, idle = score, 0
        for r in range(max_rounds):
            moves = _moves(graph, part, r % 2, step * 100 + r // 2).withColumnRenamed("comm", "_to")
            new = written(part.join(moves, "node", "left").select("node", F.coalesce("_to", "comm").alias("comm")), "lv-part")
            gained = modularity(graph, new).first()[0] or 0.0
            if gained - score >= tol:
                part, score, idle = new, gained, 0
            else:
                idle += 1
                if idle == IDLE:
                    break
        if score - start < tol and out is not None:
            break
        part = written(renumber(part), "lv-part")
        member = written(member.join(part.select(F.col("node").alias("comm"), F.col("comm").alias("_c")), "comm").select("node", F.col("_c").alias("comm")), "lv-member")
        this = member.withColumn("pass", F.lit(step))
        out = this if out is None else out.unionByName(this)
        graph = written(contract(graph, part), "lv-graph")
        if score - start < tol:
            break
    return out.select("pass", "node", "comm")


class Louvain:
    """Communities of an edge table: all passes, the last one whose number of communities is near the wanted one, and lookups."""

    def __init__(self, n_partitions: int | None = None, tol: float = 1e-7, max_passes: int = 10, max_rounds: int = 16):
        self.wanted, self.tol, self.max_passes, self.max_rounds, self.passes = n_partitions, tol, max_passes, max_rounds, None

    def fit(self, edges: DataFrame, known: DataFrame | None = None, init: DataFrame | None = None) -> Louvain:
        """known: nodes (node) that must be those of the edges; init: a partition (node, comm) of them to start from."""
        with freed(edges.sparkSession):
            graph = written(undirected(edges), "lv-graph")
        if not graph.limit(1).count():
            raise ValueError("a graph without edges")
        for given, what in ((known, "nodes"), (init, "the first partition")):
            if given is not None:
                missing, extra = same_nodes(given.select("node"), nodes(edges)).first()
                if missing or extra:
                    raise ValueError(f"{what} and the edges' ends differ: {missing} without an edge, {extra} not listed")
        self.passes = written(_louvain(graph, self.tol, self.max_passes, self.max_rounds, init), "lv-passes")
        return self

    def partition(self) -> DataFrame:
        """node, comm of the last pass, or of the deepest one within two of the wanted number of communities."""
        if self.passes is None:
            raise ValueError("not fitted")
        last = self.passes.agg(F.max("pass").alias("pass")) if self.wanted is None else last_pass(self.passes, self.wanted)
        return self.passes.join(F.broadcast(last), "pass").select("node", "comm")

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (node) with comm; null for nodes that weren't there."""
        return rows.join(self.partition(), "node", "left")


def random_walks(edges: DataFrame, starts: DataFrame, length: int = 10, walks: int = 1, seed: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """walk, start, path: self-avoiding walks, uniform or by weights (node, weight); a walk ends early without a fresh neighbour.

    One join a step against the adjacency table; the draw is a hash of seed, walk and step.
    """
    adj = adjacency(edges.select("src", "dst").distinct())
    if weights is not None:
        w = edges.select("src", "dst").distinct().join(weights.select(F.col("node").alias("dst"), "weight"), "dst")
        adj = w.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("nbrs"))
    adj = written(adj, "walk-adjacency")
    state = starts.select(F.col("node").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk")).withColumns({"path": F.array("start"), "cur": F.col("start")})
    for step in range(1, length):
        u = uniform(seed, F.col("start"), F.col("walk"), F.lit(step))
        joined = state.join(adj.withColumnRenamed("src", "cur"), "cur", "left")
        if weights is None:
            fresh = F.array_except(F.coalesce("nbrs", F.array().cast("array<long>")), "path")
            nxt = F.when((F.size(fresh) > 0) & F.col("cur").isNotNull(), F.get(fresh, F.floor(u * F.size(fresh)).cast("int")))
        else:
            fresh = F.filter("nbrs", lambda x: ~F.array_contains("path", x["dst"]))
            total = F.aggregate(fresh, F.lit(0.0), lambda a, x: a + x["weight"])
            # The first neighbour whose running weight exceeds the draw.
            hit = F.aggregate(fresh, F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("dst")), lambda a, x: F.struct((a["sum"] + x["weight"]).alias("sum"), F.when(a["dst"].isNull() & (a["sum"] + x["weight"] > u * total), x["dst"]).otherwise(a["dst"]).alias("dst")))
            nxt = F.when(F.col("cur").isNotNull(), hit["dst"])
        state = joined.withColumn("_n", nxt).select("start", "walk", F.when(F.col("_n").isNotNull(), F.concat("path", F.array("_n"))).otherwise(F.col("path")).alias("path"), F.col("_n").alias("cur"))
        if step % 5 == 0:
            state = written(state, "walks")
    return state.select("walk", "start", "path")


def triangles(graph: DataFrame) -> DataFrame:
    """a, b, c: nodes in rising order, each next to both others. A node's later neighbours go to each of them as one list, not as rows."""
    ahead = graph.where("src <> dst").groupBy(F.least("src", "dst").alias("src")).agg(F.array_sort(F.collect_set(F.greatest("src", "dst"))).alias("_up"))
    ahead = written(ahead, "tri-ahead")
    sent = ahead.select(F.col("src").alias("a"), "_up", F.posexplode("_up").alias("_k", "b"))
    sent = sent.where(F.col("_k") + 1 < F.size("_up")).select("a", "b", F.slice("_up", F.col("_k") + 2, F.size("_up")).alias("_rest"))
    met = sent.hint("merge").join(ahead.select(F.col("src").alias("b"), "_up").hint("merge"), "b")
    return met.select("a", "b", F.explode(F.array_intersect("_rest", "_up")).alias("c"))


#: Pairs of edges that a task holds at once, and rows that it returns at once.
PAIRS, RETURNED = 4_000_000, 100_000


def second_order(graph: DataFrame, each: Callable, kinds: str, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """What `each` (cur, prev, nxt, prob by prev and nxt) returns as columns, for the second-order steps at each node of an undirected edge table.

    All edges at a node come once, as lists of its row; whether a step stays near prev is told by the triangles at the node.
    So the pairs of edges are made in NumPy, some PAIRS at a time, and never shuffled.
    """
    sym = symmetric(graph).where("src IS NOT NULL AND dst IS NOT NULL")
    hops = sym.groupBy(F.col("src").alias("cur")).agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("_h"))
    corners = F.array(*(F.struct(F.col(x).alias("cur"), F.col(y).alias("a"), F.col(z).alias("b")) for x, y, z in ("abc", "acb", "bac", "bca", "cab", "cba")))
    near = triangles(graph).select(F.explode(corners).alias("t")).select("t.*").groupBy("cur").agg(F.collect_list(F.struct("a", "b")).alias("_c"))
    rows = hops.join(near.hint("merge"), "cur", "left").select("cur", F.col("_h.dst").alias("n"), F.col("_h.w").alias("w"), F.col("_c.a").alias("a"), F.col("_c.b").alias("b"))

    def at_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for cur, n, w, a, b in batch[["cur", "n", "w", "a", "b"]].itertuples(index=False):
                slab = max(1, PAIRS // len(n))
                for at in range(0, len(n), slab):
                    prev, k = n[at : at + slab], np.arange(min(slab, len(n) - at))
                    x = np.repeat((w / q)[None, :], len(prev), axis=0)
                    if a is not None:
                        i, j = np.searchsorted(n, a) - at, np.searchsorted(n, b)
                        here = (i >= 0) & (i < len(prev))
                        x[i[here], j[here]] = w[j[here]]
                    # A loop's end is next to all that the node is next to.
                    x[:, n == cur] = w[n == cur]
                    x[prev == cur] = w
                    x[k, at + k] = w[at + k] / p
                    out.append(each(cur, prev, n, x / x.sum(axis=1)[:, None]))
                    size += len(out[-1][0])
                    if size >= RETURNED:
                        yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))
                        out, size = [], 0
            if out:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    names = [x.split()[0] for x in kinds.split(", ")]
    return rows.mapInPandas(at_nodes, kinds)


def transitions(graph: DataFrame, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """prev, cur, nxt, prob: second-order steps; weight w / p back, w to a neighbour of prev too, else w / q."""

    def each(cur: int, prev: np.ndarray, nxt: np.ndarray, prob: np.ndarray) -> tuple:
        return np.repeat(prev, len(nxt)), np.full(prob.size, cur), np.tile(nxt, len(prev)), prob.ravel()

    return second_order(graph, each, "prev long, cur long, nxt long, prob double", p, q)


def biased_walks(graph: DataFrame, starts: DataFrame, length: int, walks: int = 1, p: float = 1.0, q: float = 1.0, seed: int = 0, own: DataFrame | None = None) -> DataFrame:
    """walk, start, path: second-order walks; nodes may come again, dead ends stop. own: (node, p, q) that override p and q at nodes.

    A step joins the walkers with the edges of where they stand and with those of where they came from, so there are rows
    for the walks alone, not for every pair of edges; the next node is drawn by running weights in order of the node.
    """
    sym = written(symmetric(graph), "n2v-edges")
    hops = sym.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"), "w")
    near = sym.select(F.col("src").alias("prev"), F.col("dst").alias("nxt"), F.lit(True).alias("_near"))
    first = written(adjacency(sym), "n2v-adjacency").select(F.col("src").alias("start"), "nbrs")
    state = starts.select(F.col("node").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    u = uniform(seed, F.col("start"), F.col("walk"), F.lit(1))
    state = state.join(first, "start", "left").withColumn("cur", F.get("nbrs", F.floor(u * F.size("nbrs")).cast("int")))
    state = state.select("start", "walk", F.array_compact(F.array("start", "cur")).alias("path"), F.when(F.col("cur").isNotNull(), F.col("start")).alias("prev"), "cur")
    for step in range(2, length):
        rows = state.select("start", "walk", "prev", "cur").join(hops, "cur").join(near, ["prev", "nxt"], "left")
        back, out = F.lit(p), F.lit(q)
        if own is not None:
            rows = rows.join(own.select(F.col("node").alias("cur"), F.col("p").alias("_p"), F.col("q").alias("_q")), "cur", "left")
            back, out = F.coalesce("_p", back), F.coalesce("_q", out)
        weight = F.when(F.col("nxt") == F.col("prev"), F.col("w") / back).when(F.col("_near"), F.col("w")).otherwise(F.col("w") / out)
        here = Window.partitionBy("start", "walk")
        rows = rows.withColumn("_x", weight).withColumns({"_c": F.sum("_x").over(here.orderBy("nxt").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_t": F.sum("_x").over(here)})
        u = uniform(seed, F.col("start"), F.col("walk"), F.lit(step))
        drawn = rows.where(F.col("_c") > u * 0.999999999 * F.col("_t")).groupBy("start", "walk").agg(F.min("nxt").alias("_n"))
        state = state.join(drawn, ["start", "walk"], "left").select("start", "walk", F.when(F.col("_n").isNotNull(), F.concat("path", F.array("_n"))).otherwise(F.col("path")).alias("path"), F.when(F.col("_n").isNotNull(), F.col("cur")).alias("prev"), F.col("_n").alias("cur"))
        if step % 5 == 0:
            state = written(state, "n2v-walks")
    return state.select("walk", "start", "path")


def surrogate_keys(ids: DataFrame, column: str = "node", length: int = 15) -> DataFrame:
    """column, key: a deterministic alphanumeric key; `duplicates` of the result must be empty, which key_conflicts tells."""
    return ids.select(column, F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, length).alias("key"))


def key_conflicts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def same_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: missing (in a, not in b), extra (in b, not in a)."""
    x, y = a.select("node").distinct(), b.select("node").distinct()
    return x.join(y, "node", "left_anti").agg(F.count(F.lit(1)).alias("missing")).join(y.join(x, "node", "left_anti").agg(F.count(F.lit(1)).alias("extra")))
