"""Counts over all ways of a graph without a row per pair: sweeps of bitsets.

Every node holds one bit per source that reaches it. A round pushes the bits that are
new along the edges and ORs what meets in a node, so 64 sources move with one word and
their number is a population count. Blocks of sources are dealt to at most GROUPS groups;
a group has its own copy of the edges, as long as these are at most EDGES by count, and
sweeps a run of sources over the part of the graph that the run reaches. Beyond EDGES
the same rounds are made of tables of (node, word, bits), ORed by Spark's `bit_or`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.plans.storage import drop, materialize, measured

#: Edges that a task may hold; 6.5 million took a task 760 MB in all.
EDGES = 8_000_000
#: Sources of a block, and of a run within a task, are 2^SHIFT neighbours in the order of nodes.
SHIFT = 11
#: Groups that blocks are dealt to, and copies of the edges, at most: copies grow with the edges alone.
GROUPS = 32
#: Words of the bitsets that a task has at once, and words that a round moves at once.
WORDS, MOVED = 1 << 22, 1 << 21


def numbered(nodes: DataFrame) -> DataFrame:
    """Rows (node) -> (node, id), written; ids rise with the nodes, neighbours in order have neighbouring ids."""
    ordered = nodes.select("node").where("node IS NOT NULL").distinct().repartitionByRange("node").sortWithinPartitions("node")
    return materialize(ordered.withColumn("id", F.monotonically_increasing_id()), "numbered")


def _with_ids(edges: DataFrame, name: str, *more: str) -> tuple[DataFrame, DataFrame, dict]:
    """(src, dst) nodes -> (node, id); (a, b) ids, written, with their number."""
    rows = edges.where("src <> dst").select("src", "dst", *more)
    names = numbered(rows.select(F.col("src").alias("node")).union(rows.select("dst")))
    side = lambda c, to: names.select(F.col("node").alias(c), F.col("id").alias(to))
    found = rows.join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("a", "b", *more)
    return names, *measured(found, name, n=F.count("*"))


class Graph:
    """Edges inside a task, in the order of their ends, and the rounds of bits over them."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        order = np.argsort(dst, kind="stable")
        self.src, self.dst, self.n = src[order], dst[order], n

    def rounds(self, frontier: np.ndarray, seen: np.ndarray) -> Iterator[np.ndarray]:
        """The new bits of every round, the first ones included; seen grows along."""
        frontier = frontier & ~seen
        while (active := frontier.any(axis=1)).any():
            seen |= frontier
            yield frontier
            edges = np.flatnonzero(active[self.src])
            following = np.zeros_like(frontier)
            step = max(1, MOVED // frontier.shape[1])
            for at in range(0, len(edges), step):
                some = edges[at : at + step]
                to = self.dst[some]
                first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                following[to[first]] |= np.bitwise_or.reduceat(frontier[self.src[some]], first, axis=0)
            frontier = following & ~seen


def _bits(rows: np.ndarray, sources: np.ndarray, n: int, width: int) -> np.ndarray:
    """A bitset per node with the bits of (node, source) rows."""
    out = np.zeros((n, width), dtype=np.uint64)
    np.bitwise_or.at(out, (rows, sources >> 6), np.left_shift(np.uint64(1), (sources & 63).astype(np.uint64)))
    return out


def _parts(sources: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sources in runs whose bitsets fit."""
    width = max(1, min(len(sources) // 64 + 1, WORDS // max(1, n)))
    for at in range(0, len(sources), 64 * width):
        yield sources[at : at + 64 * width]


class Ways:
    """Edges inside a task by their beginnings, to find the part of the graph that some nodes reach."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        self.dst, self.starts = dst[np.argsort(src, kind="stable")], np.searchsorted(np.sort(src), np.arange(n + 1))
        self.seen = np.zeros(n, dtype=bool)

    def out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both ends of the edges that leave nodes."""
        many = self.starts[nodes + 1] - self.starts[nodes]
        at = np.repeat(self.starts[nodes] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(nodes, many), self.dst[at]

    def reach(self, nodes: np.ndarray) -> np.ndarray:
        """nodes and all that edges lead to from them, in order."""
        found, new = [], np.unique(nodes)
        while len(new):
            self.seen[new] = True
            found.append(new)
            to = self.out(new)[1]
            new = np.unique(to[~self.seen[to]])
        out = np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        self.seen[out] = False
        return out


def _runs(sources: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted sources in runs of neighbours."""
    for at in range(0, len(sources), 1 << SHIFT):
        yield sources[at : at + (1 << SHIFT)]


def _counted(first: pa.Table, steps: pa.Table) -> pa.Table:
    """Per node of a group: direct, dependents, deepest."""
    if not steps.num_rows:  # a side without rows has no columns
        steps = pa.table({"p": pa.array([], pa.int64()), "q": pa.array([], pa.int64())})
    source, node = first["a"].to_numpy(), first["b"].to_numpy()
    order = np.argsort(source, kind="stable")
    source, node = source[order], node[order]
    src, dst = steps["p"].to_numpy(), steps["q"].to_numpy()
    ids = np.unique(np.concatenate([node, src, dst]))
    ways = Ways(np.searchsorted(ids, src), np.searchsorted(ids, dst), len(ids))
    at, out = np.searchsorted(ids, node), np.zeros((3, len(ids)), dtype=np.int64)
    for run in _runs(np.unique(source)):
        here = slice(np.searchsorted(source, run[0]), np.searchsorted(source, run[-1], side="right"))
        local = ways.reach(at[here])
        graph = Graph(*(np.searchsorted(local, x) for x in ways.out(local)), len(local))
        for some in _parts(run, len(local)):
            mine = slice(np.searchsorted(source, some[0]), np.searchsorted(source, some[-1], side="right"))
            width = (len(some) + 63) >> 6
            own = np.searchsorted(ids[local], some)
            there = (own < len(local)) & (ids[local][np.minimum(own, len(local) - 1)] == some)
            seen = _bits(own[there], np.flatnonzero(there), len(local), width)
            begin = _bits(np.searchsorted(local, at[mine]), np.searchsorted(some, source[mine]), len(local), width)
            for depth, frontier in enumerate(graph.rounds(begin, seen), 1):
                found = np.bitwise_count(frontier).sum(axis=1, dtype=np.int64)
                out[1][local] += found
                hit = local[found > 0]
                out[2][hit] = np.maximum(out[2][hit], depth)
                if depth == 1:
                    out[0][local] += found
    rows = np.flatnonzero(out[1])
    return pa.table({"id": ids[rows], "direct": out[0][rows], "dependents": out[1][rows], "deepest": out[2][rows]})


def _mutual(sources: pa.Table, steps: pa.Table) -> pa.Table:
    """Per node the smallest source of a group that it reaches and that reaches it, itself left out."""
    src, dst = steps["p"].to_numpy(), steps["q"].to_numpy()
    ids = np.unique(np.concatenate([src, dst]))
    src, dst = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    ahead, back = Ways(src, dst, len(ids)), Ways(dst, src, len(ids))
    best = np.full(len(ids), -1, dtype=np.int64)
    for run in _runs(np.unique(sources["a"].to_numpy())):
        # A cycle through a source lies in what the run reaches and what reaches the run.
        begins = np.searchsorted(ids, run)
        local = np.intersect1d(ahead.reach(begins), back.reach(begins), assume_unique=True)
        a, b = ahead.out(local)
        kept = np.isin(b, local)
        a, b = np.searchsorted(local, a[kept]), np.searchsorted(local, b[kept])
        both = [Graph(a, b, len(local)), Graph(b, a, len(local))]
        for some in _parts(run, len(local)):
            begin = _bits(np.searchsorted(local, np.searchsorted(ids, some)), np.arange(len(some)), len(local), (len(some) + 63) >> 6)
            reached = []
            for graph in both:
                seen = np.zeros_like(begin)
                for _ in graph.rounds(begin, seen):
                    pass
                reached.append(seen)
            shared = reached[0] & reached[1] & ~begin
            rows = np.flatnonzero(shared.any(axis=1))
            word = (shared[rows] != 0).argmax(axis=1)
            low = shared[rows, word]
            bit = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            smallest, to = some[word * 64 + bit], local[rows]
            best[to] = np.where(best[to] < 0, smallest, np.minimum(best[to], smallest))
    rows = np.flatnonzero(best >= 0)
    return pa.table({"id": ids[rows], "other": best[rows]})


def _walked(starts: pa.Table, steps: pa.Table) -> pa.Table:
    """id and depth of every node that steps lead to from a start, starts at 0."""
    begin, src, dst = (t[c].to_numpy() if t.num_rows else np.zeros(0, dtype=np.int64) for t, c in ((starts, "a"), (steps, "p"), (steps, "q")))
    ids = np.unique(np.concatenate([begin, src, dst]))
    graph, depths = Graph(np.searchsorted(ids, src), np.searchsorted(ids, dst), len(ids)), np.full(len(ids), -1, dtype=np.int64)
    frontier = np.zeros((len(ids), 1), dtype=np.uint64)
    frontier[np.searchsorted(ids, begin)] = 1
    for depth, new in enumerate(graph.rounds(frontier, np.zeros_like(frontier))):
        depths[new[:, 0] > 0] = depth
    rows = np.flatnonzero(depths >= 0)
    return pa.table({"id": ids[rows], "depth": depths[rows]})


def _by_blocks(first: DataFrame, steps: DataFrame, run, schema: str) -> DataFrame:
    """run(rows of a group's sources, all steps) for every group of blocks of sources."""
    block = F.pmod(F.xxhash64(F.shiftright("a", SHIFT)), F.lit(GROUPS)).cast("long")
    blocks = [r["block"] for r in first.select(block.alias("block")).distinct().collect()]
    # New names, since both sides come of one table.
    everywhere = steps.select(F.explode(F.array(*map(F.lit, blocks)).cast("array<bigint>")).alias("of"), F.col("a").alias("p"), F.col("b").alias("q"))
    return first.withColumn("block", block).groupBy("block").cogroup(everywhere.groupBy("of")).applyInArrow(run, schema)


def _swept(first: DataFrame, steps: DataFrame) -> DataFrame:
    """As _counted over tables, a round a job: id, direct, dependents, deepest."""
    bit = lambda c: F.expr(f"shiftleft(1L, CAST({c} % 64 AS INT))")
    frontier = first.where("a <> b").groupBy(F.col("b").alias("id"), F.shiftright("a", 6).alias("word")).agg(F.bit_or(bit("a")).alias("bits"))
    frontier, seen = measured(frontier, "bits", n=F.count("*"))
    reached, counts, old = frontier, [], []
    for depth in count(1):
        if not seen["n"]:
            break
        counts.append(materialize(frontier.groupBy("id").agg(F.sum(F.bit_count("bits")).cast("long").alias("n")).withColumn("depth", F.lit(depth)), "bit-counts"))
        pushed = frontier.join(steps.select(F.col("a").alias("id"), "b"), "id").groupBy(F.col("b").alias("id"), "word").agg(F.bit_or("bits").alias("more"))
        own = F.when(F.shiftright("id", 6) == F.col("word"), bit("id")).otherwise(0)
        known = F.coalesce("bits", F.lit(0)).bitwiseOR(own)
        fresh = pushed.join(reached, ["id", "word"], "left").select("id", "word", F.col("more").bitwiseAND(F.bitwise_not(known)).alias("bits")).where("bits <> 0")
        frontier, seen = measured(fresh, "bits", n=F.count("*"))
        before, reached = reached, materialize(reached.unionByName(frontier).groupBy("id", "word").agg(F.bit_or("bits").alias("bits")), "reached-bits")
        old.append(before)
    for table in old:
        drop(table)
    rows = counts[0].limit(0) if counts else first.select(F.col("b").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("depth")).limit(0)
    for table in counts:
        rows = rows.unionByName(table)
    return rows.groupBy("id").agg(F.sum(F.when(F.col("depth") == 1, F.col("n")).otherwise(0)).alias("direct"), F.sum("n").alias("dependents"), F.max("depth").cast("long").alias("deepest"))


def dependents(edges: DataFrame, bound: int = EDGES) -> DataFrame:
    """src, dst and `on` rows -> node, direct, dependents, deepest of every node that has any.

    dependents: different sources that have an edge to the node, or to a node from which
    edges that are `on` lead to it, itself left out; direct: those with an edge to it;
    deepest: the most edges that the nearest way of a dependent has. Null ends and edges of
    a node to itself are ignored, parallel ones count once.
    """
    once = edges.groupBy("src", "dst").agg(F.max("on").alias("on"))
    names, rows, seen = _with_ids(once, "numbered-edges", "on")
    first, steps = rows.select("a", "b"), rows.where("on").select("a", "b")
    if seen["n"] <= bound:
        found = _by_blocks(first, steps, _counted, "id long, direct long, dependents long, deepest long")
        found = found.groupBy("id").agg(F.sum("direct").alias("direct"), F.sum("dependents").alias("dependents"), F.max("deepest").alias("deepest"))
    else:
        found = _swept(first, steps)
    return found.join(names, "id").select("node", "direct", "dependents", "deepest")


def mutual(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that lies on a cycle with others; for edges of at most EDGES rows."""
    names, rows, _ = _with_ids(edges.distinct(), "cyclic-steps")
    found = _by_blocks(rows.select("a").distinct(), rows, _mutual, "id long, other long").groupBy("id").agg(F.min("other").alias("other"))
    named = found.select("id", F.least("id", "other").alias("component")).join(names, "id").select("node", "component")
    return named.join(names.select(F.col("id").alias("component"), F.col("node").alias("first")), "component").select("node", F.col("first").alias("component"))


def reached(edges: DataFrame, starts: DataFrame, bound: int = EDGES) -> DataFrame | None:
    """node and depth of every node that edges (src, dst) lead to from the starts (node), which stand at 0; None for more than bound edges.

    One source is one bit, so one task walks the edges.
    """
    clean, begin = edges.select("src", "dst").where("src <> dst").distinct(), starts.select("node").where("node IS NOT NULL").distinct()
    names = numbered(clean.select(F.col("src").alias("node")).union(clean.select("dst")).union(begin))
    side = lambda c, to: names.select(F.col("node").alias(c), F.col("id").alias(to))
    steps, seen = measured(clean.join(side("src", "p"), "src").join(side("dst", "q"), "dst").select(F.lit(0).alias("of"), "p", "q"), "walked-edges", n=F.count("*"))
    if seen["n"] > bound:
        return None
    first = begin.join(names, "node").select(F.lit(0).alias("block"), F.col("id").alias("a"))
    found = first.groupBy("block").cogroup(steps.groupBy("of")).applyInArrow(_walked, "id long, depth long")
    return found.join(names, "id").select("node", "depth")
