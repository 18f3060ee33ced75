"""Breadth-first reachability and strongly connected components as DataFrame loops.

All sources are walked at once: a round is one join of the frontier with the edges
and an anti join with what was reached. Every round is written to the shared folder,
so plans stay short and a lost executor costs one round's tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.plans.storage import materialize, measured
from coppice.plans.sweeps import mutual

#: Rounds of a walk that stay tables of their own before they are put together.
ROUNDS = 8
#: Edges of which components are found by bitsets within tasks.
SMALL = 200_000


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def reach(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, through: Callable[[DataFrame], DataFrame] | None = None, chains: bool = False
) -> DataFrame:
    """(source, node) seeds over (src, dst) edges -> source, node, depth of first discovery, seeds at 0.

    through: what of a frontier may be walked on from. chains: also the smallest of the
    shortest chains, as an array of nodes. A node is expanded once a source, so cycles
    end. Null ends never match; seeds without edges are returned at depth 0. Rounds go on
    until nothing new is found, or to max_depth if one is asked for.
    """
    # Written, since every round reads it and would make it again.
    steps = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "steps")
    chain = {"chain": F.array("node")} if chains else {}
    frontier = materialize(seeds.select("source", "node").distinct().select("*", F.lit(0).alias("depth"), *(c.alias(k) for k, c in chain.items())), "frontier")
    reached = [frontier]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        walked = (through(frontier) if through else frontier).join(steps, F.col("node") == F.col("src"))
        if chains:
            found = walked.select("source", F.col("dst").alias("node"), F.array_append("chain", F.col("dst")).alias("chain"))
            found = found.groupBy("source", "node").agg(F.min("chain").alias("chain"))
        else:
            found = walked.select("source", F.col("dst").alias("node")).distinct()
        if len(reached) > ROUNDS:
            reached = [materialize(_union(reached), "reached")]
        fresh = found.join(_union(reached).select("source", "node"), ["source", "node"], "left_anti")
        frontier, seen = measured(fresh.select("source", "node", F.lit(depth).alias("depth"), *chain), "frontier", n=F.count("*"))
        if not seen["n"]:
            break
        reached.append(frontier)
    return _union(reached)


def trim(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges between nodes that have both an incoming and an outgoing edge, and their number; cycles stay whole.

    Repeated while more than SMALL are left and a round takes away a twentieth or more: rounds get cheaper, colours don't. The rest is left to what follows.
    """
    current, seen = measured(edges, "untrimmed", n=F.count("*"))
    while seen["n"] > SMALL:
        kept = current.join(current.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(current.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        before, (current, seen) = seen, measured(kept, "trimmed", n=F.count("*"))
        if seen["n"] > 0.95 * before["n"]:
            break
    return current, seen["n"]


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every component of more than one node, or of a node with an edge to itself.

    Colouring: the smallest label flows forward until it rests; nodes of a colour that
    reach the colour's root backward are its component; the others go round again. What is
    left of at most SMALL edges is swept by bitsets in both directions, in one job.
    """
    clean = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    loops = clean.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    (rest, n), found = trim(clean.where("src <> dst")), []
    while n > SMALL:
        state = {"x": F.bit_xor(F.xxhash64("node", "color"))}
        color, seen = measured(rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct().withColumn("color", F.col("node")), "colors", **state)
        while True:
            pushed = rest.join(color, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "color")
            lower = color.select("node", "color").union(pushed).groupBy("node").agg(F.min("color").alias("color"))
            before, (color, seen) = seen, measured(lower, "colors", **state)
            if seen == before:
                break
        inside = rest.join(color.select(F.col("node").alias("src"), F.col("color").alias("c1")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("c2")), "dst")
        backward = materialize(inside.where("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "one-color")
        roots = color.where("node = color").select(F.col("node").alias("source"), "node")
        group = materialize(reach(backward, roots).select("node", F.col("source").alias("component")), "components")
        found.append(group.join(group.groupBy("component").count().where("count > 1"), "component", "left_semi").select("node", "component"))
        gone = group.select("node")
        left = rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        rest, n = trim(left.select("src", "dst"))
    if n:
        found.append(mutual(rest))
    grouped = _union([*found, loops])
    return grouped.groupBy("node").agg(F.min("component").alias("component"))
