"""Connected components of an undirected edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.plans.storage import drop, materialize, measured


def _state() -> dict:
    return {"n": F.count("*"), "x": F.bit_xor(F.xxhash64("u", "v"))}


def _minimum(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of one orderable type -> (node, component), component = smallest node.

    Each round hooks every node's larger neighbours to its smallest neighbour
    (large star), then the smaller ones (small star). Rounds grow with the log of
    the longest path. Minima are aggregates and the rest is a join, so no list of
    neighbours is ever gathered in one row. Rows with a null end and self loops
    are ignored; nodes without an edge are not returned; an empty table gives an
    empty result.
    """
    clean = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    current, state = measured(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", **_state())
    while state["n"]:
        both = current.union(current.select("v", "u"))
        large = (
            both.join(_minimum(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        large = materialize(large, "large-star")
        low = _minimum(large)
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", "m"))
            .distinct()
        )
        before, (following, state) = state, measured(small, "small-star", **_state())
        drop(large)
        drop(current)
        current = following
        if state == before:
            break
    rooted = current.groupBy("u").agg(F.min("v").alias("component"))
    return rooted.select(F.col("u").alias("node"), "component").union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
