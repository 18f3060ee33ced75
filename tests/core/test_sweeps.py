"""Counts of dependents by bitsets against a walk from every node."""

import random

import pytest

from coppice.operators import graph
from coppice.plans import storage, sweeps, traversal

rng = random.Random(11)


def walked(first, steps):
    """node -> (direct, dependents, deepest), a breadth-first walk per source."""
    on, begin = {}, {}
    for a, b in steps:
        if a != b and None not in (a, b):
            on.setdefault(a, set()).add(b)
    for a, b in first:
        if a != b and None not in (a, b):
            begin.setdefault(a, set()).add(b)
    out = {}
    for source, nodes in begin.items():
        depth, frontier, seen = 1, set(nodes), {source}
        while frontier := frontier - seen:
            seen |= frontier
            for node in frontier:
                n, m, d = out.get(node, (0, 0, 0))
                out[node] = (n + (depth == 1), m + 1, max(d, depth))
            frontier = {b for a in frontier for b in on.get(a, ())}
            depth += 1
    return out


def ring(n):
    return [(f"r{k:03}", f"r{(k + 1) % n:03}") for k in range(n)]


def chain(n):
    return [(f"c{k:03}", f"c{k + 1:03}") for k in range(n)]


def grid(n):
    return [(f"g{x:02}{y:02}", f"g{x + dx:02}{y + dy:02}") for x in range(n) for y in range(n) for dx, dy in ((0, 1), (1, 0)) if x + dx < n and y + dy < n]


GRAPHS = {
    "chain": chain(150), "grid": grid(13), "ring": ring(70), "mixed": chain(40) + grid(6) + ring(9) + [("c010", "r003"), ("r005", "g0000"), ("g0505", "c001"), ("x", "x"), (None, "c001"), ("c001", None)],
    "random": [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(360)],
}


#: As tables a round is a job, so this graph is shallow.
SMALL = grid(4) + ring(5) + [("g0303", "r001"), ("g0000", "g0303"), ("x", "x"), (None, "r001"), ("r001", None)]


@pytest.mark.parametrize(("name", "bound"), [*((n, sweeps.EDGES) for n in GRAPHS), ("small", -1)])
def test_dependents(spark, monkeypatch, name, bound):
    monkeypatch.setattr(sweeps, "SHIFT", 5)
    monkeypatch.setattr(sweeps, "WORDS", 400)
    monkeypatch.setattr(sweeps, "MOVED", 32)
    edges = GRAPHS.get(name, SMALL)
    frame = spark.createDataFrame([*edges, edges[0]], "src string, dst string")
    got = sweeps.dependents(frame.selectExpr("*", "true AS `on`"), bound).collect()
    assert {r["node"]: tuple(r)[1:] for r in got} == walked(edges, edges)


def test_importers_through_some_edges_only(spark):
    edges = [(a, b, rng.choice(["import", "reexport", "reexport"])) for a, b in GRAPHS["random"]]
    frame = spark.createDataFrame(edges, "src string, dst string, label string")
    files = spark.createDataFrame([(f"n{k:03}",) for k in range(250)], "path string")
    want = {k: v[1] for k, v in walked([e[:2] for e in edges], [e[:2] for e in edges if e[2] == "reexport"]).items() if k < "n250"}
    assert {r["target"]: r["importers"] for r in graph.transitive_importers(frame, files).collect()} == want
    by_pairs = graph.who_imports(frame, files).groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in by_pairs} == want


def test_no_edges(spark):
    none = spark.createDataFrame([("a", "a"), (None, "b")], "src string, dst string")
    for bound in (sweeps.EDGES, -1):
        assert sweeps.dependents(none.selectExpr("*", "true AS `on`"), bound).collect() == []
    assert sweeps.mutual(none).collect() == []


def test_cycles_within_blocks_and_across(spark, monkeypatch):
    monkeypatch.setattr(sweeps, "SHIFT", 3)
    monkeypatch.setattr(sweeps, "WORDS", 200)
    edges = ring(70) + chain(20) + [("c003", "c001"), ("c019", "c015"), ("c010", "r000")]
    got = {r["node"]: r["component"] for r in sweeps.mutual(spark.createDataFrame(edges, "src string, dst string")).collect()}
    want = {f"r{k:03}": "r000" for k in range(70)} | {f"c{k:03}": "c001" for k in range(1, 4)} | {f"c{k:03}": "c015" for k in range(15, 20)}
    assert got == want


def test_files_with_and_without_dependents(spark):
    frame = spark.createDataFrame([*chain(12), ("c003", "c001"), (None, "c001")], "src string, dst string")
    targets = spark.createDataFrame([("c012",), ("c002",), ("none",)], "path string")
    rows = lambda df: {r["target"]: (r["direct"], r["dependents"], r["deepest"]) for r in df.collect()}
    assert rows(graph.all_impact_counts(frame, targets)) == rows(graph.impact_counts(frame, targets)) == {"c012": (1, 12, 12), "c002": (1, 3, 2), "none": (0, 0, 0)}


def test_walk_from_starts(spark, monkeypatch):
    edges = GRAPHS["mixed"]
    labelled = spark.createDataFrame([(a, b, "lazy_import" if b in ("c001", "r003") else "import") for a, b in edges], "src string, dst string, label string")
    rows = lambda: {(r["path"], r["depth"]) for r in graph.dynamic_reach(labelled).collect()}
    within = rows()
    monkeypatch.setattr(graph, "reached", lambda *a: None)
    assert within == rows() and ("c001", 0) in within and len(within) > 60
    starts = spark.createDataFrame([("only",), (None,)], "node string")
    assert [tuple(r) for r in sweeps.reached(labelled.limit(0), starts).collect()] == [("only", 0)]
    assert sweeps.reached(labelled, starts, bound=3) is None


def test_steps_of_a_walk_are_made_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(traversal, "materialize", lambda df, name: written.append(name) or storage.materialize(df, name))
    walked = []
    monkeypatch.setattr(traversal, "measured", lambda df, name, **m: walked.append(df._jdf.queryExecution().optimizedPlan().toString()) or storage.measured(df, name, **m))
    edges = spark.createDataFrame(ring(3), "src string, dst string")
    rows = traversal.reach(edges, spark.createDataFrame([("r000", "r000")], "source string, node string"), chains=True).collect()
    assert {(r["node"], r["depth"], tuple(r["chain"])) for r in rows} == {("r000", 0, ("r000",)), ("r001", 1, ("r000", "r001")), ("r002", 2, ("r000", "r001", "r002"))}
    # Rounds removed double edges anew, a shuffle of all edges each.
    assert written.count("steps") == 1 and len(walked) == 3 and not any("LogicalRDD" in plan for plan in walked)
