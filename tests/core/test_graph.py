"""Traversals, components and cycles against brute force on random graphs, with nulls, loops and parallel edges."""

import random
from itertools import pairwise

import pytest

from coppice.operators import graph
from coppice.plans import traversal
from coppice.plans.components import connected_components
from coppice.plans.traversal import reach, strongly_connected

rng = random.Random(3)


def closure(edges):
    out = {a: set() for e in edges for a in e}
    for a, b in edges:
        out[a].add(b)
    reached = {}
    for start in out:
        todo, seen = list(out[start]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        reached[start] = seen
    return reached


@pytest.fixture(scope="module", params=[0, 1])
def edges(request):
    n = 14 + 10 * request.param
    pairs = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(n + 8)]
    return [*pairs, pairs[0], ("self", "self"), ("m1", "m2"), ("m2", "m1")]


@pytest.fixture(scope="module")
def frame(spark, edges):
    labels = ["import", "reexport", "lazy_import"]
    rows = [(a, b, labels[k % 3]) for k, (a, b) in enumerate(edges)] + [(None, "n01", "import"), ("n02", None, "import")]
    return spark.createDataFrame(rows, "src string, dst string, label string")


@pytest.mark.parametrize("small", [0, 2_000])
def test_strong_components(frame, edges, monkeypatch, small):
    monkeypatch.setattr(traversal, "SMALL", small)
    far = closure(edges)
    want = {a: min(b for b in far[a] if a in far[b]) for a in far if a in far[a]}
    assert {r["node"]: r["component"] for r in strongly_connected(frame).collect()} == want


def test_components(frame, edges):
    both = closure([*edges, *((b, a) for a, b in edges)])
    want = {a: min(both[a] | {a}) for a in both if both[a] - {a}}
    got = connected_components(frame.selectExpr("src AS u", "dst AS v"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_reach(spark, frame, edges):
    starts = sorted({a for a, _ in edges})[:6]
    seeds = spark.createDataFrame([(s, s) for s in starts], "source string, node string")
    got = {(r["source"], r["node"]): (r["depth"], r["chain"]) for r in reach(frame, seeds, chains=True).collect()}
    far = closure(edges)
    assert set(got) == {(s, x) for s in starts for x in far.get(s, set()) | {s}}
    real = set(edges)
    for (_, node), (depth, chain) in got.items():
        assert len(chain) == depth + 1 and chain[-1] == node and all(p in real for p in pairwise(chain))


def test_simple_cycles(frame, edges):
    real, want = set(edges), set()

    def walk(path):
        for a, b in real:
            if a == path[-1]:
                if b == path[0]:
                    want.add(">".join(path))
                elif b > path[0] and b not in path and len(path) < 4:
                    walk([*path, b])

    for start in {a for a, _ in edges}:
        walk([start])
    assert {r["cycle"] for r in graph.simple_cycles(frame, longest=4, each=1000).collect()} == want


def test_impact_and_who_imports(spark, frame, edges):
    target = edges[0][1]
    targets = spark.createDataFrame([(target,), ("absent",)], "path string")
    back = closure([(b, a) for a, b in edges])
    got = graph.impact(frame, targets).collect()
    assert {r["path"] for r in got} == back.get(target, set()) - {target} and all(r["target"] == target for r in got)
    assert graph.who_imports(frame, targets).where("target = 'absent'").count() == 0


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string, label string")
    assert strongly_connected(none).collect() == [] and graph.simple_cycles(none).collect() == []
    assert connected_components(none.selectExpr("src AS u", "dst AS v")).collect() == []
