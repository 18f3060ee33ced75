"""Cycles and re-export chains of any length."""

import pytest

from coppice.operators import graph, symbols

SCHEMA = "src string, dst string, label string"


def ring(name, n):
    return [(f"{name}{k:02}", f"{name}{(k + 1) % n:02}", "import") for k in range(n)]


def test_cycles_of_any_length(spark):
    many = [(f"m{a}", f"m{b}", "import") for a in range(5) for b in range(5) if a != b]
    edges = spark.createDataFrame([*ring("r", 6), *ring("s", 9), ("s00", "s08", "import"), *many], SCHEMA)
    got = [(r["cycle"], r["length"]) for r in graph.simple_cycles(edges).collect()]
    assert (">".join(f"r{k:02}" for k in range(6)), 6) in got
    assert {c for c, _ in got if c[0] == "s"} == {"s00>s08", ">".join(f"s{k:02}" for k in range(9))}
    assert sorted(n for c, n in got if c[0] == "m") == [2] * 10


@pytest.mark.parametrize("n", [3, 30])
def test_chains_of_any_length(spark, n):
    steps = [(f"c{k:02}", f"c{k + 1:02}", "reexport") for k in range(n)]
    loop = [("x", "y", "reexport"), ("y", "z", "reexport"), ("z", "w", "reexport"), ("w", "x", "reexport")]
    got = {r["src"]: (r["chain"], r["steps"]) for r in symbols.reexport_chains(spark.createDataFrame([*steps, *loop], SCHEMA)).collect()}
    assert got["c00"] == (">".join(f"c{k:02}" for k in range(n + 1)), n)
    assert got["x"] == ("x>y>z>w", 3) and len(got) == 4 + n - 2
