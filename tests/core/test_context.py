"""Context of files on a small graph, and rows cut to a budget against a plain sum."""

import random

import pytest
from pyspark.sql import functions as F

from coppice.operators import context

EDGES = [("a", "t", "import"), ("b", "t", "reexport"), ("c", "b", "import"), ("t", "d", "import"), ("d", "e", "lazy_import"), ("e", "f", "import"), ("t", "t", "import"), ("a", "c", "import")]


@pytest.fixture(scope="module")
def tables(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, label string")
    files = spark.createDataFrame([(p, "ts", k + 1) for k, p in enumerate("abcdeft")], "path string, language string, loc long")
    imports = spark.createDataFrame([("a", "t", "run"), ("c", "b", "run"), ("c", "b", "other"), ("b", "t", "*"), ("a", "c", None)], "path string, resolved_path string, name string")
    exports = spark.createDataFrame([("t", "run", 9), ("t", "zoo", 2), ("t", None, 1), ("b", "run", None)], "path string, name string, line long")
    return edges, files, imports, exports


def test_context_of_one_file(spark, tables):
    edges, files, imports, exports = tables
    target = spark.createDataFrame([("t",), ("t",), ("gone",)], "path string")
    scope = context.context_files(edges, files, target)
    assert {tuple(r)[1:4] for r in scope.collect()} == {("t", "target", 0), ("d", "dependency", 1), ("e", "dependency", 2), ("a", "consumer", None), ("b", "consumer", None), ("c", "consumer", None)}
    links = {r["path"]: (r["kind"], r["imports_used"]) for r in context.consumer_links(edges, target, imports, exports).collect()}
    assert links == {"a": ("direct", ["run"]), "b": ("reexport", ["*"]), "c": ("transitive", ["run"])}
    risks = {r["path"]: (r["importers"], r["place"], r["high_fan_in"]) for r in context.context_risks(scope, edges).collect()}
    assert risks == {"t": (3, 1, False), "b": (1, 2, False), "c": (1, 3, False), "d": (1, 4, False), "e": (1, 5, False)}
    steps = sorted(tuple(r) for r in context.next_steps(target, edges, exports).collect())
    assert steps == [("gone", 1, "slice", "gone"), ("gone", 2, "follow", ""), ("t", 1, "slice", "t"), ("t", 2, "impact", "t"), ("t", 3, "body", "zoo"), ("t", 4, "literal", "zoo"), ("t", 5, "occurrences", "zoo"), ("t", 6, "follow", "")]


@pytest.mark.parametrize("parts", [1, 7])
def test_budget_is_handed_on(spark, monkeypatch, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    rng = random.Random(parts)
    rows = [(rng.choice(["x", "y", "z", "none"]), rng.randrange(30), f"p{k:03}", rng.randrange(1, 40)) for k in range(200)] + [("x", 99, "nocost", None)]
    shares, budget = {"x": 0.1, "y": 0.6, "z": 0.3}, 2500
    frame = spark.createDataFrame(rows, "section string, score int, path string, cost long")
    got = {(r["path"], r["through"]) for r in context.within_budget(frame, "section", [F.desc("score"), F.col("path")], "cost", budget, shares).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, carry = set(), 0
    for name, share in shares.items():
        limit, through = int(budget * share) + carry, 0
        for _, _, path, cost in sorted((r for r in rows if r[0] == name and r[3]), key=lambda r: (-r[1], r[2])):
            through += cost
            if through <= limit:
                want.add((path, through))
        carry = max(0, limit - through)
    assert got == want and context.within_budget(frame.limit(0), "section", [F.col("path")], "cost", budget, shares).collect() == []
