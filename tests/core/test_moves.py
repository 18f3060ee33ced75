"""Layers of paths and the order of moves."""

import re

import pytest
from pyspark.sql import functions as F

from coppice.operators import moves
from coppice.queries import Tables

LAYERS = {
    "src/components/Button.js": "ui", "src/views/use_x.tsx": "unknown", "src/App.tsx": "ui", "src/store.vue": "unknown", "src/hooks/a.ts": "app", "src/useThing.ts": "app", "src/use.ts": "unknown", "src/user.ts": "unknown", "src/core/a.rs": "kernel",
    "src/utils/a.ts": "infra", "src/a.test.ts": "test", "src/tests/a.py": "test", "a_test.go": "test", "src/plain.ts": "unknown", "SRC/API/x.ts": "infra", "src/services/ui/x.ts": "ui",
}


def test_layers(spark):
    rows = spark.createDataFrame([(p,) for p in LAYERS], "path string").select("path", moves.layer(F.col("path")).alias("l")).collect()
    assert {r["path"]: r["l"] for r in rows} == LAYERS


def test_order_phases_targets_and_shims(spark):
    files = spark.createDataFrame([("m/a.ts", 10), ("m/b.ts", 900), ("m/c.ts", 250), ("m/d.ts", 10), ("m/ui/ok.tsx", 10), ("m/views/e.tsx", 10), ("m/x.ts", 20), ("m/y.ts", 20), ("n/z.ts", 10)], "path string, loc long")
    edges = [("m/x.ts", "m/y.ts"), ("m/y.ts", "m/x.ts"), *((f"m/{k}.ts", "m/a.ts") for k in "bcdx"), ("m/d.ts", "m/views/e.tsx"), ("m/d.ts", "m/ui/ok.tsx"), ("m/d.ts", "core/k/core/q.ts"), ("n/z.ts", "m/a.ts")]
    frame = spark.createDataFrame([(*e, "import") for e in edges], "src string, dst string, label string")
    plan = moves.move_plan(files, frame).cache()
    got = {r["source"]: r for r in plan.collect()}
    assert [s for s, _ in sorted(((s, r["place"]) for s, r in got.items() if r["base"] == "m"), key=lambda x: x[1])] == ["m/d.ts", "m/views/e.tsx", "m/c.ts", "m/a.ts", "m/b.ts", "m/x.ts", "m/y.ts"]
    assert {s: (r["risk"], r["phase"]) for s, r in got.items()} == {
        "m/a.ts": ("medium", 2), "m/b.ts": ("high", 3), "m/c.ts": ("medium", 2), "m/d.ts": ("low", 1), "m/views/e.tsx": ("low", 1), "m/x.ts": ("high", 3), "m/y.ts": ("high", 3), "n/z.ts": ("low", 1),
    }
    assert got["m/d.ts"]["target"] == "m/ui/d.ts" and got["m/a.ts"]["target"] == "m/infra/a.ts" and got["m/x.ts"]["reason"] == "unclassified to infra, in a cycle" and got["m/views/e.tsx"]["reason"] == "misplaced"
    exports = spark.createDataFrame([("m/a.ts", "one"), ("m/a.ts", "two"), ("m/b.ts", "no"), ("m/a.ts", None)], "path string, name string")
    assert [tuple(r) for r in moves.shims(plan, exports).collect()] == [("m/a.ts", "m/infra/a.ts", ["one", "two"], 5)]


@pytest.mark.parametrize("n", [0])
def test_no_files(spark, n):
    none = spark.createDataFrame([], "path string, loc long")
    assert moves.move_plan(none, spark.createDataFrame([], "src string, dst string, label string")).count() == n


def test_layers_are_found_in_dealt_parts(spark, monkeypatch):
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(moves, "materialize", written, raising=False)
    t = Tables(spark, "/root/testdata/sf0.001")
    with pytest.raises(InterruptedError):
        moves.move_plan(t.dealt_files(), t.edges)
    # Patterns over paths were asked in the one task that reads the files.
    dealt = re.findall("REPARTITION_BY_NUM.*?Scan parquet", plans[0], re.S)
    assert dealt and not any("RLIKE" in part for part in dealt)
