"""What grows with the input stays out of the driver and out of single tasks."""

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__  # noqa: F401  (registers all queries)
from coppice.plans import storage, sweeps
from coppice.queries import QUERIES, Tables
from coppice.sources import lexing

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sarif_results", "exact_twins", "sniff", "idiom_free_twins", "zombies", "callers", "dead_truth", "structural_defects", "health_score", "lexed_places"])
def test_no_join_is_broadcast_by_a_guess(spark, name):
    assert "BroadcastHashJoin" not in _plan(QUERIES[name](spark, SF))


def test_definitions_know_their_ends(spark):
    plan = _plan(QUERIES["symbol_bodies"](spark, SF))
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_texts_of_one_partition_are_dealt_out(spark):
    rows = spark.range(8).selectExpr("concat('f', id, '.ts') AS path", "'let a = 1' AS content").coalesce(1)
    assert "hashpartitioning(path" in _plan(lexing.lexed(rows))
    assert lexing.lexed(rows).count() == 8


def test_copies_of_edges_do_not_grow_with_the_sources(spark, monkeypatch):
    monkeypatch.setattr(sweeps, "SHIFT", 0)
    steps = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    count = lambda first, steps: pa.table({"n": [steps.num_rows]})
    rows = sweeps._by_blocks(steps.select("a"), steps, count, "n long").collect()
    assert 1 < len(rows) <= sweeps.GROUPS and {r["n"] for r in rows} == {200}


def test_runs_sweep_what_they_reach():
    rng = np.random.default_rng(7)
    src, dst = rng.integers(0, 5000, (2, 4500))
    src, dst = src[src != dst], dst[src != dst]
    first = pa.table({"a": src, "b": dst})
    got = {r["id"]: (r["direct"], r["dependents"], r["deepest"]) for r in sweeps._counted(first, pa.table({"p": src, "q": dst})).to_pylist()}
    after = {}
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        after.setdefault(a, set()).add(b)
    want = {}
    for a in after:
        seen, frontier, depth = {a}, {a}, 0
        while frontier := {y for x in frontier for y in after.get(x, ())} - seen:
            seen, depth = seen | frontier, depth + 1
            for x in frontier:
                direct, dependents, deepest = want.get(x, (0, 0, 0))
                want[x] = direct + (depth == 1), dependents + 1, max(deepest, depth)
    assert got == want


@pytest.mark.parametrize(("asked", "got"), [("10485760b", storage.BROADCAST), ("64MB", storage.BROADCAST), ("300k", 300 << 10), ("-1", -1)])
def test_what_a_join_sends_is_bounded(spark, monkeypatch, asked, got):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", asked)
    for _ in range(2):
        Tables(session, SF)
        assert session.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == str(got) and session.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
