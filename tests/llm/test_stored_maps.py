"""Slot maps over several runs, the law of equal bytes, and revisits that lead nowhere."""

import random
from collections import Counter, defaultdict

import pytest

from coppice.llm import sharding, warc

rng = random.Random(9)


def test_bytes_are_nearly_equal_and_a_hot_text_is_spread(spark):
    rows = [(k, "hot " * 40 if k % 3 == 0 else "x" * rng.randint(0, 400)) for k in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= max(r["size"] for r in got)


def test_a_later_run_edits_the_stored_map(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    frame = lambda n: spark.createDataFrame([(k, "y" * (k % 300)) for k in range(n)], "doc_id long, text string")
    first = {r["doc_id"]: r for r in sharding.shard(frame(3000), map_path=path).collect()}
    again = {r["doc_id"]: r for r in sharding.shard(frame(3000), map_path=path).collect()}
    assert {r["map_version"] for r in first.values()} == {r["map_version"] for r in again.values()} == {2}
    assert all(again[k]["shard"] == r["shard"] for k, r in first.items())
    more = {r["doc_id"]: r for r in sharding.shard(frame(3600), map_path=path).collect()}
    assert {r["map_version"] for r in more.values()} == {3}
    assert all(more[k]["virtual_slot"] == r["virtual_slot"] for k, r in first.items())
    assert sum(more[k]["shard"] != r["shard"] for k, r in first.items()) < 0.5 * len(first)
    places = defaultdict(list)
    for r in more.values():
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    versions = spark.read.parquet(path)
    assert {r["version"] for r in versions.select("version").distinct().collect()} == {1, 2, 3}
    with pytest.raises(ValueError, match="no map"):
        sharding.newest_map(spark, path, 16, 64)


def test_records_of_text_ids_and_broken_references(spark):
    long = "<p>" + "z" * 200
    pages = spark.createDataFrame([("b/ü >", None, long), ("a b", None, long), ("c", None, "")], "page_id string, url string, html string")
    rows = warc.round_trip(pages)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows.collect()} == {("a b", "response", None), ("b/ü >", "revisit", "a b"), ("c", "response", None)}
    assert warc.broken_references(rows).isEmpty()
    assert warc.broken_references(rows.where("page_id <> 'a b'")).count() == 1


def test_null_and_empty_ids_of_records_stay_apart(spark):
    long = "<p>" + "q" * 200
    pages = spark.createDataFrame([("", None, long), ("x", None, long), (None, None, "own " + long), (":", None, "")], "page_id string, url string, html string")
    rows = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert rows == {("", "response", None), ("x", "revisit", ""), (None, "response", None), (":", "response", None)}
