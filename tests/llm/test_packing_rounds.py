"""Residual packing: no bin is left out of the merging, and rounds end."""

import random
from collections import Counter, defaultdict

from coppice.llm import packing

rng = random.Random(3)


def packed(spark, monkeypatch, lengths, items):
    monkeypatch.setattr(packing, "ITEMS", items)
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack(rows, 100).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter(enumerate(lengths))
    place = defaultdict(list)
    for r in got:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in place.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 100
    return len(place)


def test_small_bins_of_all_partitions_meet(spark, monkeypatch):
    assert packed(spark, monkeypatch, [1] * 640, 10) <= 8


def test_bins_that_cannot_merge_end_the_rounds(spark, monkeypatch):
    assert packed(spark, monkeypatch, [60] * 300, 10) == 300


def test_many_rounds_come_near_the_bound(spark, monkeypatch):
    lengths = [rng.randint(1, 70) for _ in range(1500)]
    assert packed(spark, monkeypatch, lengths, 40) <= 1.06 * sum(lengths) / 100 + 1
