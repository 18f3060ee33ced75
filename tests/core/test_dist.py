"""Source maps, bundle classes and manifests."""

import json

from pyspark.sql import functions as F

from coppice.operators import dist
from coppice.sources import extract


def encode(value):
    number, out = (abs(value) << 1) | (value < 0), ""
    while True:
        digit, number = number & 31, number >> 5
        out += dist.DIGITS[digit | (32 if number else 0)]
        if not number:
            return out


def test_numbers_of_segments(spark):
    rows = [[0], [1, -1, 15, 16], [-16, 31, 32, -1000, 123456], [2**20, 0, -(2**20), 7]]
    df = spark.createDataFrame([("".join(map(encode, r)),) for r in rows] + [("",)], "s string")
    assert [r[0] for r in df.select(dist.vlq(F.col("s"))).collect()] == [*rows, []]


def test_sources_of_chunks_and_classes(spark):
    segment = lambda *n: "".join(map(encode, n))
    boot = {"version": 3, "sources": ["a.ts", "b.ts"], "mappings": f"{segment(0, 0, 0, 0)},{segment(4, 1, 0, 0)};{segment(2)},{segment(0, -1, 1, 0)}"}
    feature = {"version": 3, "sources": ["b.ts", "c.ts"], "mappings": f";{segment(0, 1, 0, 0)},{segment(3, -1, 0, 0)}"}
    maps = spark.createDataFrame([("boot.js", json.dumps(boot)), ("feature.js", json.dumps(feature)), ("broken.js", "{")], "chunk string, content string")
    covered = dist.covered_sources(maps).cache()
    assert {tuple(r) for r in covered.collect()} == {("boot.js", "a.ts", 2), ("boot.js", "b.ts", 1), ("feature.js", "c.ts", 1), ("feature.js", "b.ts", 1)}
    chunks = spark.createDataFrame([("boot.js", True), ("feature.js", False)], "chunk string, boot boolean")
    exports = spark.createDataFrame([("a.ts",), ("b.ts",), ("c.ts",), ("d.ts",)], "path string")
    edges = spark.createDataFrame([("a.ts", "b.ts", "lazy_import")], "src string, dst string, label string")
    got = {r["path"]: r["class"] for r in dist.bundle_classes(exports, covered, chunks, edges).collect()}
    assert got == {"a.ts": "boot_path_only", "b.ts": "fake_lazy", "c.ts": "feature_local", "d.ts": "dead_in_all_chunks"}
    alone = dist.bundle_classes(exports, covered, chunks.limit(1), edges)
    assert {r["class"] for r in alone.collect()} == {"verify_first", "dead_in_all_chunks"}


def test_manifests(spark):
    package = {"name": "app", "version": "1", "main": "index.js", "scripts": {"t": "x"}, "dependencies": {"react": "1", "left": "2"}}
    texts = spark.createDataFrame([("w/package.json", json.dumps(package)), ("x/package.json", "{broken"), ("Cargo.toml", ""), ("Dockerfile", "ENV KEY=1")], "path string, content string")
    got = {r["path"]: (r["name"], r["scripts"], r["dependencies"]) for r in extract.packages(texts).collect()}
    assert got == {"w/package.json": ("app", 1, 2), "x/package.json": (None, 0, 0)}
    assert {r["framework"] for r in extract.frameworks(texts).collect()} == {"react", "rust", "node"}
    assert [r["name"] for r in extract.extract(texts).where("kind = 'dockerfile'").collect()] == ["KEY"]
