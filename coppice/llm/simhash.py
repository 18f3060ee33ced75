"""SimHash near-duplicate groups through a hierarchical Gray-order index.

Fingerprints within ``RADIUS`` differing bits agree on at least one of
``RADIUS + 1`` bit blocks. The upper nodes of the index are such blocks: a node is
a mask and the pattern its members share under it, factored out once for the whole
group. A node with more than ``LEAF`` fingerprints is split by the blocks of its
remaining bits, so leaves stay bounded whatever the data. Inside a node the
fingerprints stand in the order of their Gray rank; runs of ``FAN`` are folded into a
node with the bits that they share, runs of such nodes into the next, and bits that a
node above already has are left out below. A search adds up the differences to the
patterns on its way down and leaves out the whole run once they pass ``RADIUS``.

A leaf returns the edges of a spanning forest and never all pairs; the components
of these edges are the components of all links.

Defined results: a null or empty text and a text of white space alone have
fingerprint zero and link like any other; equal rows get equal results, one row
each; a null doc_id is never a component_id unless its component has no other;
further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.components import connected_components
from coppice.plans.storage import materialize, table

RADIUS = 2
LEAF = 2048
FAN = 32


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit; sums 255 rows of byte lanes at a time."""
    rows = -(-len(hashes) // 255) * 255
    padded = np.zeros(rows, dtype="<u8")
    padded[: len(hashes)] = hashes
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 255, 8)
    return bits.sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority bits over the XXH64 of all word shingles of UTF-8 data."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        spans = [(0, len(line))]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        spans = zip([0, *ends[: len(ends) - width]], (e - 1 for e in ends[width - 1 :]), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in spans], dtype="<u8")
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp BIGINT) of every document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x or b"", width) for x in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"]
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("data"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(compute, f"doc_id {kind}, text_hash bigint, fp bigint")


def gray_rank(fp):
    """Place of a code in the reflected Gray order, as an order-preserving signed long."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def blocks(bits: list[int], n: int = RADIUS + 1) -> list[list[int]]:
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def children(mask: int) -> list[int]:
    """The masks of a node's children: its own bits and one block of the others."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in block) for block in blocks(free) if block]


def fold(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of nodes over Gray-ordered codes, the codes themselves first: (masks, patterns).

    A node's mask are the bits that its codes share and no node above it has already; the
    masks on a way down are apart, so differences to their patterns add up.
    """
    shared, ones = [np.full(len(codes), 2**64 - 1, dtype=np.uint64)], codes
    zeros, patterns = ~codes, [codes]
    while len(ones) > FAN:
        starts = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
        shared.append(ones | zeros)
        patterns.append(ones)
    own = [mask & ~np.repeat(above, FAN)[: len(mask)] for mask, above in zip(shared, shared[1:], strict=False)]
    return list(zip([*own, shared[-1]], patterns, strict=True))


def links(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of codes within RADIUS differing bits; the codes stand in Gray order."""
    levels, n = fold(codes), len(codes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for begin in range(0, n, 256):
        at = np.arange(begin, min(n, begin + 256))
        top, at = len(levels) - 1, np.repeat(at, len(levels[-1][0]))
        node, apart = np.arange(len(at)) % len(levels[-1][0]), np.zeros(len(at), dtype=np.uint8)
        for depth in range(top, -1, -1):
            masks, patterns = levels[depth]
            if depth < top:
                at, apart, node = np.repeat(at, FAN), np.repeat(apart, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < len(masks)
                at, apart, node = at[inside], apart[inside], node[inside]
            apart = apart + np.bitwise_count((codes[at] ^ patterns[node]) & masks[node])
            near = apart <= RADIUS
            at, apart, node = at[near], apart[near], node[near]
        later = at < node
        found.append((at[later], node[later]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def forest(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: (code, root of its component) where they differ."""
    left, right = links(codes)
    root = np.arange(len(codes))
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(root, again := root[root]):
            root = again
        if np.array_equal(root, before):
            break
    moved = (root != np.arange(len(codes))).nonzero()[0]
    return codes[moved], codes[root[moved]]


def _leaf_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, pattern, fp) sorted by node and Gray rank -> forest edges (u, v)."""

    def edges(rows: np.ndarray) -> pa.RecordBatch | None:
        if not len(rows):
            return None
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)].nonzero()[0]
        sizes = np.diff(np.r_[new, len(rows)])
        codes = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        pairs = new[sizes == 2]
        near = pairs[np.bitwise_count(codes[pairs] ^ codes[pairs + 1]) <= RADIUS]
        u, v = [codes[near]], [codes[near + 1]]
        for start, size in zip(new[sizes > 2], sizes[sizes > 2], strict=True):
            a, b = forest(codes[start : start + size])
            u.append(a)
            v.append(b)
        u, v = np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"]) if len(u) else None

    rest = np.empty((0, 3), dtype=np.int64)
    for batch in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
        last = (rows[:, :2] != rows[-1, :2]).any(axis=1).nonzero()[0] if len(rows) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = rows[cut:]
        if (out := edges(rows[:cut])) is not None:
            yield out
    if (out := edges(rest)) is not None:
        yield out


def near_edges(fps: DataFrame) -> DataFrame:
    """Distinct fp -> edges (u, v) whose components are those of all links within RADIUS."""

    def under(rows: DataFrame, masks: list[int]) -> DataFrame:
        return rows.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))

    def nodes(rows: DataFrame) -> DataFrame:
        return rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")

    def search(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("gray", gray_rank(F.col("fp"))).repartition("mask", "pattern")
        ordered = dealt.sortWithinPartitions("mask", "pattern", "gray").select("mask", "pattern", "fp")
        return ordered.mapInArrow(_leaf_edges, "u bigint, v bigint")

    masks = children(0)
    level = nodes(under(fps, masks))
    out = None
    while True:
        heavy = materialize(level.groupBy("mask", "pattern").count().where(F.col("count") > LEAF), "heavy-nodes")
        found = search(level.join(heavy, ["mask", "pattern"], "left_anti"))
        out = found if out is None else out.union(found)
        if heavy.isEmpty():
            return out
        again = level.join(heavy, ["mask", "pattern"], "left_semi")
        split = F.create_map(
            *[x for m in masks for x in (F.lit(signed(m)), F.array(*[F.lit(signed(c)) for c in children(m)]))]
        )
        level = nodes(again.select("fp", F.explode(split[F.col("mask")]).alias("mask"))).distinct()
        masks = list(dict.fromkeys(c for m in masks for c in children(m)))


def components(each: DataFrame) -> DataFrame:
    """fp -> root, a fingerprint that stands for its component."""
    fps = materialize(each.select("fp").distinct(), "distinct-fingerprints")
    roots = connected_components(near_edges(fps))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    each = materialize(fingerprints(docs, width), "fingerprints")
    least_ids = each.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    joined = materialize(least_ids.join(components(each), "fp"), "rooted")
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labelled = joined.join(least, "root").select("fp", "component_id")
    return each.join(labelled, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents of the first (doc_id, text_hash) of every root, one row each; rows: root, doc_id, text_hash, n equal rows."""
    first = F.min(F.struct("doc_id", "text_hash", "n")).alias("first")
    kept = materialize(rows.groupBy("root").agg(first).select("first.*"), "kept-documents")
    kept = kept.withColumnsRenamed({"doc_id": "kept_id", "text_hash": "kept_hash"})
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    joined = keyed.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    if not kept.where("n > 1").isEmpty():
        joined = joined.where("n = 1").union(joined.where("n > 1").dropDuplicates(["id", "hash"]))
    return joined.select("row.*")


def one_of_each(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of every component, that of the smallest doc_id (null first), then text hash; all columns."""
    each = materialize(fingerprints(docs, width), "fingerprints")
    return first_rows(docs, each.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n")).join(components(each), "fp"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
