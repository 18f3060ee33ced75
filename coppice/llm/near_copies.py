"""Near copies by Jaccard similarity of word shingles: candidates from the SimHash index and from MinHash, exact check.

A document is the set of its ``WIDTH``-word shingles; two are near copies at a
similarity of ``LEAST`` or more. The first candidates are those whose SimHash
fingerprints the Gray-order index finds within its radius. Fingerprints of documents at
a similarity of 0.8 differ in more bits than any index of bits can search (2 to 11 were
seen), so the others share one of ``BANDS`` bands of ``ROWS`` minima; at a similarity of
exactly 0.8 a pair shares none with probability (1 - 0.8 ** 4) ** 32, about 5 in
10 ** 8, and less above. Every link is checked on the shingles themselves.

Documents with equal sets are one node. A bucket first gives a star from its smallest
node; once these links are components, it gives its pairs across components, so a
large group of near copies has no pairs within.

Defined results: null, empty and white-space texts have the empty set and are near
copies of each other; of a component the row of the smallest doc_id (null first),
then text hash, stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.simhash import bit_counts, first_rows, near_edges
from coppice.plans.components import connected_components
from coppice.plans.storage import materialize

WIDTH = 5
LEAST = 0.8
ROWS = 4
BANDS = 32
#: Unequal sets of fewer shingles can't be near copies.
FEWEST = 4
FACTORS = np.random.default_rng(42).integers(0, 2**64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
PART = 4096


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted XXH64 of the distinct word shingles of UTF-8 data; the whole of a shorter text is one."""
    words = data.lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends[: max(0, len(ends) - width)]], (e - 1 for e in ends[min(width, len(ends)) - 1 :]), strict=True)
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b]) for a, b in spans], dtype="<u8"))


def bands(found: np.ndarray) -> list[int]:
    """A hash of every band of minima, as signed longs."""
    if len(found) < FEWEST:
        return []
    least = np.full(len(FACTORS), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(found), PART):
        np.minimum(least, (found[at : at + PART, None] * FACTORS).min(axis=0), out=least)
    data = least.tobytes()
    step = 8 * ROWS
    keys = [xxhash.xxh64_intdigest(data[k * step : (k + 1) * step], k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def node(found: np.ndarray) -> int:
    """A set's own hash, as a signed long."""
    value = xxhash.xxh64_intdigest(found.tobytes())
    return value - (1 << 64) if value >> 63 else value


def fingerprint(found: np.ndarray) -> int:
    """The majority bits of a set's hashes, as a signed long."""
    if not len(found):
        return 0
    return int(np.packbits(bit_counts(found) * 2 > len(found), bitorder="little").view("<i8")[0])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("data"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, fp and bands of every document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x or b"") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(map(node, sets), pa.int64()), pa.array(map(fingerprint, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "node", "fp", "bands"],
            )

    rows = _keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(compute, f"doc_id {kind}, text_hash bigint, node bigint, fp bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, each: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of some nodes, each from one of its documents."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x or b"") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(node, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    one = each.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    one = one.select(F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash"))
    rows = _keyed(docs).join(one, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("text_hash") == F.col("one_hash")), "left_semi")
    return rows.select("data").mapInArrow(compute, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def checked(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Of node pairs (u, v) those whose sets are similar."""
    side = lambda key, name: sets.select(F.col("node").alias(key), F.col("shingles").alias(name))
    rows = pairs.join(side("u", "su"), "u").join(side("v", "sv"), "v")
    small, large = F.least(F.size("su"), F.size("sv")), F.greatest(F.size("su"), F.size("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return rows.where((small >= large * least) & (both / (small + large - both) >= least)).select("u", "v")


def close_fingerprints(each: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) of nodes: of equal fingerprints, and of such as the index links; one node stands for a fingerprint."""
    nodes = each.select("fp", "node").distinct()
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "near-copy-fingerprints")
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    near = near_edges(heads.select("fp")).join(head("u"), "u").join(head("v"), "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    return materialize(same.union(near).distinct(), "near-copy-close")


def components(docs: DataFrame, each: DataFrame) -> DataFrame:
    """node -> component; nodes without a link are not returned."""
    close = close_fingerprints(each)
    members = each.select("node", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("most")).where("center < most").drop("most")
    members = materialize(members.join(shared, "band").distinct(), "near-copy-buckets")
    stars = members.where("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).union(close).distinct()
    wanted = members.select("node").union(close.select("u")).union(close.select("v")).distinct()
    sets = materialize(shingle_sets(docs, each, wanted), "near-copy-shingles")
    links = materialize(checked(stars, sets), "near-copy-stars")
    found = materialize(connected_components(links), "near-copy-components")
    labelled = members.join(found, "node", "left").select("band", "center", "node", F.coalesce("component", "node").alias("component"))
    split = labelled.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("band")
    rest = materialize(labelled.join(split, "band", "left_semi"), "near-copy-split-buckets")
    side = lambda n, c: rest.where("node <> center").select("band", F.col("node").alias(n), F.col("component").alias(c))
    across = side("u", "cu").join(side("v", "cv"), "band").where("u < v AND cu <> cv").select("u", "v").distinct()
    more = materialize(checked(across, sets), "near-copy-links")
    return found if more.isEmpty() else connected_components(links.union(more))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every component of near copies; all columns."""
    each = materialize(sketches(docs), "near-copy-sketches")
    found = components(docs, each).withColumnRenamed("node", "linked")
    counts = each.groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    rows = counts.join(found, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("component", "node"))
    return first_rows(docs, rows)
