"""Hierarchical residual best-fit packing of token sequences.

Pieces are dealt to partitions of about ``ITEMS`` pieces, which are best-fit packed in
order of falling length. Bins with at most ``SLACK`` free tokens are final. All others go
on as single items: (bin, fill) rows, of which ``FAN`` partitions meet in one, or fewer
where more than ``ITEMS`` bins would, are best-fit packed again, and so on. A merged bin
has the id of its first item, so only bins that have moved leave a row, and pieces learn
their final place by one join at the end. The rounds end with one partition, or with a
round that has moved nothing.

Each round is a table in the shared folder. Only lengths are packed: a piece is its
place in a document, a length and the CRC of its ids.

Defined results: a null or empty text is the one token that ends a document; equal
rows are packed as rows of their own; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.tokens import Encoder
from coppice.plans.storage import materialize, table

WINDOW = 2048
END = b"\0\0\0\0"
ITEMS = 50_000
FAN = 8
SLACK = 20


def cut(total: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first is the shorter one."""
    first = (total - 1) % window + 1
    return [(0, first), *((s, window) for s in range(first, total, window))]


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + END
                for k, (s, n) in enumerate(cut(len(ids) // 4, window)):
                    at.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def best_fit(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, offset in it, fill of each bin).

    Bins are kept by free space; one bit per amount of space that some bin has
    finds the tightest fit.
    """
    bins, offsets, fill = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64), []
    by_space: list[list[int]] = [[] for _ in range(window + 1)]
    spaces = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        if fits := spaces >> size:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            space, b = window, len(fill)
            fill.append(0)
        bins[item], offsets[item] = b, fill[b]
        fill[b] += size
        if left := space - size:
            by_space[left].append(b)
            spaces |= 1 << left
    return bins, offsets, np.array(fill, dtype=np.int64)


def _packed_pieces(window: int):
    """Packs a partition's pieces; sets sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        rows = pa.Table.from_batches(held)
        bins, begins, _ = best_fit(rows["length"].to_numpy(), window)
        for name, values in {"sequence_id": (TaskContext.get().partitionId() << 32) + bins, "offset": begins}.items():
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
        yield from rows.to_batches(max_chunksize=10_000)

    return run


def _packed_bins(window: int):
    """(bin, fill) -> (bin, into, shift, fill): the bin that each goes into, itself if it is that bin's first item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        rows = pa.Table.from_batches(held)
        name, fill = rows["bin"].to_numpy(), rows["fill"].to_numpy()
        bins, begins, _ = best_fit(fill, window)
        first = np.empty(bins.max() + 1, dtype=np.int64)
        first[bins[begins == 0]] = name[begins == 0]
        out = pa.table({"bin": name, "into": first[bins], "shift": begins, "fill": fill})
        yield from out.to_batches(max_chunksize=50_000)

    return run


def moves(bins: DataFrame, parts: int, window: int = WINDOW) -> DataFrame | None:
    """bin, into, shift of the underfull bins (bin, fill) that the tree of rounds puts behind others."""
    total, left = None, materialize(bins, "open-bins")
    while parts > 1 and (n := left.count()):
        parts = max(-(-parts // FAN), -(-n // ITEMS))
        done = left.repartition(parts, "bin").mapInArrow(_packed_bins(window), "bin bigint, into bigint, shift bigint, fill bigint")
        done = materialize(done, "merged-bins")
        moved = done.where("shift > 0").select("bin", "into", "shift")
        if moved.isEmpty():
            return total
        if total is None:
            total = moved
        else:
            further = moved.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            carried = total.join(further, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            total = materialize(carried.union(moved), "moved-bins")
        left = done.groupBy(F.col("into").alias("bin")).agg(F.max(F.col("shift") + F.col("fill")).alias("fill")).where(F.col("fill") < window - SLACK)
        left = materialize(left, "open-bins")
    return total


def pack(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces with a `length` of at most `window` -> the same rows with sequence_id and offset."""
    zero = F.lit(0).cast("long")
    state, parts = items.select("*", zero.alias("sequence_id"), zero.alias("offset")), max(1, -(-items.count() // ITEMS))
    # Rows are dealt in turn, so equal rows don't meet in one partition.
    state = materialize(state.repartition(parts).mapInArrow(_packed_pieces(window), state.schema), "packed-pieces")
    fills = state.groupBy(F.col("sequence_id").alias("bin")).agg(F.max(F.col("offset") + F.col("length")).alias("fill"))
    moved = moves(fills.where(F.col("fill") < window - SLACK), parts, window)
    if moved is None:
        return state
    placed = state.join(moved.withColumnRenamed("bin", "sequence_id"), "sequence_id", "left")
    offset = F.col("offset") + F.coalesce("shift", F.lit(0))
    return placed.withColumns({"offset": offset, "sequence_id": F.coalesce("into", "sequence_id")}).select(*state.columns)


def packed(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    return pack(materialize(pieces(docs, window, tokenizer), "pieces"), window)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
