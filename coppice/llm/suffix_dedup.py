"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

**Suffixes.** Every string of ``MATCH`` bytes holds an anchor: the place, among its first
``SPREAD``, whose next 16 bytes have the smallest hash. Equal strings have equal anchors,
so suffixes are indexed at anchors only, about one place in a hundred. An entry stands in
the order of its suffix: by the leading 8 bytes, then by fingerprints of ever longer
parts (``SHORT`` bytes, ``DEPTH`` bytes, and all bytes that strings of this anchor can
reach). Neighbours in this order have the longest common parts, as in any suffix array.

**Family.** One pass over the texts writes all entries. Batches of them are added to a
family whose k-th level holds 2^k batches or none. A batch is sorted and merge-scanned
with every level: each entry is held against its neighbours, and what they have in common
is noted. Levels of equal rank become one of the next rank in the same scan, as a binary
counter carries. Shards are ranges of the order.

**Matches.** A place with the same reach as another is settled: all strings in it repeat.
Places that have ``DEPTH`` bytes in common with others and a reach of their own are
compared by bytes. The contexts of such a group stand in the order of the bytes from the
anchor on, and again in the order of the bytes before it, read backwards. Neighbours in
the two orders give the longest common parts on either side; strings of an anchor that
repeat cover an interval around it, so its two ends are all that is looked for. Where two
neighbours between them don't decide an end, the strings in question are compared in the
whole group. Groups of more than ``CROWD`` different contexts are never in one task:
their strings are counted by 128-bit hashes instead.

Hashes that decide anything have 64 bits beside 64 bits of leading text, or 128 bits.

Defined results: null is empty; texts shorter than ``MATCH`` bytes stay whole; equal
texts repeat each other, wholly, whatever their doc_id; rows are returned one for
one; further columns are ignored; an empty table gives an empty result. ``repeats`` says
that the text has ``SHORT`` bytes or more in common with another place; it finds every
common run of ``SPREAD + SHORT - 1`` bytes, removed or not.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.storage import drop, materialize, release, table

MATCH = 400
SPREAD = 200
LEFT = SPREAD - 1
DEPTH = MATCH - LEFT
SHORT = 101
BATCHES = 4
CROWD = 20_000
#: Rows of an Arrow batch, and texts that a task remembers to pass over their copies.
ROWS, SEEN = 20_000, 300_000
#: Crowded groups are broadcast up to this number.
BROADCAST_ROWS = 50_000
TEXT = ["text_hash", "n_bytes"]
ORDER = ["lead", "short", "fp", "reach", "text_hash", "at"]
ENTRY = "text_hash bigint, n_bytes int, lead bigint, short bigint, fp int, reach bigint, at int"
_A, _HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFF00000000)
_h64, _h128 = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest


def anchors(data: bytes) -> np.ndarray:
    """Sorted anchor places: of each window of SPREAD places the one with the smallest hash, the first of equal ones."""
    n, m = len(data), len(data) - SHORT + 1
    if m < SPREAD:
        return np.empty(0, dtype=np.int64)
    eight = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = eight[:m] * _A + eight[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h = (h * _A & _HIGH) | np.arange(m, dtype=np.uint64)
    rows = -(-m // SPREAD)
    padded = np.full(rows * SPREAD, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:m] = h
    grid = padded.reshape(rows, SPREAD)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = m - SPREAD + 1
    least = np.minimum(behind[:windows], ahead[SPREAD - 1 : SPREAD - 1 + windows]).astype(np.uint32).astype(np.int64)
    return least[np.r_[True, least[1:] != least[:-1]]]


def texts(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.xxhash64(data).alias("text_hash"), F.octet_length(data).alias("n_bytes"), data.alias("data"))


def _signed(values: array | np.ndarray) -> pa.Array:
    return pa.array(np.frombuffer(values, dtype=np.int64) if isinstance(values, array) else values.view(np.int64))


def thinned(places: np.ndarray, reaches: np.ndarray) -> np.ndarray:
    """Which anchors to index: of neighbours with equal reaches (in periodic text) the first, the last and one in MATCH bytes.

    Those repeat each other, and the reaches of the others lie in theirs.
    """
    keep = np.ones(len(places), dtype=bool)
    inner = (reaches[1:-1] == reaches[:-2]) & (reaches[1:-1] == reaches[2:])
    at = 0
    for k in (inner.nonzero()[0] + 1).tolist():
        if keep[k - 1]:
            at = places[k - 1]
        keep[k] = places[k + 1] - at > MATCH
    return keep


def entries(rows: DataFrame) -> DataFrame:
    """An entry of the suffix array for every anchor of every text; copies within a task are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at, places, leads, hashes = [], [], [], array("Q")

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                take, three = pa.array(np.repeat(at, [len(p) for p in places])), np.frombuffer(hashes, dtype=np.uint64).reshape(-1, 3).T
                columns = [
                    batch.column(0).take(take), batch.column(1).take(take), _signed(np.concatenate(leads) ^ np.uint64(1 << 63)), _signed(np.ascontiguousarray(three[0])),
                    pa.array(three[1].astype(np.uint32).view(np.int32)), _signed(np.ascontiguousarray(three[2])), pa.array(np.concatenate(places).astype(np.int32)),
                ]
                return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ENTRY.split(", ")])

            for row, (text_hash, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if size < SPREAD + SHORT - 1 or text_hash in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(text_hash)
                data = batch.column(2)[row].as_py()
                found = anchors(data)
                reaches = np.array([_h64(data[max(0, a - LEFT) : a + MATCH], min(a, LEFT)) for a in found.tolist()], dtype=np.uint64)
                if not (keep := thinned(found, reaches)).all():
                    found, reaches = found[keep], reaches[keep]
                leads.append(np.ndarray((size - 7,), dtype=">u8", buffer=data, strides=(1,))[found].astype(np.uint64))
                for a, reach in zip(found.tolist(), reaches.tolist(), strict=True):
                    hashes.extend((_h64(data[a : a + SHORT]), _h64(data[a : a + DEPTH]), reach))
                at.append(row)
                places.append(found)
                if len(hashes) >= 3 * ROWS:
                    yield made()
                    at, places, leads, hashes = [], [], [], array("Q")
            if at:
                yield made()

    return rows.mapInArrow(run, ENTRY)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan of sorted entries: what each has in common with its neighbours, and whether it is the first of its reach.

    common: 0 nothing, 1 SHORT bytes, 2 DEPTH bytes, 3 the whole reach. An entry of one
    place that stands there twice counts once. edge: first or last of the shard, with a
    neighbour in another one.
    """
    names = [*ORDER, "n_bytes", "kept"]

    def out(rows: np.ndarray, common: np.ndarray, first: np.ndarray, begins: bool = False, ends_: bool = False) -> pa.RecordBatch:
        edge = np.zeros(len(rows), dtype=bool)
        edge[: int(begins)] = edge[len(rows) - int(ends_) :] = True
        some = (rows[:, 7] != 0) | (common > 0) | edge
        rows, kinds = rows[some], {"fp": np.int32, "at": np.int32, "n_bytes": np.int32, "kept": np.bool_}
        columns = [pa.array(rows[:, k].astype(kinds.get(c, np.int64))) for k, c in enumerate(names)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(common[some].astype(np.int32)), pa.array(first[some]), pa.array(edge[some])], names=[*names, "common", "first", "edge"])

    held, over, begins = np.empty((0, len(names)), dtype=np.int64), 0, True  # the last rows, of which the first `over` are out already
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in names], axis=1)])
        same = rows[1:, :6] == rows[:-1, :6]
        new = np.r_[True, ~same.all(axis=1)]
        rows, same = rows[new], same[new[1:]]
        part = same[:, 0] & same[:, 1]
        behind = np.r_[0, part.astype(np.int64) + (part & same[:, 2]) + (part & same[:, 2] & same[:, 3])]
        if len(rows) - over > 1:
            yield out(rows[over:-1], np.maximum(behind[:-1], behind[1:])[over:], (behind < 3)[over:-1], begins)
            begins = False
        held, over = (rows[-2:], 1) if len(rows) > 1 else (rows, 0)
        last = behind[-1:]
    if len(held) > over:
        yield out(held[over:], last, last < 3, begins, True)


SCANNED = "lead bigint, short bigint, fp int, reach bigint, text_hash bigint, at int, n_bytes int, kept boolean, common int, first boolean, edge boolean"


def scanned(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """A table of the entries in the order of their suffixes, and those of them that have something in common with a neighbour.

    Shards are ranges of the order, so that the entries of a hot suffix have many; what
    stands on both sides of a shard's end, two entries a shard, is scanned by itself.
    """
    done = materialize(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_neighbours, SCANNED), name)
    edges = done.where("edge").select(*ORDER, "n_bytes", F.lit(False).alias("kept"))
    met = edges.repartition(1).sortWithinPartitions(*ORDER).mapInArrow(_neighbours, SCANNED)
    return done, done.where("common > 0").union(met.where("common > 0"))


class SuffixFamily:
    """Levels of suffix arrays, of which the k-th holds 2^k batches or none."""

    def __init__(self) -> None:
        self.levels: list[DataFrame | None] = []
        self.tables: list[DataFrame] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of entries; all entries, new or old, that then have something in common with another."""
        rank = next((k for k, level in enumerate(self.levels) if level is None), len(self.levels))
        rows = batch.withColumn("kept", F.lit(True))
        for k, level in enumerate(self.levels):
            if level is not None:
                rows = rows.unionByName(level.withColumn("kept", F.lit(k < rank)))
        done, found = scanned(rows, "suffix-array")
        self.tables.append(done)
        self.levels[: rank + 1] = [None] * rank + [done.where("kept").select(*ORDER, "n_bytes")]
        return found.select(*ORDER, "n_bytes")

    def drop(self) -> None:
        for one in self.tables:
            drop(one)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of rows."""
    apart = a != b
    return np.minimum(np.where(apart.any(axis=1), apart.argmax(axis=1), a.shape[1]), most)


def _grid(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(-1, width), np.array([len(p) for p in parts])


def ends(left: list[bytes], right: list[bytes], settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far repeated strings reach before and after each anchor of a group in suffix order; -1 where none repeats."""
    m = len(left)
    back = [x[::-1] for x in left]
    before, n_before = _grid(back, LEFT)
    after, n_after = _grid(right, MATCH)
    begin, end = np.full(m, -1), np.full(m, -1)
    most = [np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)]
    orders = np.arange(m), np.array(sorted(range(m), key=back.__getitem__))
    for side, order in enumerate(orders):
        i, j = order[:-1], order[1:]
        lr = _common(after[i], after[j], np.minimum(n_after[i], n_after[j])), _common(before[i], before[j], np.minimum(n_before[i], n_before[j]))
        repeated = lr[0] + lr[1] >= MATCH
        for one in (i, j):
            most[side][one] = np.maximum(most[side][one], lr[side])
            end[one[repeated]] = np.maximum(end[one[repeated]], lr[0][repeated])
            begin[one[repeated]] = np.maximum(begin[one[repeated]], lr[1][repeated])
    furthest, earliest = most
    doubt = (~settled & (earliest + furthest >= MATCH) & ((begin < earliest) | (end < furthest))).nonzero()[0]
    asked: dict[int, list[int]] = {}
    for x in doubt.tolist():
        low, high = MATCH - int(furthest[x]), int(earliest[x])
        for d in range(low, high + 1):
            if d > begin[x] or MATCH - d > end[x]:
                asked.setdefault(d, []).append(x)
    for d, places in asked.items():
        # Strings that could be equal stand together in suffix order.
        has = ((n_before >= d) & (n_after >= MATCH - d)).nonzero()[0].tolist()
        strings = {x: left[x][len(left[x]) - d :] + right[x][: MATCH - d] for x in has}
        times = Counter(strings.values())
        for x in places:
            if times[strings[x]] > 1:
                begin[x], end[x] = max(begin[x], d), max(end[x], MATCH - d)
    return begin, end


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in the order of (lead, fp, right) -> the spans of strings that repeat, a group at a time."""

    def spans(group: list[tuple]) -> tuple[list, list, list, list]:
        _, _, text_hash, size, at, settled, left, right = zip(*group, strict=True)
        begin, end = ends(list(left), list(right), np.array(settled))
        some = ((begin >= 0) & ~np.array(settled)).nonzero()[0].tolist()
        return [text_hash[k] for k in some], [size[k] for k in some], [at[k] - int(begin[k]) for k in some], [at[k] + int(end[k]) for k in some]

    group: list[tuple] = []
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[:2] != group[-1][:2]:
                if len(group) > 1:
                    for held, more in zip(out, spans(group), strict=True):
                        held += more
                group = []
            if not group or row[2:5] != group[-1][2:5]:
                group.append(row)
        if out[0]:
            yield _spans(out)
    if len(group) > 1:
        yield _spans(spans(group))


def _spans(columns: tuple[list, ...]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int32(), pa.int32(), pa.int32()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*TEXT, "begin", "end"])


def _beside_text(rows: DataFrame, places: DataFrame, start: Callable[[], Callable[[bytes, dict], None]], schema: str) -> DataFrame:
    """Rows from each text and its places, (lead, fp, at, settled); copies within a task are passed over.

    start: called with the lists to fill, column by column, beside the text's own two; what
    it returns is called with a text and one of its places.
    """
    names = [*TEXT, *(c.split()[0] for c in schema.split(", "))]
    listed = places.groupBy(*(F.col(c).alias(f"of_{c}") for c in TEXT)).agg(F.collect_list(F.struct("lead", "fp", "at", "settled")).alias("places"))
    joined = rows.join(listed, (F.col("text_hash") == F.col("of_text_hash")) & (F.col("n_bytes") == F.col("of_n_bytes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        types = [pa.int64(), pa.int32(), *(kinds[c.split()[1]] for c in schema.split(", "))]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            add = start(columns)
            for row, text_hash in enumerate(batch.column(0).to_pylist()):
                if text_hash in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(text_hash)
                data, size = batch.column(2)[row].as_py(), batch.column(1)[row].as_py()
                for place in batch.column(3)[row].as_py():
                    had = len(columns[2])
                    add(data, place)
                    columns[0] += [text_hash] * (len(columns[2]) - had)
                    columns[1] += [size] * (len(columns[2]) - had)
                    if len(columns[0]) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)
                        for c in columns:
                            c.clear()
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)

    return joined.select(*TEXT, "data", "places").mapInArrow(run, f"text_hash bigint, n_bytes int, {schema}")


def _contexts(columns: list[list]):
    def add(data: bytes, place: dict) -> None:
        a = place["at"]
        for held, value in zip(columns[2:], (place["lead"], place["fp"], a, place["settled"], data[max(0, a - LEFT) : a], data[a : a + MATCH]), strict=True):
            held.append(value)

    return add


def _strings(columns: list[list]):
    def add(data: bytes, place: dict) -> None:
        a = place["at"]
        for d in range(max(0, a + MATCH - len(data)), min(LEFT, a) + 1):
            h = _h128(data[a - d : a - d + MATCH])
            for held, value in zip(columns[2:], ((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), a - d), strict=True):
                held.append(value)

    return add


def compared(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Spans (text, begin, end) of repeated strings of places that are not settled, by their bytes."""
    reps = found.where("common > 1 AND first").select(*TEXT, "lead", "fp", "at", (F.col("common") == 3).alias("settled"))
    groups = reps.groupBy("lead", "fp").agg(F.count("*").alias("n"), F.bool_and("settled").alias("all_settled"))
    groups = groups.where("n > 1 AND NOT all_settled").select("lead", "fp", (F.col("n") > CROWD).alias("crowded"))
    open_ = materialize(reps.join(groups, ["lead", "fp"]), "open-places")
    contexts = _beside_text(rows, open_.where("NOT crowded"), _contexts, "lead bigint, fp int, at int, settled boolean, left binary, right binary")
    ordered = contexts.select("lead", "fp", *TEXT, "at", "settled", "left", "right").repartition("lead", "fp").sortWithinPartitions("lead", "fp", "right", "text_hash", "at")
    spans = materialize(ordered.mapInArrow(_decided, "text_hash bigint, n_bytes int, begin int, end int"), "compared-spans")
    if open_.where("crowded").isEmpty():
        return spans
    strings = materialize(_beside_text(rows, open_.where("crowded"), _strings, "h bigint, h2 bigint, begin int"), "crowded-strings")
    place = F.struct("text_hash", "begin")
    often = strings.groupBy("h", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("h", "h2")
    repeated = strings.join(often, ["h", "h2"], "left_semi").select(*TEXT, "begin", (F.col("begin") + MATCH).alias("end"))
    return spans.union(materialize(repeated.distinct(), "crowded-spans"))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, upto = begin[order], np.maximum.accumulate(end[order])
    starts = np.r_[True, begin[1:] > upto[:-1]].nonzero()[0]
    return begin[starts], upto[np.r_[starts[1:], len(begin)] - 1]


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Per text that has something in common with another: text_hash, n_bytes and its repeated (begin, end) spans."""
    rows, family = texts(docs), SuffixFamily()
    every = materialize(entries(rows), "suffixes")
    found = None
    for k in range(batches):
        more = family.add(every.where(F.pmod("text_hash", F.lit(batches)) == k))
        found = more if found is None else found.union(more)
    found = materialize(scanned(found.withColumn("kept", F.lit(False)), "common-suffixes")[1], "found-suffixes")
    drop(every)
    family.drop()
    release(docs.sparkSession)
    begin, end = F.greatest(F.col("at") - LEFT, F.lit(0)), F.least(F.col("at") + MATCH, "n_bytes")
    span = lambda condition, begin, end: F.when(condition & (end - begin >= MATCH), F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end")))
    settled = found.select(*TEXT, span(F.col("common") == 3, begin, end).alias("span"))
    copies = rows.groupBy(*TEXT).agg(F.count("*").alias("n")).where(F.col("n") > 1).where(F.col("n_bytes") >= SPREAD + SHORT - 1)
    copies = copies.select(*TEXT, span(F.lit(True), F.lit(0), F.col("n_bytes")).alias("span"))
    spans = compared(rows, found).select(*TEXT, F.struct("begin", "end").alias("span"))
    release(docs.sparkSession)
    return settled.union(copies).union(spans).groupBy(*TEXT).agg(F.collect_set("span").alias("spans"))


def removed(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Every document's bytes without its repeated strings: doc_id, n_bytes, kept, n_removed, n_spans and repeats."""
    found = repeated_spans(docs, batches).withColumnsRenamed({"text_hash": "found_hash", "n_bytes": "found_bytes"})
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", data.alias("data"), F.xxhash64(data).alias("text_hash"), F.octet_length(data).alias("n_bytes"))
    joined = keyed.join(found, (keyed["text_hash"] == found["found_hash"]) & (keyed["n_bytes"] == found["found_bytes"]), "left")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            kept, n_removed, n_spans, texts_, spans = [], [], [], batch.column(1), batch.column(2)
            begin, end = (spans.values.field(c).to_numpy() for c in ("begin", "end"))
            places = spans.offsets.to_numpy()
            for row in range(batch.num_rows):
                data, own = texts_[row].as_py(), slice(places[row], places[row + 1])
                starts, ends_ = merged(begin[own], end[own])
                cuts = [0, *np.stack([starts, ends_], axis=1).ravel().tolist(), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                n_removed.append(len(data) - len(kept[-1]))
                n_spans.append(len(starts))
            sizes = pa.array([a + b for a, b in zip(n_removed, map(len, kept), strict=True)], pa.int64())
            columns = [batch.column(0), sizes, pa.array(kept, pa.binary()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), spans.is_valid()]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "kept", "n_removed", "n_spans", "repeats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "data", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, kept binary, n_removed bigint, n_spans bigint, repeats boolean"
    )


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = removed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "repeats")
