"""Alignment of the tokens of two tokenizers by merge-path partitioning.

Both tokenizers read the same bytes, so each gives a rising sequence of token ends, and
aligning them is merging two sorted sequences. The merge of a block of texts is a path
through the grid of both sequences; diagonals `LANE` steps apart cut it into pieces of
equal work, and a binary search on each diagonal finds where the path crosses it. The
pieces are independent: they are merged in step, as lanes of one vector walk, and each
emits its order of tokens and the places where two tokens end together. The groups that
are open where a piece begins or ends are stitched by a prefix sum of the pieces' ends.

Links are counted corpus-wide in two steps: per document in the task that aligned it,
then by pair. Pairs with at least `total / HEAVY` links number at most `HEAVY`; these are
broadcast, and the others, of which each has few rows, meet their links in a shuffle join.

Ids come from a memo of words: in both vocabularies no token goes on behind a space that
stands alone (checked when they are loaded). A text with other runs of spaces goes to
both tokenizers whole.

Defined results: a null or empty text, and one whose joined tokens are not its own bytes
behind a space, has no tokens, zeros and an empty string; equal rows are aligned as rows
of their own; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.storage import materialize, measured, table

#: Steps of the merge that a lane takes; bytes of text that are aligned at once; words that are remembered.
LANE, BLOCK, MEMO = 256, 2 << 20, 300_000
#: Pairs that are broadcast at most.
HEAVY = 500_000
#: A token is `bytes << ID_BITS | id`; a pair of ids is `a << ID_BITS | b`.
ID_BITS = 20
ID = (1 << ID_BITS) - 1


class Words:
    """Word -> packed tokens of both tokenizers, with the space before it."""

    def __init__(self, ranks_path: str | None = None, model_path: str | None = None):
        import sentencepiece
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on behind a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_code = np.zeros(max(ranks.values()) + 1, dtype=np.uint32)
        for token, rank in ranks.items():
            self.a_code[rank] = len(token) << ID_BITS | rank
        self.b_code = np.array([len(x) << ID_BITS | k for k, x in enumerate(self.b_bytes)], dtype=np.uint32)
        self.names = [str(k) for k in range(max(len(self.a_code), len(self.b_code)))]
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}

    def whole(self, text: str) -> tuple[bytes, bytes] | None:
        """The packed tokens of a text; None if they aren't its bytes behind a space."""
        ids = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, ids)) != b" " + text.encode():
            return None
        return self.a_code[self.a.encode_ordinary(" " + text)].tobytes(), self.b_code[ids].tobytes()

    def learn(self, new: list[str]) -> None:
        """Remember words of no white space at their ends; they are encoded as one text and told apart by their bytes."""
        text = " ".join(new)
        if (packed := self.whole(text)) is None:
            return
        ends = np.cumsum([len(w.encode()) + 1 for w in new])
        for known, side in ((self.known_a, packed[0]), (self.known_b, packed[1])):
            behind = np.searchsorted(np.cumsum(np.frombuffer(side, dtype=np.uint32) >> ID_BITS, dtype=np.int64), ends) * 4 + 4
            begins = [0, *behind[:-1].tolist()]
            known.update(zip(new, map(side.__getitem__, map(slice, begins, behind.tolist())), strict=True))

    def packed(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The packed tokens of texts; none where whole() has none."""
        if len(self.known_a) > MEMO:
            self.known_a.clear()
            self.known_b.clear()
        split, out = [t.split(" ") for t in texts], []
        new = set().union(*split).difference(self.known_a)
        if new := [w for w in new if w and len(w) <= 64 and "▁" not in w and not w[0].isspace() and not w[-1].isspace()]:
            self.learn(new)
        for text, parts in zip(texts, split, strict=True):
            try:
                out.append((b"".join(map(self.known_a.__getitem__, parts)), b"".join(map(self.known_b.__getitem__, parts))))
            except KeyError:  # other runs of spaces, odd or long words
                out.append((self.whole(text) if text else None) or (b"", b""))
        return out


@cache
def words(ranks_path: str | None, model_path: str | None) -> Words:
    """The tokenizers and their memo, once in a worker."""
    return Words(ranks_path, model_path)


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """Per diagonal i + j the number i of elements that a merge has taken from a; equal elements are taken from a first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        takes = np.zeros(len(low), dtype=bool)
        takes[open_] = a[middle[open_]] <= b[diagonals[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & takes, middle + 1, low), np.where(open_ & ~takes, middle, high)
    return low


def merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two rising sequences of ends -> the indices in a and in b of all equal ends, and their number per piece of the path."""
    total = len(a) + len(b)
    diagonals = np.arange(0, total, LANE)
    i = crossings(a, b, diagonals)
    j = diagonals - i
    # Beyond the ends of a sequence nothing is smaller than what the other one still has.
    far = np.int64(1) << 62
    a, b = np.append(a, far), np.append(b, far)
    meets = np.zeros((LANE, len(diagonals)), dtype=bool)
    at_b = np.empty((LANE, len(diagonals)), dtype=np.int64)
    for k in range(LANE):
        from_a = a[i] <= b[j]
        # The end of b may equal one that the lane before has taken from a.
        meets[k] = ~from_a & (i > 0) & (a[i - 1] == b[j]) & (j < len(b) - 1)
        at_b[k] = j
        i, j = np.minimum(i + from_a, len(a) - 1), np.minimum(j + ~from_a, len(b) - 1)
    per_piece = meets.sum(axis=0)
    found = at_b.T[meets.T]
    return np.searchsorted(a, b[found]), found, per_piece


class Block:
    """The alignment of some texts: counts, group strings and links of each."""

    def __init__(self, texts: list[str], tokens: Words):
        packed = tokens.packed(texts)
        a, b = (np.frombuffer(b"".join(side), dtype=np.uint32) for side in zip(*packed, strict=True))
        self.n_a, self.n_b = (np.array([len(x) // 4 for x in side]) for side in zip(*packed, strict=True))
        ends = [np.cumsum(x >> ID_BITS, dtype=np.int64) for x in (a, b)]
        self.a, self.b = (a & ID).astype(np.int64), (b & ID).astype(np.int64)
        i, j, per_piece = merge(*ends)
        # A piece's groups are numbered from the ends that all pieces before it have found.
        self.first_group = np.cumsum(per_piece) - per_piece
        self.i, self.j = i, j
        self.of = np.searchsorted(np.cumsum(self.n_a), i, side="right")
        self.n_groups = np.bincount(self.of, minlength=len(texts))
        self.names = tokens.names

    def strings(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of every text."""
        out = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        # A token stands behind all of its own kind before it and the other kind's of earlier groups (a) or also its own (b).
        group_a = np.searchsorted(self.i, np.arange(len(self.a)))
        group_b = np.searchsorted(self.j, np.arange(len(self.b)))
        before = np.concatenate([[0], self.j + 1])
        kind = len(self.names)
        out[np.arange(len(self.a)) + before[group_a]] = self.a
        out[np.arange(len(self.b)) + (self.i + 1)[group_b]] = self.b
        # The separator behind a token: a comma, a bar behind a group's last a, a semicolon behind its last b.
        out[self.i + before[:-1]] += kind
        out[self.j + self.i + 1] += 2 * kind
        table_ = _separated(kind)
        ends = np.cumsum(self.n_a + self.n_b)
        return ["".join(map(table_.__getitem__, out[e - n : e].tolist()))[:-1] for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist(), strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets per text, pair, times) of the different links of every text."""
        pairs, times = np.unique((self.of << (2 * ID_BITS)) | (self.a[self.i] << ID_BITS) | self.b[self.j], return_counts=True)
        offsets = np.searchsorted(pairs, np.arange(len(self.n_a) + 1) << (2 * ID_BITS))
        return offsets, pairs & ((1 << (2 * ID_BITS)) - 1), times


@cache
def _separated(n: int) -> list[str]:
    return [f"{k}{mark}" for mark in ",|;" for k in range(n)]


def _aligned(ranks_path: str | None, model_path: str | None, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = words(ranks_path, model_path)
        for batch in batches:
            size = batch.column(2).cast(pa.large_binary()).fill_null(b"")
            ends = np.cumsum(pa.compute.binary_length(size).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                done = int(ends[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
                part = batch.slice(begin, end - begin)
                block = Block([t or "" for t in part.column(2).to_pylist()], tokens)
                strings = block.strings()
                offsets, pairs, times = block.links()
                links = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs), pa.array(times)], names=["pair", "times"]))
                hashes = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings]
                columns = [part.column(0), part.column(1), *map(pa.array, (block.n_a, block.n_b, block.n_groups)), pa.array(hashes), links]
                names = ["doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(strings)] if keep else [])], names=[*names, *(["groups"] if keep else [])])
                begin = end

    return run


def aligned(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, row, n_a, n_b, n_groups, groups_sha256 and links (pair, times) of every document; keep: also the groups' string."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<struct<pair:bigint,times:bigint>>"
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(_aligned(ranks_path, model_path, keep), schema + (", groups string" if keep else ""))


def link_counts(links: DataFrame) -> DataFrame:
    """pair, links and whether no pair of the same b has more, of every linked pair of ids; links: rows (pair, times)."""
    counts = materialize(links.groupBy("pair").agg(F.sum("times").alias("links")), "link-counts")
    b = F.col("pair").bitwiseAND(ID)
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    # One row per id of the second vocabulary.
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def scored(rows: DataFrame, total: int, heavy: int = HEAVY) -> DataFrame:
    """The rows of aligned(), already written, with n_links, n_best and count_sum; total: the links of all rows."""
    links = rows.select("row", F.explode("links").alias("l")).select("row", "l.pair", "l.times")
    counts = materialize(link_counts(links), "counted-links")
    least = total // heavy + 1
    summed = lambda df: df.groupBy("row").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum")
    )
    frequent, rare = counts.where(F.col("links") >= least), counts.where(F.col("links") < least)
    sums = summed(links.join(F.broadcast(frequent), "pair"))
    if least > 1:
        others = links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rare.hint("merge"), "pair")
        sums = sums.unionByName(summed(others)).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(sums, "row", "left").select(*rows.drop("links", "row").columns, zero("n_links"), zero("n_best"), zero("count_sum"))


def token_alignment(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None, heavy: int = HEAVY, keep: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best and count_sum of every document."""
    rows, seen = measured(aligned(docs, ranks_path, model_path, keep), "aligned", total=F.sum("n_groups"))
    return scored(rows, seen["total"] or 0, heavy)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))
