"""Fill-in-middle transformation with a sparse index of multibyte characters.

A text is cut in two places that lie between tokens (`[A-Za-z]+|[^A-Za-z]`) and written
as prefix-suffix-middle (psm) or suffix-prefix-middle (spm) with a marker before each
part. Cuts are found in the bytes of the UTF-8 column, where a letter is one byte and a
character starts at each byte that continues none. Between bytes and code points only
the characters of more than one byte matter: `Exceptions` keeps their places and the
bytes that they have in excess, so a conversion is a binary search among the exceptions
and a subtraction; a span of ASCII has no entry at all.

A batch of rows is worked on as one byte array; no text is decoded in Python. Restoring
is native, from the output and the form alone.

Defined results: a null or empty text is plain with no tokens; a text that contains a
marker is plain; equal rows give equal outputs but for their doc_id; a null doc_id
counts as no digits; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.storage import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, so many are transformed, and so many of these as spm.
TRANSFORMED, SPM = 90, 20
#: Bytes of text that are worked on at once.
BLOCK = 4 << 20


class Exceptions:
    """Places and excess bytes of the characters of more than one byte in UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))])
        #: The code points before each exception.
        self.chars = self.at - self.excess[:-1]

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before byte offsets that lie between characters."""
        return cuts - self.excess[np.searchsorted(self.at, cuts)]

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        """Bytes before a number of code points."""
        return chars + self.excess[np.searchsorted(self.chars, chars)]


def token_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens start; rows: offsets at which texts start, where no run of letters goes on."""
    letter = ((data | 32) - np.uint8(97)) < 26
    after = np.zeros(len(data), dtype=bool)
    after[1:] = letter[:-1]
    after[rows[rows < len(data)]] = False
    return np.flatnonzero(np.where(letter, ~after, (data & 0xC0) != 0x80))


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of runs of rows of about BLOCK bytes, at least one row each."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK, side="right")) - 1)
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def _cut(data: np.ndarray, rows: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, code points of prefix and of middle, and the two byte cuts of every text."""
    starts = token_starts(data, rows[:-1])
    first = np.searchsorted(starts, rows)
    n = np.diff(first)
    ends = np.append(starts, len(data))
    index = Exceptions(data)
    before = index.to_chars(rows[:-1])
    # A cut after k tokens is where the next one starts; after the last one, the text's end.
    cut = [np.minimum(ends[np.minimum(first[:-1] + k, len(starts))], rows[1:]) for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1)))]
    chars = [index.to_chars(c) - before for c in cut]
    return n, chars[0], chars[1] - chars[0], np.stack([index.to_bytes(before + c) for c in chars], axis=1)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    for batch in batches:
        for begin, end, data, rows in blocks(batch.column(1)):
            part = batch.slice(begin, end - begin)
            n, prefix, middle, cuts = _cut(data, rows, part.column(2).to_numpy(), part.column(3).to_numpy())
            text, out = data.tobytes(), []
            forms = part.column(4).to_pylist()
            for form, a, z, (x, y) in zip(forms, rows[:-1].tolist(), rows[1:].tolist(), cuts.tolist(), strict=True):
                if form == "plain":
                    out.append(text[a:z])
                elif form == "psm":
                    out.append(b"".join((p, text[a:x], s, text[y:z], m, text[x:y])))
                else:
                    out.append(b"".join((s, text[y:z], p, text[a:x], m, text[x:y])))
            plain = np.array([f == "plain" for f in forms], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), part.column(4), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, version: str = "1", transformed: int = TRANSFORMED, spm: int = SPM) -> DataFrame:
    """doc_id, n tokens, form, prefix_chars, middle_chars and output of every document; the draws depend on version and doc_id alone."""
    digest = F.sha2(F.concat(F.lit(f"{version}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h[2] % 100 >= transformed), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.cast("binary").alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    parts = lambda second: F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{second}|{MIDDLE}")
    psm, spm = parts(SUFFIX), parts(PREFIX)
    return (
        F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(form == "spm", F.concat(spm[1], spm[2], spm[0]))
        .otherwise(output)
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    hashed = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return rows.withColumns(hashed).drop("output")


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), t AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
         [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT FOR k IN [0, 1, 2, 3]] AS h FROM d
), c AS (
  SELECT *, len(tokens) AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS k1, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS k2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
), p AS (
  SELECT *, array_to_string(tokens[1 : k1], '') AS prefix, array_to_string(tokens[k1 + 1 : k2], '') AS middle, array_to_string(tokens[k2 + 1 : n], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
