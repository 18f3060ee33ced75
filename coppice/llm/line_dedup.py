"""Line dedup by content-defined chunks of lines, native throughout.

A line's hash is 32 bits of its MD5. A rolling hash over the hashes of ``ROLL``
lines ends a chunk where it is 0 modulo ``MEAN_LINES``, so boundaries depend on the
lines around them alone and a passage that has moved is cut as before. A chunk with
at least two lines that aren't blank is a candidate. Chunks whose 64-bit hash and
length occur more than once are compared by their bytes; of equal chunks the first,
by doc_id, place and the text's hash, stays and the others go.

Before this, the pipeline's stage takes repeated passages out, wherever they begin
(``without_passages``). A passage is found by its windows of ``WINDOW`` words. A window
starts at a word of the least hash among some ``NEAR`` neighbours, or after the end of a
line, or it ends with a line or text. So a repeated run of
``WINDOW + NEAR - 1`` words or more has a window wherever it stands, and no gap between
its windows; less than ``NEAR`` words at either end may stay within a line. Of equal
windows, by two 64-bit hashes, the first stays and the words of the others go. Rows carry
hashes and places and no text.

Defined results: a null text stays null and has no chunk; an empty text is one
blank line and stays; documents with equal doc_id and text count as one document
(each keeps its first chunks); null doc_ids come first; further columns pass through untouched; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.storage import materialize, table

ROLL = 3
MEAN_LINES = 4
BASE = 31
BROADCAST_ROWS = 200_000
WINDOW = 20
NEAR = 10
PLACE = 24


def chunks(text: Column) -> Column:
    """A text's chunks in order; joined by line feeds they are the text."""
    lines = F.split(text, "\n")
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))
    built = F.struct(lines.alias("lines"), hashes.alias("hashes"))

    def cut(made: Column) -> Column:
        held, hashed = made["lines"], made["hashes"]

        def ends_here(i: Column) -> Column:
            value = F.get(hashed, i)
            for back in range(1, ROLL):
                value = value + F.coalesce(F.get(hashed, i - back), F.lit(0)) * BASE**back
            return (F.pmod(value, F.lit(MEAN_LINES)) == 0) | (i == F.size(held) - 1)

        ends = F.filter(F.sequence(F.lit(0), F.size(held) - 1), ends_here)
        return F.transform(
            F.arrays_zip(ends.alias("e"), F.concat(F.array(F.lit(-1)), ends).alias("b")),
            lambda x: F.when(x["e"].isNotNull(), F.array_join(F.slice(held, x["b"] + 2, x["e"] - x["b"]), "\n")),
        )

    # transform over a one-element array evaluates lines and hashes once.
    found = F.get(F.transform(F.array(built), cut), F.lit(0))
    return F.filter(found, lambda x: x.isNotNull())


def multi_line(chunk: Column) -> Column:
    return F.size(F.filter(F.split(chunk, "\n"), lambda x: F.trim(x) != "")) >= 2


def exploded(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(chunks(F.col("text"))).alias("k", "chunk"))
    return rows.where(multi_line(F.col("chunk"))).withColumn("h", F.xxhash64("chunk", F.octet_length("chunk")))


def repeated(docs: DataFrame) -> DataFrame:
    """Chunks to remove, per document: doc_id, text_hash and the places k."""
    often = materialize(
        exploded(docs).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-chunk-hashes"
    )
    rows = exploded(docs).join(F.broadcast(often) if often.count() <= BROADCAST_ROWS else often, "h", "left_semi")
    rows = materialize(rows.select("h", "doc_id", "text_hash", "k", "chunk"), "candidate-chunks")
    # Grouping by the chunk itself is the comparison of bytes.
    place = F.struct("doc_id", "k", "text_hash")
    first = rows.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = rows.join(first, ["h", "chunk"]).where(~place.eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set("k").alias("gone"))


def _joined(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Each row and the places of what to remove from it."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left")


def _kept(text: Column) -> Column:
    left = F.filter(chunks(text), lambda x, i: ~F.array_contains(F.col("gone"), i))
    return F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))


def _rewritten(docs: DataFrame, gone: DataFrame, kept: Callable[[Column], Column], least_left: float = 0.0) -> DataFrame:
    new = {"text": kept(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(new["text"]).cast(docs.schema["n_chars"].dataType))
    rows = _joined(docs, gone)
    if least_left:
        rows = rows.where(F.col("gone").isNull() | (F.length(new["text"]) >= least_left * F.length("row.text")))
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Every row with its text less the repeated chunks; n_chars, if there, is that of the new text."""
    return _rewritten(docs, repeated(docs), _kept)


def words(text: Column) -> Column:
    """A text's words, each with the white space behind it; joined they are the text."""
    return F.split(text, r"(?<=\s)(?=\S)")


def _least(keys: Column) -> Column:
    """For each place the least of the NEAR keys from it on; minima of 2, 4, 8 of them are minima of halves."""
    ahead = lambda held, n: F.transform(F.array(held), lambda x: F.zip_with(x, F.slice(x, n + 1, F.size(x)), lambda a, b: F.least(a, b)))
    width = 1
    while width < NEAR:
        step = min(width, NEAR - width)
        keys, width = F.get(ahead(keys, step), F.lit(0)), width + step
    return keys


def windows(text: Column) -> Column:
    """(k, passage) of the windows of a text: the place of the first word and the words, without white space behind."""
    held = words(text)
    # A word's hash in the upper bits and its place in the lower ones.
    trimmed = lambda x: F.xxhash64(F.rtrim(x, F.lit(" \t\r\n")))
    keys = F.transform(held, lambda x, i: F.shiftleft(F.shiftright(trimmed(x), PLACE), PLACE).bitwiseOR(i.cast("long")))
    stops = F.filter(F.transform(held, lambda x, i: F.when(F.contains(x, F.lit("\n")), i)), lambda i: i.isNotNull())

    def found(made: Column) -> Column:
        last = F.size(made["words"]) - WINDOW
        ends = F.concat(F.transform(made["stops"], lambda i: i + 1), F.transform(made["stops"], lambda i: i - (WINDOW - 1)), F.array(F.lit(0), last))
        chosen = F.transform(F.slice(made["least"], 1, last + 1), lambda x: x.bitwiseAND(F.lit(2**PLACE - 1)).cast("int"))
        places = F.filter(F.array_union(chosen, ends), lambda k: (k >= 0) & (k <= last))

        def window(k: Column) -> Column:
            return F.struct(k.alias("k"), F.rtrim(F.array_join(F.slice(made["words"], k + 1, WINDOW), ""), F.lit(" \t\r\n")).alias("passage"))

        return F.transform(places, window)

    built = F.struct(held.alias("words"), stops.alias("stops"), _least(keys).alias("least"))
    long = F.when(F.size(held) >= WINDOW, F.get(F.transform(F.array(built), found), F.lit(0)))
    return F.coalesce(long, F.array().cast("array<struct<k:int,passage:string>>"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Windows to remove, per document: doc_id, text_hash and the places k of their first words."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(windows(F.col("text"))))
    rows = rows.select(F.xxhash64("passage").alias("h"), F.xxhash64(F.lit(WINDOW), "passage").alias("h2"), "doc_id", "text_hash", "k")
    often = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-window-hashes")
    rows = rows.join(F.broadcast(often) if often.count() <= BROADCAST_ROWS else often, "h", "left_semi")
    rows = materialize(rows, "candidate-windows")
    place = F.struct("doc_id", "k", "text_hash")
    first = rows.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = rows.join(first, ["h", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set("k").alias("gone"))


def _outside(text: Column) -> Column:
    """The text less the words of the windows that begin at `gone`."""

    def rest(held: Column) -> Column:
        def part(begin: Column, end: Column) -> Column:
            return F.array_join(F.slice(held, begin + 1, end - begin), "")

        def step(acc: Column, k: Column) -> Column:
            more = F.when(k > acc["at"], F.concat(acc["parts"], F.array(part(acc["at"], k)))).otherwise(acc["parts"])
            return F.struct((k + WINDOW).alias("at"), more.alias("parts"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(F.sort_array("gone"), start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), part(acc["at"], F.size(held))))

    return F.when(F.col("gone").isNull(), text).otherwise(F.get(F.transform(F.array(words(text)), rest), F.lit(0)))


def without_passages(docs: DataFrame, least_left: float = 0.0) -> DataFrame:
    """Every row with its text less the repeated passages; n_chars, if there, is that of the new text.

    least_left: a row that keeps a smaller share of its characters goes whole. It is a near
    copy of what came before, and its shreds would resemble nothing; no row without a
    repeated passage goes.
    """
    return _rewritten(docs, repeated_windows(docs), _outside, least_left)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, the kept text, n_chunks and n_removed of every row."""
    return _joined(docs, repeated(docs)).select(
        F.col("id").alias("doc_id"), _kept(F.col("row.text")).alias("kept"),
        F.coalesce(F.size(chunks(F.col("row.text"))), F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept text of every document, by its size and digest."""
    rows = counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("kept", F.lit("")).cast("binary")
    return rows.select("doc_id", "n_chunks", "n_removed", F.octet_length(kept).cast("long").alias("kept_bytes"), F.sha2(kept, 256).alias("kept_sha256"))


_ROLLED = " + ".join(
    f"coalesce(lag(hash, {k}) OVER (PARTITION BY doc_id ORDER BY i), 0) * {BASE**k}" if k else "hash" for k in range(ROLL)
)
OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS hash FROM lines),
rolled AS (SELECT doc_id, i, line, ({_ROLLED}) % {MEAN_LINES} = 0 AS ends FROM hashed),
cut AS (
  SELECT doc_id, i, line, coalesce(sum(ends::INT) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM rolled),
chunk AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS c, count(*) FILTER (trim(line, ' ') <> '') AS solid
  FROM cut GROUP BY doc_id, k),
ranked AS (
  SELECT *, solid >= 2 AND row_number() OVER (PARTITION BY c, solid >= 2 ORDER BY doc_id, k) > 1 AS again FROM chunk),
kept AS (
  SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (again) AS n_removed,
         coalesce(string_agg(c, chr(10) ORDER BY k) FILTER (NOT again), '') AS t
  FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_removed, 0)::BIGINT AS n_removed,
       strlen(coalesce(t, '')) AS kept_bytes, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
