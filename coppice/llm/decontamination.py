"""Benchmark decontamination as a prefix-filtered set join, native throughout.

A benchmark item's windows are its runs of ``WINDOW`` words; an item with fewer
words is one window. Words are ordered by how often they occur in all documents. A
document that contains a window contains its rarest word, so the necessary prefix
of a window is that one word: document words join on it alone. The word's offset
bounds where the window would start, its length must fit, and the candidate is then
compared word by word.

Every document also has the empty window at its end, which brings its number of words
along, so that two passes over the texts do: one counts words, one finds windows.

The prefix table is broadcast while its size is within ``BROADCAST_ROWS`` windows
(about 200 bytes each). Beyond that, (word, document, place) rows are joined by a
shuffle, bounds applied, and only documents with candidates are met with them again.

Defined results: a null or empty text has no words and no hit; documents with equal
doc_id and text get equal results, one row each; items with equal words all count;
further columns of either table are ignored; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.plans.storage import materialize, table

WINDOW = 10
BROADCAST_ROWS = 20_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The characters between words, as one string.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Stands at the end of every document in place of a word; no word has a space.
END = " "
KEY = ["doc_id", "text_hash"]


def words(text: Column) -> Column:
    """Lower-cased words: one pass puts spaces between them, and splitting at single spaces needs no pattern."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BETWEEN + string.ascii_uppercase, " " * len(BETWEEN) + string.ascii_lowercase)
    return F.array_remove(F.split(spaced, " "), "")


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """window_id, the window's words and their number; a row per item and place."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    rows = items.select("item_id", "w", F.explode(starts).alias("s"))
    return rows.select("item_id", F.slice("w", F.col("s"), width).alias("window"))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table is small enough to send to every executor."""
    return df.count() <= rows


def prefixes(docs: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """Distinct windows with their rarest word over all documents and its offset."""
    distinct = wins.select("window").distinct()
    places = distinct.select("window", F.posexplode("window").alias("offset", "word"))
    vocabulary = places.select("word").distinct()
    occurring = docs.select(F.explode(words(F.col("text"))).alias("word"))
    counts = (
        occurring.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi")
        .groupBy("word").agg(F.count("*").alias("n"))
    )
    # A window with a word that no document has can't occur.
    whole = F.count("n").over(Window.partitionBy("window")) == F.size("window")
    ranked = places.join(counts, "word", "left").withColumn("whole", whole).where("whole")
    rarest = F.min(F.struct("n", "word", "offset")).alias("p")
    return ranked.groupBy("window").agg(rarest).select(
        "window", F.size("window").alias("len"), F.col("p.word").alias("word"), F.col("p.offset").alias("offset")
    )


def matches(docs: DataFrame, prefix: DataFrame, small: bool, ends: bool = False) -> DataFrame:
    """doc key, start (from 0), length and words of every occurrence of a window; ends: of the empty window, too."""
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n"))
    if ends:
        empty = docs.sparkSession.range(1).select(F.array().cast("array<string>").alias("window"), F.lit(0).alias("len"), F.lit(END).alias("word"), F.lit(0).alias("offset"))
        prefix = prefix.unionByName(empty)
    held = F.concat("w", F.array(F.lit(END))) if ends else F.col("w")
    rows = split.select(*KEY, *(["w"] if small else []), F.size("w").alias("n"), F.posexplode(held).alias("pos", "word"))
    found = rows.join(F.broadcast(prefix) if small else prefix, "word").where(fits)
    if small:
        found = found.where(F.slice("w", start + 1, F.col("len")) == F.col("window"))
        return found.select(*KEY, start.alias("start"), "len", "window")
    found = found.select(*(F.col(k).alias(f"found_{k}") for k in KEY), start.alias("start"), "len", "window")
    if not ends:
        return _verified(split, found)
    found = materialize(found, "window-candidates")
    at_end = found.where("len = 0").withColumnsRenamed({f"found_{k}": k for k in KEY})
    return _verified(split, found.where("len > 0")).unionByName(at_end)


def _verified(split: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates whose words are those of the window; equal documents count once."""
    same = F.col("doc_id").eqNullSafe(F.col("found_doc_id")) & (F.col("text_hash") == F.col("found_text_hash"))
    hit = found.distinct().join(split, same).where(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("window"))
    return hit.select(*KEY, "start", "len", "window")


def covered(spans: Column) -> Column:
    """Number of places in the union of sorted (start, len) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def step(acc: Column, span: Column) -> Column:
        end = span["start"] + span["len"]
        more = F.greatest(end - F.greatest(span["start"], acc["upto"]), F.lit(0))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, ends: bool = False) -> DataFrame:
    """doc key, start, len and item (as text) of every occurrence of a window; ends: a row without item at each document's end, too."""
    wins = materialize(windows(benchmark, width), "windows")
    small = bounded(wins)
    prefix = materialize(prefixes(docs, wins, small), "prefixes")
    items = wins.select("window", F.col("item_id").cast("string").alias("item"))
    found = matches(docs, prefix, small, ends)
    return found.join(F.broadcast(items) if small else items, "window", "left" if ends else "inner").select(*KEY, "start", "len", "item")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows, with all their columns, in which no window occurs."""
    hit = materialize(hits(docs, benchmark, width).select(*(F.col(k).alias(f"hit_{k}") for k in KEY)).distinct(), "contaminated")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    same = F.col("id").eqNullSafe(F.col("hit_doc_id")) & (F.col("hash") == F.col("hit_text_hash"))
    return keyed.join(F.broadcast(hit) if bounded(hit, 10 * BROADCAST_ROWS) else hit, same, "left_anti").select("row.*")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, word counts, hit words, hit items and verdict of every document."""
    at_end = F.col("len") == 0
    per_doc = hits(docs, benchmark, width, ends=True).groupBy(*KEY).agg(
        F.max(F.when(at_end, F.col("start"))).cast("long").alias("n_words"), F.count(F.when(at_end, 1)).alias("copies"),
        F.sort_array(F.collect_set(F.when(~at_end, F.struct("start", "len")))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"),
    )
    hit = covered(F.col("spans"))
    rows = per_doc.select(
        "doc_id", "text_hash", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), "copies")),
    )
    return rows.drop("col")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


_SPLIT = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}')"
)
OP7_SQL = f"""
WITH b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
win AS (
  SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WINDOW} THEN [w]
    ELSE list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: list_slice(w, i, i + {WINDOW - 1})) END) AS g FROM b),
d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
lengths AS (SELECT DISTINCT len(g) AS k FROM win),
places AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN lengths),
hits AS (
  SELECT p.doc_id, p.i, p.k, win.item_id FROM places p JOIN win ON list_slice(p.w, p.i, p.i + p.k - 1) = win.g),
hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
