"""Bindings, cross-checks, tags, anchors, bodies and receipts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.operators.search import lines


def bind_symbols(uses: DataFrame, exports: DataFrame) -> DataFrame:
    """Uses (path, dir, name) bound to the only exporter of the name in their directory, or else to the only one anywhere."""

    def only(keys: list[str]) -> DataFrame:
        return exports.groupBy(*keys).agg(F.count_distinct("path").alias("n"), F.min("path").alias("target")).where("n = 1").drop("n")

    near = uses.join(only(["dir", "name"]), ["dir", "name"], "left").withColumnRenamed("target", "near")
    both = near.join(only(["name"]), "name", "left")
    scope = F.when(F.col("near").isNotNull(), "directory").when(F.col("target").isNotNull(), "anywhere").otherwise("unbound")
    return both.select("path", "name", F.coalesce("near", "target").alias("target"), scope.alias("scope")).distinct()


def cross_check(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidate names (name, path) with how often texts other than their own use them as a token; none means no evidence of use.

    Texts are cut into tokens once and joined by equality; only tokens that are
    candidates leave the scan's aggregation.
    """
    tokens = texts.select("path", F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    hits = tokens.join(candidates.select("name").distinct(), "name", "left_semi").groupBy("name", F.col("path").alias("at")).agg(F.count("*").alias("hits"))
    joined = candidates.join(hits, "name", "left").where(F.col("at").isNull() | ~F.col("at").eqNullSafe(F.col("path")) | F.col("path").isNull())
    found = joined.groupBy("name").agg(F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("hits"), F.count("at").alias("files"))
    return candidates.select("name").distinct().join(found, "name", "left").na.fill(0).select("name", "hits", "files", (F.col("files") > 0).alias("degraded"))


def opaque_types(exports: DataFrame, edges: DataFrame) -> DataFrame:
    """Class exports of files that are re-exported and not imported otherwise."""
    again = edges.where("label = 'reexport'").select(F.col("dst").alias("path")).distinct()
    direct = edges.where("label <> 'reexport'").select(F.col("dst").alias("path")).distinct()
    return exports.where("kind = 'class'").join(again, "path", "left_semi").join(direct, "path", "left_anti").select("path", "name")


def component_of(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """What contains each target: files that re-export it (barrel) and files that import it (parent)."""
    role = F.when(F.col("label") == "reexport", "barrel").otherwise("parent")
    rows = edges.join(targets.select(F.col("path").alias("dst")), "dst", "left_semi")
    return rows.select(F.col("dst").alias("target"), F.col("src").alias("path"), role.alias("role")).distinct()


def cyclic_subset(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """Import cycles among the files of a subset alone."""
    from coppice.operators.graph import import_cycles

    inside = edges.join(subset.select(F.col("path").alias("src")), "src", "left_semi").join(subset.select(F.col("path").alias("dst")), "dst", "left_semi")
    return import_cycles(inside)


def anchors(symbols: DataFrame) -> DataFrame:
    """Stable short ids of symbols, and of their files."""
    short = lambda *parts: F.substring(F.sha2(F.concat_ws("::", *parts).cast("binary"), 256), 1, 12)
    return symbols.select("path", "name", short("path").alias("file_anchor"), short("path", "name").alias("anchor")).distinct()


def renames(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, fingerprint) that are gone, with the one new file of equal content."""
    gone, new = before.join(after, "path", "left_anti"), after.join(before, "path", "left_anti")
    one = lambda df, name: df.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("path").alias(name)).where("n = 1").drop("n")
    return one(gone, "old_path").join(one(new, "new_path"), "fingerprint").select("old_path", "new_path")


def symbol_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols (path, name, line) added, removed or moved between two states of files."""
    a, b = (df.groupBy("path", "name").agg(F.min("line").alias(c)) for df, c in ((before, "old_line"), (after, "new_line")))
    there = lambda df, c: df.withColumn(c, F.lit(True))
    rows = there(a, "was").join(there(b, "is"), ["path", "name"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old_line").eqNullSafe(F.col("new_line")), "changed")
    return rows.select("path", "name", change.alias("change")).where("change IS NOT NULL")


# What a symbol's name or place says about its role; the first that holds.
IDIOMS = {
    "test": ("path", r"(^|/)tests?/"), "style": ("path", r"\.css$"), "constructor": ("name", "^(new|from|into|with|try)_"), "predicate": ("name", "^(is|has|can)_"),
    "handler": ("name", "(^on_|_handler$)"), "entry": ("name", "^(main|run|serve)$"),
}


def idiom_tags(symbols: DataFrame) -> DataFrame:
    """Symbols with the tag of the first idiom that holds."""
    tag: Column | None = None
    for name, (column, pattern) in IDIOMS.items():
        tag = F.when(F.col(column).rlike(pattern), name) if tag is None else tag.when(F.col(column).rlike(pattern), name)
    return symbols.select("path", "name", tag.alias("tag")).where("tag IS NOT NULL").distinct()


def suppressed_by_idiom(findings: DataFrame, tags: DataFrame, which: tuple[str, ...]) -> DataFrame:
    """Findings less those whose symbol has one of the tags."""
    return findings.join(tags.where(F.col("tag").isin(*which)).select("path", "name").distinct(), ["path", "name"], "left_anti")


# Roles of a needle on its line, tried in this order; {} is the needle.
ROLES = {
    "comment": r"^\s*(#|//|<!--).*\b{}\b", "import": r"^\s*(import|from|use)\s.*\b{}\b", "definition": r"\b(def|class|function|fn|const|let|var)\s+{}\b",
    "string": r"[\"'][^\"']*\b{}\b[^\"']*[\"']", "call": r"\b{}\(", "write": r"\b{}\s*=", "attribute": r"[.]{}\b",
}


def occurrence_roles(texts: DataFrame, needle: str) -> DataFrame:
    """path, line and role of every line with the needle as a word."""
    word = re.escape(needle)
    role: Column | None = None
    for name, pattern in ROLES.items():
        hit = F.col("text").rlike(pattern.replace("{}", word))
        role = F.when(hit, name) if role is None else role.when(hit, name)
    rows = lines(texts.where(F.contains("content", F.lit(needle)))).where(F.col("text").rlike(rf"\b{word}\b"))
    return rows.select("path", "line", role.otherwise("reference").alias("role"))


def occurrence_shape(roles: DataFrame) -> DataFrame:
    """One row that names what the occurrences amount to."""
    n = lambda *names: F.count(F.when(F.col("role").isin(*names), 1))
    row = roles.agg(F.count("*").alias("hits"), n("definition").alias("definitions"), n("write").alias("writes"), n("call", "reference", "attribute", "string").alias("reads"))
    shape = (
        F.when(F.col("hits") == 0, "unknown").when((F.col("definitions") == 1) & (F.col("writes") == 1) & (F.col("reads") > 0), "single_writer")
        .when((F.col("definitions") == 1) & (F.col("writes") == 0) & (F.col("reads") > 0), "read_only").when(F.col("definitions") == F.col("hits"), "definition_only")
        .when((F.col("definitions") == 0) & (F.col("writes") == 0), "reference_only").otherwise("mixed")
    )
    return row.withColumn("shape", shape)


def bodies(texts: DataFrame) -> DataFrame:
    """First and last line of every indented definition (def, class): it ends before the next line that is not deeper.

    The next such line is the least later line at or above that depth: each definition
    looks along its file's lines once.
    """
    found = lines(texts).where(F.trim("text") != "").withColumn("depth", F.length(F.regexp_extract("text", "^([ \\t]*)", 1)))
    name = F.regexp_extract("text", r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1)
    rows = found.select("path", "line", "depth", name.alias("name"), F.max("line").over(Window.partitionBy("path")).alias("last"))
    starts = rows.where("name <> ''").select("path", "name", F.col("line").alias("first_line"), F.col("depth").alias("own"), "last")
    stops = rows.groupBy("path", "depth").agg(F.sort_array(F.collect_list("line")).alias("at"))
    hit = starts.join(stops, (starts["path"] == stops["path"]) & (F.col("depth") <= F.col("own")), "left")
    following = F.array_min(F.filter("at", lambda x: x > F.col("first_line")))
    grouped = hit.groupBy(starts["path"], "name", "first_line", "last").agg(F.min(following).alias("next"))
    return grouped.select("path", "name", "first_line", F.coalesce(F.col("next") - 1, "last").alias("last_line"))


def entrypoint_drift(declared: DataFrame, detected: DataFrame, files: DataFrame) -> DataFrame:
    """Paths declared and not detected, detected and not declared, or declared and absent."""
    gone = declared.join(files, "path", "left_anti").select("path", F.lit("unresolved").alias("drift"))
    only = lambda a, b, name: a.join(b, "path", "left_anti").select("path", F.lit(name).alias("drift"))
    return gone.union(only(declared.join(files, "path", "left_semi"), detected, "declared_only")).union(only(detected, declared, "detected_only")).distinct()


def receipt(answer: DataFrame, files: DataFrame) -> DataFrame:
    """What an answer rests on: its rows and fingerprint, and the number of files and lines of the scan."""
    from coppice.operators.diff import fingerprint

    scan = files.agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    return fingerprint(answer).withColumnsRenamed({"n": "answer_rows"}).crossJoin(scan)
