"""Duplicate, shadowed, unused and twin symbols, barrels and import paths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.names import jaccard
from coppice.functions.paths import dirname, is_dev_path, is_test_path, module_key, stem
from coppice.plans.storage import materialize

# Names too general to count as duplicates.
GENERIC_NAMES = (
    "new", "default", "from", "into", "clone", "process", "load", "save", "run", "init", "build", "execute", "handle", "create", "update", "delete", "get", "set",
)

# Prefixes of methods that a convention gives their names.
IDIOM_METHODS = "^(from|to|into|as|with|try|is)_"


def _named(exports: DataFrame) -> DataFrame:
    return exports.where(F.col("name").isNotNull() & ~F.col("name").isin(*GENERIC_NAMES))


def duplicate_exports(exports: DataFrame) -> DataFrame:
    """Names that several files export: score 2 x production + dev files, canonical the first production file, severity."""
    rows = _named(exports).select("name", "path", "dir", "language").distinct().withColumn("dev", is_dev_path(F.col("path")))
    grouped = rows.groupBy("name").agg(
        F.count("*").alias("files"),
        (2 * F.count(F.when(~F.col("dev"), 1)) + F.count(F.when(F.col("dev"), 1))).alias("score"),
        F.min_by("path", F.struct("dev", "path")).alias("canonical"),
        F.count_distinct("dir").alias("packages"),
        F.count_distinct("language").alias("languages"),
    )
    severity = F.when(F.col("languages") > 1, "cross_language").when(F.col("packages") >= 3, "cross_package").otherwise("same_package")
    return grouped.where("files > 1").withColumn("severity", severity)


def used_keys(imports: DataFrame) -> DataFrame:
    """Module key and name of every import; '*' uses all of a module."""
    return imports.select(module_key(F.col("resolved_path")).alias("module"), "name").distinct()


def dead_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Exports that no file imports, by name or whole, with a confidence.

    An import of the name from any other module lowers the confidence; tests don't count
    as dead. An unknown line is 0.
    """
    rows = exports.where(~is_test_path(F.col("path"))).withColumn("module", module_key(F.col("path")))
    used = used_keys(imports)
    star = used.where("name = '*'").select("module").distinct()
    dead = rows.join(used.select("module", "name"), ["module", "name"], "left_anti").join(star, "module", "left_anti")
    elsewhere = used.where("name <> '*'").select("name").distinct().withColumn("named", F.lit(True))
    confidence = F.when(F.col("named"), "low").when(F.col("kind") == "const", "high").otherwise("very-high")
    return dead.join(elsewhere, "name", "left").select(
        "path", "name", "kind", F.coalesce("line", F.lit(0)).cast("long").alias("line"), confidence.alias("confidence")
    )


def symbol_registry(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Every exported symbol with the number of import rows that resolve to it."""
    counts = imports.groupBy(F.col("resolved_path").alias("path"), "name").agg(F.count("*").alias("import_count"))
    return exports.select("path", "name").distinct().join(counts, ["path", "name"], "left").na.fill(0, ["import_count"])


def dead_parrots(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Registry rows with no import whose name nobody imports anywhere."""
    idle = symbol_registry(exports, imports).where("import_count = 0")
    return idle.join(imports.select("name").distinct(), "name", "left_anti").select("path", "name")


def shadow_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Names exported by several files of which some are used and some not; the first used one is canonical."""
    rows = symbol_registry(_named(exports), imports)
    grouped = rows.groupBy("name").agg(
        F.count(F.when(F.col("import_count") > 0, 1)).alias("used"),
        F.count(F.when(F.col("import_count") == 0, 1)).alias("unused"),
        F.min(F.when(F.col("import_count") > 0, F.col("path"))).alias("canonical"),
    )
    return grouped.where("used > 0 AND unused > 0")


def exact_twins(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Pairs of files that export one name, from the canonical file to every other, with the similarity of their fingerprints.

    Canonical: most imports, then the shortest path, then its order. A star of pairs
    per name keeps the result linear in the number of places. Names whose places are of
    several kinds, or of which one has no fingerprint, only share a name; so do methods,
    unless their prefix is an idiom.
    """
    rows = symbol_registry(_named(exports), imports).join(exports.select("path", "name", "signature", "kind").distinct(), ["path", "name"])
    first = F.min(F.struct((-F.col("import_count")).alias("o"), F.length("path").alias("l"), "path", "signature")).alias("h")
    per_name = rows.groupBy("name").agg(
        first, (F.count_distinct("kind") > 1).alias("mixed"), F.bool_or(F.col("signature").isNull()).alias("bare"), F.coalesce(F.bool_and(F.col("kind") == "method"), F.lit(False)).alias("methods")
    )
    head = per_name.select("name", F.col("h.path").alias("canonical"), F.col("h.signature").alias("head"), "mixed", "bare", "methods")
    pairs = rows.join(head, "name").where("path <> canonical")
    similarity = F.coalesce(jaccard(F.col("signature"), F.col("head"), both_empty=1.0), F.lit(0.0))
    kind = (
        F.when(F.col("methods"), F.when(F.col("name").rlike(IDIOM_METHODS), "IDIOM").otherwise("NAME_COLLISION")).when(F.col("mixed") | F.col("bare"), "NAME_COLLISION")
        .when(similarity >= 0.999, "EXACT").when(similarity >= 0.4, "SHAPE_SIMILAR").otherwise("NAME_COLLISION")
    )
    return pairs.select("name", "canonical", "path", F.round(similarity, 6).alias("similarity"), kind.alias("class"))


def route_twins(routes: DataFrame) -> DataFrame:
    """Routes declared more than once; high if a file repeats."""
    key = ["framework", F.upper(F.trim("method")).alias("method"), F.trim("route_path").alias("route_path")]
    grouped = routes.select(*key, "path").groupBy("framework", "method", "route_path").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))
    return grouped.where("n > 1").withColumn("severity", F.when(F.col("n") > F.col("files"), "high").otherwise("medium"))


def missing_barrels(files: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Directories of several files without an index whose files are imported from other directories often."""
    has = files.select(dirname(F.col("path")).alias("directory"), (stem(F.col("path")) == "index").alias("index"))
    dirs = has.groupBy("directory").agg(F.count("*").alias("files"), F.bool_or("index").alias("index")).where("files > 1 AND NOT index")
    pairs = edges.select("src", "dst").distinct().withColumn("directory", dirname(F.col("dst"))).where(dirname(F.col("src")) != F.col("directory"))
    outside = pairs.groupBy("directory").agg(F.count("*").alias("external_imports")).where(F.col("external_imports") >= least)
    return dirs.join(outside, "directory").select("directory", "files", "external_imports")


def inconsistent_paths(imports: DataFrame) -> DataFrame:
    """Symbols imported through several sources, one of which besides the canonical (most used) one is used more than once."""
    counts = imports.where("name <> '*'").groupBy("name", "source").agg(F.count("*").alias("n"))
    order = Window.partitionBy("name").orderBy(F.desc("n"), "source")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    grouped = ranked.groupBy("name").agg(
        F.count("*").alias("sources"), F.max(F.when(F.col("rank") == 1, F.col("source"))).alias("canonical"),
        F.coalesce(F.max(F.when(F.col("rank") > 1, F.col("n"))), F.lit(0)).alias("next_use"),
    )
    return grouped.where("sources > 1 AND next_use > 1")


def barrels(edges: DataFrame) -> DataFrame:
    """Files that re-export: number of re-exports, of distinct targets and whether they also import."""
    return edges.groupBy(F.col("src").alias("path")).agg(
        F.count(F.when(F.col("label") == "reexport", 1)).alias("reexports"),
        F.count_distinct(F.when(F.col("label") == "reexport", F.col("dst"))).alias("targets"),
        F.bool_or(F.col("label") != "reexport").alias("mixed"),
    ).where("reexports > 0")


def reexport_cascades(edges: DataFrame) -> DataFrame:
    """Re-exports of a file that itself re-exports."""
    again = edges.where("label = 'reexport'")
    return again.select("src", "dst").join(again.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct()


def reexport_chains(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """From every re-exporting file, the path along the first (smallest) target while that re-exports; more than two steps."""
    again = edges.where("label = 'reexport'").groupBy("src").agg(F.min("dst").alias("next"))
    rows = materialize(again.select("src", F.array("src", "next").alias("chain"), F.col("next").alias("at")), "chains")
    step = materialize(again.select(F.col("src").alias("at"), F.col("next").alias("to")), "chain-steps")
    ended = []
    for _ in count() if longest is None else range(longest):
        grown = rows.join(step, "at", "left")
        ahead = F.coalesce(F.col("to").isNotNull() & ~F.array_contains("chain", F.col("to")), F.lit(False))
        grown = materialize(grown.select("src", F.when(ahead, F.array_append("chain", F.col("to"))).otherwise(F.col("chain")).alias("chain"), F.when(ahead, F.col("to")).alias("at")), "chains")
        ended.append(grown.where("at IS NULL"))
        rows = grown.where("at IS NOT NULL")
        if rows.isEmpty():
            break
    for more in ended:
        rows = rows.union(more)
    return rows.where(F.size("chain") > 3).select("src", F.array_join("chain", ">").alias("chain"), (F.size("chain") - 1).cast("long").alias("steps"))


def orphan_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that nothing imports and that aren't tests."""
    idle = files.join(edges.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")
    return idle.where(~is_test_path(F.col("path"))).select("path", "loc")


def implicit_edges(usages: DataFrame, exports: DataFrame) -> DataFrame:
    """(path, name) uses whose name exactly one file exports: an edge to that file, no self edges."""
    unique = exports.groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("dst")).where("n = 1").select("name", "dst")
    return usages.join(unique, "name").where("path <> dst").select(F.col("path").alias("src"), "dst").distinct()


def stem_matches(files: DataFrame) -> DataFrame:
    """File stems that occur in more than one language."""
    rows = files.select(F.regexp_replace(stem(F.col("path")), "_[0-9]+$", "").alias("stem"), "language")
    return rows.groupBy("stem").agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.count("*").alias("files")).where(F.contains("languages", F.lit(",")))


def pattern_words(exports: DataFrame, least: int = 3, limit: int = 10) -> DataFrame:
    """The commonest words of exported names that are longer than three letters."""
    words = exports.select(F.explode(F.regexp_extract_all("name", F.lit("([A-Z][a-z]+|[a-z]+)"), F.lit(1))).alias("word")).select(F.lower("word").alias("word"))
    return words.where(F.length("word") > 3).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(limit)


def crowds(exports: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that share an exported name, scored: members, how many are little used beside the primary one."""
    importers = edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("importers"))
    rows = _named(exports).select("name", "path").distinct().join(importers, "path", "left").na.fill(0, ["importers"])
    top = rows.groupBy("name").agg(F.max("importers").alias("primary"), F.count("*").alias("members")).where("members > 1")
    grouped = rows.join(top, "name").groupBy("name", "members", "primary").agg(
        F.count(F.when((F.col("primary") > 0) & (F.col("importers") <= F.floor(F.col("primary") / 3)), 1)).alias("underused")
    )
    issues = (F.col("underused") > 0).cast("int") + (F.col("members") >= 3).cast("int")
    score = F.least(F.least(F.col("members") - 1, F.lit(3)) + 1.5 * issues + 0.5 * F.col("underused"), F.lit(10.0))
    return grouped.withColumn("score", F.round(score, 6))


def similar_files(imports: DataFrame, above: float = 0.3) -> DataFrame:
    """Pairs of sets of imported modules with a Jaccard similarity above a bound.

    Files with equal sets are one class: its first path stands for it, with their number.
    Classes meet on prefixes only: the modules of a set in order of rarity, as many of
    them as a similar set can't avoid all; the pair is then measured on the whole sets.
    """
    rows = imports.select("path", "resolved_path").where("resolved_path IS NOT NULL").distinct()
    often = rows.groupBy("resolved_path").agg(F.count("*").alias("n"))
    module = F.struct("n", "resolved_path")
    sets = rows.join(often, "resolved_path").groupBy("path").agg(F.sort_array(F.collect_list(module)).alias("modules"))
    classes = sets.groupBy("modules").agg(F.min("path").alias("path"), F.count("*").alias("files"))
    least = F.size("modules") - F.ceil(F.size("modules") * F.lit(above)) + 1
    heads = classes.select("path", "files", "modules", F.explode(F.slice("modules", 1, least.cast("int"))).alias("head"))
    x = heads.select(F.col("path").alias("a"), F.col("files").alias("a_files"), F.col("modules").alias("ma"), "head")
    y = heads.select(F.col("path").alias("b"), F.col("files").alias("b_files"), F.col("modules").alias("mb"), "head")
    similarity = jaccard(F.col("ma"), F.col("mb"))
    pairs = x.join(y, "head").where("a < b").withColumn("similarity", similarity).where(F.col("similarity") > above)
    return pairs.select("a", "b", "a_files", "b_files", F.round("similarity", 6).alias("similarity")).distinct()
