"""What of the exported code is dead, with reasons; defects, health, and the reports that rest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.paths import dead_skip, glob_regex, is_non_production, module_key
from coppice.operators import symbols

# Roles that the runtime calls by convention; exports with such a tag aren't dead.
RUNTIME_ROLES = ("test", "style", "constructor", "predicate", "handler", "entry")
# File stems too common to be evidence that a file is started by name.
COMMON_STEMS = ("index", "main", "utils", "types", "test", "tests", "setup", "config")


def _mark(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(*keys).distinct().withColumn(name, F.lit(True))


def dead_verdicts(exports: DataFrame, imports: DataFrame, uses: DataFrame, handlers: DataFrame, reached: DataFrame, tags: DataFrame, dead_ok: tuple[str, ...] = ()) -> DataFrame:
    """Every export (path, name, kind, line) with the first reason why it isn't dead, or none and a confidence.

    uses: (path, name) of names used in the file itself. handlers: (path, name). reached:
    paths that dynamic imports reach. tags: (path, name, tag). dead_ok: globs of files
    whose exports may be dead. An export is a candidate once, at its first line.
    """
    rows = exports.groupBy("path", "name", "kind", "language").agg(F.coalesce(F.min("line"), F.lit(0)).cast("long").alias("line"))
    rows = rows.withColumn("module", module_key(F.col("path")))
    used = symbols.used_keys(imports)
    rows = rows.join(_mark(used.where("name <> '*'"), ["module", "name"], "imported"), ["module", "name"], "left")
    rows = rows.join(_mark(used.where("name = '*'"), ["module"], "star"), "module", "left")
    rows = rows.join(_mark(used.where("name <> '*'"), ["name"], "by_name"), "name", "left")
    rows = rows.join(_mark(uses, ["path", "name"], "local"), ["path", "name"], "left").join(_mark(handlers, ["path", "name"], "handler"), ["path", "name"], "left")
    rows = rows.join(_mark(reached, ["path"], "reached"), "path", "left")
    rows = rows.join(_mark(tags.where(F.col("tag").isin(*RUNTIME_ROLES)), ["path", "name"], "role"), ["path", "name"], "left")
    reason = F.when(dead_skip(F.col("path"), F.col("language")).isNotNull(), F.concat(F.lit("skipped: "), dead_skip(F.col("path"), F.col("language"))))
    reason = reason.when(F.col("kind") == "reexport", "reexport")
    for name, why in (("imported", "imported"), ("star", "imported whole"), ("local", "used in its file"), ("handler", "handler"), ("reached", "reached dynamically"), ("role", "called by convention"), ("by_name", "imported by name")):
        reason = reason.when(F.col(name), why)
    if dead_ok:
        reason = reason.when(F.col("path").rlike("|".join(map(glob_regex, dead_ok))), "allowed")
    confidence = F.when(reason.isNull(), F.when(F.col("language").isin("sh", "bash"), "medium").otherwise("high"))
    return rows.select("path", "name", "kind", "line", reason.alias("reason"), confidence.alias("confidence"))


def stem_variants(path: Column) -> Column:
    """The spellings by which a file may be started: its stem with dashes or underscores; none for common ones."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    spelled = F.array_distinct(F.array(stem, F.replace(stem, F.lit("_"), F.lit("-")), F.replace(stem, F.lit("-"), F.lit("_"))))
    return F.when((F.length(stem) >= 4) & ~stem.isin(*COMMON_STEMS), spelled).otherwise(F.array().cast("array<string>"))


def degraded(candidates: DataFrame, texts: DataFrame, entry_points: DataFrame, largest: int = 2 << 20) -> DataFrame:
    """Candidates (path, name, ...) less confidence where other texts name them or start their file by name, or where the file is an entry point.

    Texts beyond `largest` bytes are no evidence. Candidates are never dropped.
    """
    read = texts.where(F.octet_length("content") <= largest)
    words = read.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("word"))
    quoted = read.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[\"']([A-Za-z0-9_-]+)[\"']"), F.lit(1)))).alias("word"))
    asked = candidates.select("path", "name").distinct()
    named = asked.join(words.select(F.col("path").alias("at"), F.col("word").alias("name")), "name").where("at <> path").groupBy("path", "name").agg(F.count("*").alias("named_in"))
    stems = asked.select("path", F.explode(stem_variants(F.col("path"))).alias("word")).distinct()
    started = stems.join(quoted.select(F.col("path").alias("at"), "word"), "word").where("at <> path").groupBy("path").agg(F.count_distinct("at").alias("started_in"))
    rows = candidates.join(named, ["path", "name"], "left").join(started, "path", "left").join(_mark(entry_points, ["path"], "entry_point"), "path", "left")
    rows = rows.na.fill(0, ["named_in", "started_in"]).na.fill(False, ["entry_point"])
    weak = (F.col("named_in") > 0) | (F.col("started_in") > 0) | F.col("entry_point")
    return rows.withColumn("confidence", F.when(weak, "low").otherwise(F.col("confidence")))


def dead_truth(verdicts: DataFrame, texts: DataFrame, entry_points: DataFrame, high_only: bool = False) -> DataFrame:
    """The exports that are dead as far as imports and texts tell, with confidence and evidence."""
    rows = degraded(verdicts.where("reason IS NULL").drop("reason"), texts, entry_points)
    return rows.where(F.col("confidence").isin("high", "very-high")) if high_only else rows


def counted_dead(dead: DataFrame) -> DataFrame:
    """Those that count as a defect: of high confidence and no entry points."""
    return dead.where(F.col("confidence").isin("high", "very-high") & ~F.col("entry_point"))


def idiom_twins(twins: DataFrame, exports: DataFrame, tags: DataFrame) -> DataFrame:
    """Twins (name, ...) less the names whose places all share a tag of convention."""
    places = exports.groupBy("name").agg(F.count_distinct("path").alias("places"))
    shared = tags.where(F.col("tag").isin(*RUNTIME_ROLES)).groupBy("name", "tag").agg(F.count_distinct("path").alias("tagged"))
    idioms = shared.join(places, "name").where("tagged = places AND places > 1").select("name").distinct()
    return twins.join(idioms, "name", "left_anti")


# The weights of the three kinds of defects.
CERTAIN, HIGH, SMELL = 50.0, 30.0, 20.0
SIZES = ("files", "loc")
DEFECTS = {
    "certain": ("missing_handlers", "unregistered_handlers", "breaking_cycles"),
    "high": ("unused_handlers", "dead_exports", "twins_dead_parrots"),
    "smell": ("twins_same_language", "barrel_chaos", "structural_cycles", "cascade_imports", "duplicate_exports"),
}


def structural_defects(
    files: DataFrame, cycles: DataFrame, dead: DataFrame, parrots: DataFrame, twins: DataFrame, exports: DataFrame, barrel_issues: DataFrame, cascades: DataFrame,
    duplicates: DataFrame, bridges: DataFrame | None = None, unregistered: DataFrame | None = None,
) -> DataFrame:
    """One row: the number of defects of every kind, the one source of the health score.

    cycles: classified strict cycles, of which diamonds are none. A parrot counts where its
    name is also dead. A twin counts by name if it has a shape in common with the first
    place and all its places are in one language; a duplicate counts unless its places have no shape
    in common.
    """
    scored = counted_dead(dead)
    shaped = twins.where("class IN ('EXACT', 'SHAPE_SIMILAR')").select("name").distinct()
    one_language = exports.groupBy("name").agg(F.count_distinct("language").alias("languages")).where("languages = 1").select("name")
    shapeless = twins.select("name").distinct().join(shaped, "name", "left_anti")
    none = F.lit(0).cast("long")
    parts = {
        "breaking_cycles": cycles.where("kind = 'hard_bidirectional'"), "structural_cycles": cycles.where("kind NOT IN ('hard_bidirectional', 'fan_pattern')"),
        "dead_exports": scored, "twins_dead_parrots": parrots.join(scored.select("name").distinct(), "name", "left_semi"),
        "twins_same_language": shaped.join(one_language, "name", "left_semi"), "barrel_chaos": barrel_issues, "cascade_imports": cascades,
        "duplicate_exports": duplicates.join(shapeless, "name", "left_anti"),
    }
    if bridges is not None:
        parts |= {"missing_handlers": bridges.where("status = 'missing'"), "unused_handlers": bridges.where("status = 'unused'")}
    if unregistered is not None:
        parts["unregistered_handlers"] = unregistered
    row = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).cast("long").alias("loc"))
    for name, df in parts.items():
        row = row.crossJoin(df.agg(F.count("*").alias(name)))
    names = [n for group in DEFECTS.values() for n in group]
    return row.select(*SIZES, *(F.col(n) if n in parts else none.alias(n) for n in names))


def health(defects: DataFrame) -> DataFrame:
    """100 less 50, 30 and 20 times the log rate of certain, high and smelly defects to lines, with the counts of each."""
    total = lambda group: sum((F.floor(F.col(n) / 5) if n == "duplicate_exports" else F.col(n) for n in DEFECTS[group]), F.lit(0)).cast("long")
    rate = lambda n: F.when((F.col("loc") > 0) & (n > 0), F.least(F.log1p(n) / F.log1p(F.col("loc")), F.lit(1.0))).otherwise(0.0)
    rows = defects.select(*SIZES, *(total(g).alias(g) for g in DEFECTS))
    penalty = CERTAIN * rate(F.col("certain")) + HIGH * rate(F.col("high")) + SMELL * rate(F.col("smell"))
    density = rate(F.col("certain") + F.col("high") + F.col("smell"))
    return rows.select("*", F.round(F.greatest(100 - penalty, F.lit(0.0))).cast("long").alias("score"), F.round(density, 6).alias("density"))


def zombies(dead: DataFrame, orphans: DataFrame, shadows: DataFrame, registry: DataFrame) -> DataFrame:
    """Files and exports that live on unused: orphan files, dead exports and the unused places of shadowed names."""
    row = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), "path", detail.cast("string").alias("detail"))
    unused = registry.where("import_count = 0").join(shadows.select("name"), "name", "left_semi")
    parts = row(orphans, "orphan_file", F.col("loc")), row(dead, "dead_export", F.col("name")), row(unused, "shadow_export", F.col("name"))
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def sniff(twins: DataFrame, parrots: DataFrame, crowds: DataFrame, least: float = 4.0) -> DataFrame:
    """Smells by name: how many twins, parrots and crowds of a score of at least `least`."""
    row = lambda df, kind: df.groupBy("name").agg(F.count("*").alias("n")).select("name", F.lit(kind).alias("smell"), "n")
    return row(twins, "twin").union(row(parrots, "parrot")).union(row(crowds.where(F.col("score") >= least), "crowd"))


def barrel_issues(missing: DataFrame, chains: DataFrame, inconsistent: DataFrame) -> DataFrame:
    """kind and target of every barrel problem."""
    row = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("target"))
    return row(missing, "missing_barrel", "directory").union(row(chains, "deep_chain", "src")).union(row(inconsistent, "inconsistent_path", "name"))


def production(df: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path is neither a test nor vendored, generated, fixture or template."""
    return df.where(~is_non_production(F.col(column)))
