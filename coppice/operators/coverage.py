"""Test coverage of exports and handlers, gaps, and the health of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covered_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Production exports that a test imports, by name or with the whole module."""
    prod, tests = exports.where("NOT is_test"), imports.where("is_test")
    named = tests.select(F.col("resolved_path").alias("path"), "name").distinct()
    whole = tests.where("name = '*'").select(F.col("resolved_path").alias("path")).distinct()
    return prod.join(named, ["path", "name"], "left_semi").union(prod.join(whole, "path", "left_semi").select(*prod.columns)).select("path", "name").distinct()


def coverage_report(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Per directory: production exports, covered ones and their share in percent."""
    covered = covered_exports(exports, imports).withColumn("covered", F.lit(1))
    rows = exports.where("NOT is_test").select("path", "name", "dir").distinct().join(covered, ["path", "name"], "left")
    grouped = rows.groupBy("dir").agg(F.count("*").alias("exports"), F.count("covered").alias("covered"))
    return grouped.withColumn("percent", F.round(100 * F.col("covered") / F.col("exports"), 6))


def coverage_gaps(exports: DataFrame, imports: DataFrame, handlers: DataFrame, called: DataFrame) -> DataFrame:
    """Untested handlers that are called (critical), exports used by several production files (medium), tested unused ones (low).

    Coarser than coverage: a test of a name counts for that name everywhere.
    """
    tested = imports.where("is_test").select("name").distinct()
    used = imports.where("NOT is_test AND name <> '*'").groupBy("name").agg(F.count_distinct("path").alias("users"))
    names = exports.where("NOT is_test").select("name").distinct()
    row = lambda df, kind, severity: df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.col("name").alias("target"))
    critical = handlers.select("name").distinct().join(called.select("name").distinct(), "name", "left_semi").join(tested, "name", "left_anti")
    medium = names.join(used.where("users >= 2"), "name").join(tested, "name", "left_anti")
    low = names.join(tested, "name", "left_semi").join(used, "name", "left_anti")
    return row(critical, "handler", "critical").union(row(medium, "export", "medium")).union(row(low, "export", "low"))


def insights(files: DataFrame, duplicates: DataFrame, cascades: DataFrame, bridges: DataFrame) -> DataFrame:
    """Observations that hold: huge files, many duplicates, many cascades, missing handlers."""
    kinds = [("huge_files", files.where("loc > 2000"), 0), ("many_duplicates", duplicates, 10), ("many_cascades", cascades, 20), ("missing_handlers", bridges.where("status = 'missing'"), 0)]
    rows = [df.agg(F.count("*").alias("n")).where(F.col("n") > above).select(F.lit(kind).alias("insight"), "n") for kind, df, above in kinds]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


def findings(dead: DataFrame, orphans: DataFrame, twins: DataFrame) -> DataFrame:
    """One table of findings: kind, target and detail."""
    row = lambda df, kind, target, detail: df.select(F.lit(kind).alias("kind"), F.col(target).alias("target"), F.col(detail).cast("string").alias("detail"))
    return row(dead, "dead_export", "path", "confidence").union(row(orphans, "orphan_file", "path", "loc")).union(row(twins, "twin", "path", "class"))


def sarif(found: DataFrame, tool: str = "coppice") -> DataFrame:
    """Each finding as a SARIF 2.1 result object in JSON, for a results array written line by line."""
    location = F.struct(F.struct(F.struct(F.col("target").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    result = F.struct(F.col("kind").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.col("detail").alias("text")).alias("message"), F.array(location).alias("locations"))
    return found.select("kind", "target", F.to_json(result).alias("result"), F.lit(tool).alias("tool"))
