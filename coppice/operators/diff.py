"""Differences of snapshots, overlaps of term and task sets, suppressions and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.paths import dirname, matches_glob, prefixes


def set_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of one side only, as added or removed."""
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).union(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def diff_impact(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """Importers of files whose outgoing edges changed, each once."""
    changed = changes.select(F.col("src").alias("dst")).distinct()
    return edges.join(changed, "dst", "left_semi").select(F.col("src").alias("path")).distinct()


def diff_risk(removed_files: int, modified_files: int, edges_removed: int, exports_removed: int) -> float:
    return round(min(1.0, 0.1 * removed_files + 0.05 * modified_files + 0.05 * edges_removed + 0.15 * exports_removed), 6)


def change_summary(changes: DataFrame) -> DataFrame:
    """One row: added, removed and the risk score of an edge diff."""
    counted = changes.agg(F.count(F.when(F.col("change") == "added", 1)).alias("added"), F.count(F.when(F.col("change") == "removed", 1)).alias("removed"))
    return counted.withColumn("risk", F.round(F.least(F.lit(1.0), 0.05 * F.col("removed")), 6))


def cross_match(hits: DataFrame, least: int = 2) -> DataFrame:
    """Files that hold several different terms."""
    grouped = hits.groupBy("path").agg(F.count_distinct("term").alias("terms"), F.count("*").alias("hits"))
    return grouped.where(F.col("terms") >= least)


def prism(packs: DataFrame) -> DataFrame:
    """Overlap of tasks' file sets (task, path): size of the union, shared by all, and by at least two."""
    tasks = packs.agg(F.count_distinct("task").alias("tasks"))
    grouped = packs.groupBy("path").agg(F.count_distinct("task").alias("n")).crossJoin(tasks)
    return grouped.agg(
        F.count("*").alias("union_files"), F.count(F.when(F.col("n") == F.col("tasks"), 1)).alias("shared_by_all"), F.count(F.when(F.col("n") >= 2, 1)).alias("shared")
    )


def suppress(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings (kind, symbol, path) without those that a rule names; a rule without a path holds everywhere."""
    f, r = findings.alias("f"), rules.alias("r")
    same = (F.col("f.kind") == F.col("r.kind")) & (F.col("f.symbol") == F.col("r.symbol"))
    return f.join(r, same & (F.col("r.path").isNull() | (F.col("r.path") == F.col("f.path"))), "left_anti")


def scope(files: DataFrame, edges: DataFrame, exports: DataFrame, globs: list[str] = (), imports: list[str] = (), reach: list[str] = ()) -> DataFrame:
    """Files of any selector: a path glob, one import step from a file, or exporting a name."""
    if not (globs or imports or reach):
        raise ValueError("an empty scope")
    parts = [files.where(matches_glob(F.col("path"), g)).select("path", F.lit(f"path:{g}").alias("selector")) for g in globs]
    parts += [edges.where(F.col("src") == i).select(F.col("dst").alias("path"), F.lit(f"import:{i}").alias("selector")) for i in imports]
    parts += [exports.where(F.col("name") == n).select("path", F.lit(f"reach:{n}").alias("selector")) for n in reach]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("selector")), ",").alias("selectors"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row that tells whether two tables hold the same rows, in any order: their number and combined hash."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0)).alias("fingerprint"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files to be read again: not in the old scan with equal time and size, or gone from the new one."""
    key = ["path", "mtime", "loc"]
    fresh = new.join(old, key, "left_anti").select("path", F.lit("changed").alias("state"))
    return fresh.union(old.join(new, "path", "left_anti").select("path", F.lit("gone").alias("state")))


def directory_digests(files: DataFrame) -> DataFrame:
    """dir, files, and two hashes of all files below every directory ('.' is the top): equal ones mean equal content, in any order.

    files: (path, fingerprint). A file counts in every directory above it; sums and exclusive
    ors of its hashes are taken where it is read, so only a row per directory is shuffled.
    """
    hashes = [F.xxhash64("path", "fingerprint"), F.xxhash64("fingerprint", F.lit(7), "path")]
    rows = files.select(hashes[0].alias("h1"), hashes[1].alias("h2"), F.explode(prefixes(F.col("path"))).alias("dir"))
    return rows.groupBy("dir").agg(F.count("*").alias("files"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))


def changed_directories(old: DataFrame, new: DataFrame) -> DataFrame:
    """dir and change (added, removed, changed) of directories whose digests differ."""
    side = lambda df, n: df.select("dir", F.struct("files", "x1", "x2").alias(n))
    rows = side(old, "a").join(side(new, "b"), "dir", "full_outer").where("NOT a <=> b")
    return rows.select("dir", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def changed_contents(old: DataFrame, new: DataFrame, old_digests: DataFrame | None = None) -> DataFrame:
    """path and change of every file (path, fingerprint) that was added, removed or changed; only directories that differ are compared.

    old_digests: those that were stored with the old scan, so that it is read only where it differs.
    """
    differ = changed_directories(directory_digests(old) if old_digests is None else old_digests, directory_digests(new)).select("dir")
    own = F.when(F.contains("path", F.lit("/")), dirname(F.col("path"))).otherwise(".")
    side = lambda df, n: df.withColumn("dir", own).join(differ, "dir", "left_semi").select("path", F.col("fingerprint").alias(n))
    rows = side(old, "a").join(side(new, "b"), "path", "full_outer").where("NOT a <=> b")
    return rows.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
