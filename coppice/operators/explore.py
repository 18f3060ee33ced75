"""Looking things up: slices of a file, places of a symbol, callers, ranked contexts, pages by cursor."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.paths import glob_regex, suffixes
from coppice.operators import graph


def resolve_targets(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked paths -> the file meant: an exact path, or else the only one that ends with it; otherwise ambiguous or missing."""
    clean = asked.select("asked", F.regexp_replace(F.replace("asked", F.lit("\\"), F.lit("/")), r"^(\./)+", "").alias("tail")).distinct()
    tails = files.select("path", F.explode(suffixes(F.col("path"))).alias("tail"))
    hits = clean.join(tails, "tail", "left").groupBy("asked").agg(
        F.count("path").alias("n"), F.max(F.when(F.col("path") == F.col("tail"), F.col("path"))).alias("exact"), F.min("path").alias("only")
    )
    path = F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")))
    state = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return hits.select("asked", path.alias("path"), state.alias("state"), F.col("n").alias("matches"))


def slice_report(edges: DataFrame, files: DataFrame, targets: DataFrame, handlers: DataFrame, symbol_uses: DataFrame, max_depth: int = 2) -> DataFrame:
    """Per target: its lines, what it needs and who uses it with their lines, its command handlers, and its symbols' consumers, which the totals leave out."""
    loc = files.select(F.col("path").alias("target"), "loc").join(targets.select(F.col("path").alias("target")), "target", "left_semi")
    needs = graph.dependencies(edges, targets, files, max_depth).groupBy("target").agg(F.count("*").alias("deps"), F.sum("loc").alias("deps_loc"))
    users = graph.consumers(edges, targets).join(files.select("path", "loc"), "path", "left").groupBy("target").agg(F.count("*").alias("consumers"), F.coalesce(F.sum("loc"), F.lit(0)).alias("consumers_loc"))
    bridges = handlers.groupBy(F.col("path").alias("target")).agg(F.count("*").alias("handlers"))
    named = symbol_consumers(symbol_uses).groupBy(F.col("owner").alias("target")).agg(F.count_distinct("path").alias("symbol_consumers"))
    rows = loc
    for part in (needs, users, bridges, named):
        rows = rows.join(part, "target", "left")
    rows = rows.na.fill(0)
    return rows.select("*", (1 + F.col("deps") + F.col("consumers")).alias("total_files"), (F.col("loc") + F.col("deps_loc") + F.col("consumers_loc")).alias("total_loc"))


def symbol_consumers(uses: DataFrame) -> DataFrame:
    """(owner, name, path) uses of a file's symbols from other files, each once."""
    return uses.where("owner <> path").select("owner", "name", "path").distinct()


def where_symbol(exports: DataFrame, locals_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Places of every name: exports, local symbols and graph nodes; of several at a (path, line) the richest, exports first.

    nodes: (path, name, start_line, end_line); one whose lines cover a known place of the name is left out.
    """
    known = exports.select("path", "name", "line", F.lit(0).alias("rank"), F.concat_ws(" ", F.lit("export"), "kind", "name").alias("context"))
    known = known.unionByName(locals_.select("path", "name", "line", F.lit(1).alias("rank"), F.concat_ws(" ", F.lit("local"), "kind", "name").alias("context")))
    known = known.where("line IS NOT NULL")
    n = nodes.select(F.col("path").alias("p"), F.col("name").alias("s"), "start_line", "end_line").distinct()
    covered = n.join(known, (F.col("p") == F.col("path")) & (F.col("s") == F.col("name")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_anti")
    rows = known.unionByName(covered.select(F.col("p").alias("path"), F.col("s").alias("name"), F.col("start_line").alias("line"), F.lit(2).alias("rank"), F.concat_ws(" ", F.lit("node"), "s").alias("context")))
    best = Window.partitionBy("path", "name", "line").orderBy("rank", "context")
    return rows.withColumn("place", F.row_number().over(best)).where("place = 1").select("name", "path", "line", "context")


def callers(symbol_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per symbol: who calls it, with the caller's file."""
    by = symbols.select(F.col("id").alias("src"), F.col("name").alias("caller"), F.col("path").alias("caller_path"))
    to = symbols.select(F.col("id").alias("dst"), "name", "path")
    return symbol_edges.where("kind = 'calls'").join(by, "src").join(to, "dst").select("name", "path", "caller", "caller_path").distinct()


def references(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per symbol: files and places that refer to it, definitions apart."""
    rows = occurrences.join(symbols.select(F.col("id").alias("symbol_id"), "name"), "symbol_id")
    n = lambda role: F.count(F.when(F.col("role") == role, 1))
    return rows.groupBy("symbol_id", "name").agg(F.count_distinct("path").alias("files"), n("definition").alias("definitions"), n("reference").alias("references"))


def merged_graphs(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both without those of equal keys in the second; of equal keys in one the smallest row."""
    tagged = first.withColumn("from", F.lit(1)).unionByName(second.withColumn("from", F.lit(2)))
    rest = [c for c in first.columns if c not in keys]
    best = tagged.groupBy(*keys).agg(F.min(F.struct("from", *rest)).alias("x"))
    return best.select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest), F.col("x.from").alias("source"))


def power_path(edges: DataFrame, files: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """Files around a task's seed files, ranked: near ones first, then those with most importers, then by path."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    from coppice.plans.traversal import reach

    near = reach(both, seeds.select(F.lit("task").alias("source"), F.col("path").alias("node")), max_depth).select(F.col("node").alias("path"), "depth")
    importers = edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("importers"))
    rows = near.join(files.select("path", "loc"), "path").join(importers, "path", "left").na.fill(0, ["importers"])
    score = 100 - 30 * F.col("depth") + F.least(F.col("importers"), F.lit(25))
    return rows.select("path", F.col("depth").cast("long").alias("depth"), "importers", "loc", score.cast("long").alias("score"))


def focused(groups: DataFrame, focus: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(name, path) members of groups: excluded members go first, then a group stays if any member is in focus and it still has two."""
    matches = lambda globs: F.col("path").rlike("|".join(map(glob_regex, globs)))
    rows = groups.where(~matches(exclude)) if exclude else groups
    kept = rows.groupBy("name").agg(F.count("*").alias("n"), (F.bool_or(matches(focus)) if focus else F.lit(True)).alias("hit")).where("n > 1 AND hit")
    return rows.join(kept.select("name"), "name", "left_semi").select("name", "path")


def cursor_page(rows: DataFrame, keys: list[str], fingerprint: str, limit: int, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """The rows after a cursor in the order of the keys, and the cursor of the next page.

    limit: 1 to 500. A cursor of another state of the rows is refused.
    """
    if not 1 <= limit <= 500:
        raise ValueError("a page has 1 to 500 rows")
    if cursor:
        state, last = json.loads(cursor)
        if state != fingerprint:
            raise ValueError("the cursor is of another snapshot")
        rows = rows.where(F.struct(*keys) > F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, last, strict=True))))
    found = rows.orderBy(*keys).limit(limit + 1).collect()
    page = rows.sparkSession.createDataFrame(found[:limit], rows.schema)
    return page, json.dumps([fingerprint, [found[limit - 1][k] for k in keys]]) if len(found) > limit else None


def write_artifacts(path: str, **tables: DataFrame) -> None:
    """Each table as JSON lines below path, and a manifest of their names, columns and rows."""
    manifest = None
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").json(f"{path}/{name}")
        row = df.sparkSession.read.schema(df.schema).json(f"{path}/{name}").agg(F.count("*").alias("rows"))
        row = row.select(F.lit(name).alias("name"), F.lit(",".join(df.columns)).alias("columns"), "rows")
        manifest = row if manifest is None else manifest.union(row)
    if manifest is not None:
        manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


# Type names of the language itself.
SWIFT_TYPES = ("Any", "AnyObject", "Array", "Bool", "Character", "Data", "Date", "Dictionary", "Double", "Error", "Float", "Int", "Optional", "Result", "Set", "String", "URL", "UUID", "Void")


def type_references(texts: DataFrame, local: DataFrame) -> DataFrame:
    """Capitalised names of Swift texts with their places: local if a file declares them, external if the language does, else unknown."""
    rows = texts.where(F.endswith("path", F.lit(".swift"))).select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    names = rows.select("path", (F.col("i") + 1).cast("long").alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Za-z0-9_]*)\b"), F.lit(1)))).alias("name"))
    known = local.select("name").distinct().withColumn("local", F.lit(True))
    origin: Column = F.when(F.col("local"), "local").when(F.col("name").isin(*SWIFT_TYPES), "external").otherwise("unknown")
    return names.join(known, "name", "left").select("path", "line", "name", origin.alias("origin"))
