"""Repository metrics, import degrees, hubs, hotspots and ranked hub scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Edges that are inferred from names; they don't count as imports.
IMPLICIT = "implicit_symbol"


def repository_metrics(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, edges, total lines."""
    counted = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).cast("long").alias("total_loc"))
    return counted.crossJoin(edges.agg(F.count("*").alias("edges"))).select("files", "edges", "total_loc")


def incoming_imports(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: distinct direct importers, import edges, implicit importers; unknown targets have no lines."""
    real = F.col("label") != IMPLICIT
    counts = edges.groupBy(F.col("dst").alias("path")).agg(
        F.count_distinct(F.when(real, F.col("src"))).alias("importers_direct"),
        F.count(F.when(real, 1)).alias("import_edges"),
        F.count_distinct(F.when(~real, F.col("src"))).alias("importers_implicit"),
    )
    joined = files.select("path", "loc").join(counts, "path", "full_outer")
    return joined.select("path", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("loc", "importers_direct", "import_edges", "importers_implicit")))


def top_hubs(files: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """The files with most importers; ties by edges, then path."""
    order = [F.desc("importers_direct"), F.desc("import_edges"), F.asc("path")]
    return incoming_imports(files, edges).where("importers_direct > 0").orderBy(*order).limit(limit)


def hotspots(edges: DataFrame, min_imports: int = 0, leaves_only: bool = False) -> DataFrame:
    """Raw in- and out-degree and tier of every file with an edge."""
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("out_degree"))
    rows = into.join(out, "path", "full_outer").na.fill(0, ["in_degree", "out_degree"])
    tier = F.when(F.col("in_degree") >= 10, "CORE").when(F.col("in_degree") >= 3, "SHARED").when(F.col("in_degree") >= 1, "PERIPHERAL").otherwise("LEAF")
    rows = rows.withColumn("tier", tier).where(F.col("in_degree") >= min_imports)
    return rows.where("in_degree = 0") if leaves_only else rows


def hub_scores(files: DataFrame, edges: DataFrame, exports: DataFrame, commands: DataFrame, take: int = 30) -> DataFrame:
    """imports + 2 exports + 3 importers + 2 commands: the first `take`, and of these the scores above 5."""
    count = lambda df, key, name: df.groupBy(F.col(key).alias("path")).agg(F.count("*").alias(name))
    importers = edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("importers"))
    rows = files.select("path")
    for part in (count(edges, "src", "imports"), count(exports, "path", "exports"), importers, count(commands, "path", "commands")):
        rows = rows.join(part, "path", "left")
    rows = rows.na.fill(0)
    score = F.col("imports") + 2 * F.col("exports") + 3 * F.col("importers") + 2 * F.col("commands")
    return rows.withColumn("score", score).orderBy(F.desc("score"), "path").limit(take).where("score > 5")


def directory_tree(files: DataFrame, large: int = 900) -> DataFrame:
    """Per directory, all files below it: number, lines, and how many are large."""
    from coppice.functions.paths import prefixes

    rows = files.select(F.explode(prefixes(F.col("path"))).alias("directory"), "loc")
    return rows.groupBy("directory").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.count(F.when(F.col("loc") >= large, 1)).alias("large_files"))


def bounded(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows of a total order with total, emitted and truncated beside each."""
    total = rows.agg(F.count("*").alias("total"))
    first = rows.orderBy(*order).limit(limit)
    return first.crossJoin(total).withColumn("emitted", F.least(F.col("total"), F.lit(limit)).cast("long")).withColumn("truncated", F.col("total") > limit)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1 of a total order, with the next offset (null at the end)."""
    total = rows.agg(F.count("*").alias("total"))
    following = F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("long"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(total).withColumn("next_offset", following)


def quick_wins(findings: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Findings (kind, target) by kind order, numbered on while a running cap per kind allows."""
    kinds = list(caps)
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("kind"))
    within = F.row_number().over(Window.partitionBy("kind").orderBy("target"))
    return findings.where(F.col("kind").isin(*kinds)).withColumn("within", within).where(F.col("within") <= max(caps.values())).where(F.col("within") <= cap).select(
        "kind", "target", (rank * 1000 + F.col("within")).cast("long").alias("priority")
    )
