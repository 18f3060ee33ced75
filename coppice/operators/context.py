"""What to read before a file is edited: its structure, its consumers, risks, next steps, and ranked rows cut to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.operators import graph
from coppice.plans.storage import materialize

# Files of a context that count as its hotspots, and importers from which a file has a high fan-in.
HOTSPOTS, HIGH_FAN_IN = 5, 10


def context_files(edges: DataFrame, files: DataFrame, targets: DataFrame, max_depth: int = 2) -> DataFrame:
    """target, path, role (target, dependency, consumer), depth, language and loc; a file can have two roles. Consumers have no depth."""
    known = files.select("path", "language", "loc")
    own = targets.select("path").distinct().join(known, "path").select(F.col("path").alias("target"), "path", F.lit("target").alias("role"), F.lit(0).alias("depth"), "language", "loc")
    needs = graph.dependencies(edges, targets, files, max_depth).drop("loc").join(known, "path").select("target", "path", F.lit("dependency"), "depth", "language", "loc")
    users = graph.consumers(edges, targets).join(known, "path").select("target", "path", F.lit("consumer"), F.lit(None).cast("int"), "language", "loc")
    return own.union(needs.where("target <> path")).union(users).withColumn("depth", F.col("depth").cast("long"))


def consumer_links(edges: DataFrame, targets: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """target, path, kind (direct, reexport, transitive) and imports_used of every consumer.

    imports_used: names that it imports from the target, and from elsewhere those that the target exports.
    """
    users = graph.consumers(edges, targets)
    labels = edges.groupBy(F.col("src").alias("path"), F.col("dst").alias("target")).agg(F.bool_and(F.col("label") == "reexport").alias("again"))
    rows = users.join(labels, ["path", "target"], "left")
    names = imports.where("name IS NOT NULL").select("path", "name", F.col("resolved_path").alias("led")).distinct()
    own = exports.select(F.col("path").alias("target"), "name").distinct().join(targets.select(F.col("path").alias("target")), "target", "left_semi").withColumn("exported", F.lit(True))
    used = users.join(names, "path").join(own, ["target", "name"], "left").where(F.coalesce(F.col("led") == F.col("target"), F.lit(False)) | F.coalesce("exported", F.lit(False)))
    used = used.groupBy("target", "path").agg(F.sort_array(F.collect_set("name")).alias("imports_used"))
    kind = F.when(F.col("again"), "reexport").when(F.col("again").isNotNull(), "direct").otherwise("transitive")
    return rows.join(used, ["target", "path"], "left").select("target", "path", kind.alias("kind"), F.coalesce("imports_used", F.array().cast("array<string>")).alias("imports_used"))


def context_risks(scope: DataFrame, edges: DataFrame) -> DataFrame:
    """target, path, importers, place among the target's hotspots (null beyond HOTSPOTS) and high_fan_in of imported files of a context."""
    importers = edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("importers"))
    rows = scope.select("target", "path").distinct().join(importers, "path")
    # A context is as large as its target's slice; its rows are ranked within the target.
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("importers"), "path"))
    rows = rows.withColumn("place", place)
    return rows.select("target", "path", "importers", F.when(F.col("place") <= HOTSPOTS, F.col("place")).cast("long").alias("place"), (F.col("importers") >= HIGH_FAN_IN).alias("high_fan_in"))


def next_steps(targets: DataFrame, edges: DataFrame, exports: DataFrame) -> DataFrame:
    """target, place, step and subject: what to look at, in order, before a file is edited."""
    used = edges.where("src <> dst").select(F.col("dst").alias("path")).distinct().withColumn("used", F.lit(True))
    first = exports.where("name IS NOT NULL").groupBy("path").agg(F.min_by("name", F.struct(F.coalesce("line", F.lit(0)), "name")).alias("symbol"))
    rows = targets.select("path").distinct().join(used, "path", "left").join(first, "path", "left")
    step = lambda name, subject, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("step"), subject.alias("subject")))
    path, symbol, named = F.col("path"), F.col("symbol"), F.col("symbol").isNotNull()
    steps = F.array(step("slice", path), step("impact", path, F.col("used")), step("body", symbol, named), step("literal", symbol, named), step("occurrences", symbol, named), step("follow", F.lit("")))
    rows = rows.select(F.col("path").alias("target"), F.posexplode(F.filter(steps, lambda s: s.isNotNull())).alias("place", "s"))
    return rows.select("target", (F.col("place") + 1).cast("long").alias("place"), "s.step", "s.subject")


def prefix_sums(rows: DataFrame, section: str, order: list[Column], cost: str) -> DataFrame:
    """Rows with `through`: the cost of all rows of their section up to and with them in an order that is total.

    Rows are dealt by ranges of the order; each range sums its own rows and takes the sum
    of the ranges before it from a table of a row per range and section.
    """
    ranged = rows.repartitionByRange(F.col(section), *order).sortWithinPartitions(F.col(section), *order)
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "ranges")
    sums = ranged.groupBy(section, "range").agg(F.sum(cost).alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(section).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col(section).alias("of"), F.col("range").alias("of_range"), F.coalesce(before, F.lit(0)).alias("before"))
    own = F.sum(cost).over(Window.partitionBy(section, "range").orderBy("at"))
    joined = ranged.withColumn("own", own).join(offsets, F.col(section).eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
    return joined.select(*rows.columns, (F.col("own") + F.col("before")).cast("long").alias("through"))


def within_budget(rows: DataFrame, section: str, order: list[Column], cost: str, budget: int, shares: dict[str, float]) -> DataFrame:
    """The first rows of every section that its share of a budget pays for, with `through`.

    Sections come in the order of shares; what one doesn't need goes to the next. A section
    ends before the first row that it can't pay; sections without a share, and rows without
    a cost, have no place.
    """
    rows = rows.where(F.col(section).isin(*shares) & F.col(cost).isNotNull())
    totals = {r[section]: r["n"] for r in rows.groupBy(section).agg(F.sum(cost).alias("n")).collect()}
    limits, carry = {}, 0
    for name, share in shares.items():
        limits[name] = int(budget * share) + carry
        carry = max(0, limits[name] - (totals.get(name) or 0))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col(section))
    return prefix_sums(rows, section, order, cost).where(F.col("through") <= limit)
