"""Where files belong by their layer, and in which order to move them there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.paths import basename, stem
from coppice.operators import graph
from coppice.operators.context import prefix_sums
from coppice.plans.storage import materialize

# The folder of each layer, and patterns of lower-case paths; the first layer that holds.
FOLDERS = {"ui": "ui", "app": "app", "kernel": "kernel", "infra": "infra", "test": "tests", "unknown": "misc"}
TEST = r"/test/|/tests/|/__tests__/|\.test\.|\.spec\.|_test\."
UI = r"/components/|/views/|/pages/|/ui/|/widgets/|/screens/|\.tsx$|\.vue$|\.svelte$|\.astro$"
APP = "/hooks/|/services/|/stores/|/state/|/context/|/providers/"
KERNEL = "/core/|/domain/|/models/|/entities/|/kernel/|/business/"
INFRA = "/utils/|/helpers/|/lib/|/infra/|/infrastructure/|/adapters/|/api/|/clients/"
#: Direct consumers, further dependents and lines from which a move is of high or of medium risk; a cycle is high.
HIGH, MEDIUM = (10, 50, 500), (5, 20, 200)
RISKS = ("low", "medium", "high")
SHIM = 3


def layer(path: Column) -> Column:
    """ui, app, kernel, infra, test or unknown, by the path alone."""
    low = F.lower(path)
    return (
        F.when(low.rlike(TEST), "test").when(low.rlike(UI) & ~low.rlike("use|store"), "ui").when(low.rlike(APP) | stem(path).rlike(r"^use\p{Lu}"), "app")
        .when(low.rlike(KERNEL), "kernel").when(low.rlike(INFRA), "infra").otherwise("unknown")
    )


def target_layers(files: DataFrame, edges: DataFrame) -> DataFrame:
    """path, layer and target_layer: its own, or for an unknown one that of most of its imports (the first by name of several), or infra."""
    led = edges.select(F.col("src").alias("path"), layer(F.col("dst")).alias("l")).where("l <> 'unknown'").groupBy("path", "l").agg(F.count("*").alias("n"))
    most = led.groupBy("path").agg(F.min_by("l", F.struct(-F.col("n"), "l")).alias("most"))
    rows = files.select("path", layer(F.col("path")).alias("layer")).join(most, "path", "left")
    return rows.select("path", "layer", F.when(F.col("layer") != "unknown", F.col("layer")).otherwise(F.coalesce("most", F.lit("infra"))).alias("target_layer"))


def risk(consumers: Column, further: Column, loc: Column, cyclic: Column) -> Column:
    over = lambda limits: (consumers >= limits[0]) | (further >= limits[1]) | (loc >= limits[2])
    return F.when(cyclic | over(HIGH), "high").when(over(MEDIUM), "medium").otherwise("low")


def move_plan(files: DataFrame, edges: DataFrame, base: Column | None = None) -> DataFrame:
    """A row per file that doesn't stand in its layer's folder: source, target, layers, risk, consumers, further, loc, reason, shim, phase and place.

    base: the folder that a file is moved within, its top folder if not said. Within it moves
    stand by risk, then fewer consumers, fewer lines, path; a phase is a risk that occurs.
    """
    base = F.substring_index("path", "/", 1) if base is None else base
    # Written, since what is asked of a layer would otherwise be asked where files are read, which may be one task.
    rows = materialize(files.select("path", "loc", base.alias("base")).join(target_layers(files, edges), "path"), "layers")
    own = F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), F.col("layer"))
    rows = rows.where((F.col("layer") == "unknown") | ~F.contains("path", own))
    counts = graph.all_impact_counts(edges, files).withColumnRenamed("target", "path")
    among = edges.join(files.select(F.col("path").alias("src"), base.alias("b1")), "src").join(files.select(F.col("path").alias("dst"), base.alias("b2")), "dst").where("b1 = b2").select("src", "dst", "label")
    cyclic = graph.import_cycles(among).select("path").withColumn("cyclic", F.lit(True))
    rows = rows.join(counts, "path").join(cyclic, "path", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    level = risk(F.col("direct"), F.col("dependents") - F.col("direct"), F.col("loc"), F.col("cyclic"))
    folder = F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), F.col("target_layer"))
    why = F.array_compact(F.array(F.when(F.col("layer") == "unknown", F.concat(F.lit("unclassified to "), "target_layer")), F.when(F.col("cyclic"), "in a cycle")))
    rows = rows.select(
        "base", F.col("path").alias("source"), F.concat_ws("/", "base", folder, basename(F.col("path"))).alias("target"), "layer", "target_layer", level.alias("risk"), F.col("direct").alias("consumers"),
        (F.col("dependents") - F.col("direct")).alias("further"), "loc", F.when(F.size(why) == 0, "misplaced").otherwise(F.array_join(why, ", ")).alias("reason"), (F.col("direct") > SHIM).alias("shim"),
    )
    number = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk"))
    levels = rows.groupBy("base").agg(F.collect_set(number).alias("levels"))
    rows = rows.join(levels, "base").withColumn("phase", F.size(F.filter("levels", lambda x: x <= number)).cast("long")).drop("levels").withColumn("one", F.lit(1))
    placed = prefix_sums(rows, "base", [F.col("phase"), F.col("consumers"), F.col("loc"), F.col("source")], "one")
    return placed.withColumnRenamed("through", "place").drop("one")


def shims(plan: DataFrame, exports: DataFrame) -> DataFrame:
    """old_path, new_path, symbols and importers of moves that many files import: what has to be exported again at the old place."""
    names = exports.where("name IS NOT NULL").groupBy(F.col("path").alias("source")).agg(F.sort_array(F.collect_set("name")).alias("symbols"))
    return plan.where("shim").join(names, "source").select(F.col("source").alias("old_path"), F.col("target").alias("new_path"), "symbols", F.col("consumers").alias("importers"))
