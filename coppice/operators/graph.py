"""Impact, slices, focus, importers, cycles and components of the import graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.paths import dirname, is_non_production, module_key
from coppice.plans.components import connected_components
from coppice.plans.storage import materialize
from coppice.plans.sweeps import dependents, reached
from coppice.plans.traversal import reach, strongly_connected


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _seeds(targets: DataFrame) -> DataFrame:
    return targets.select(F.col("path").alias("source"), F.col("path").alias("node"))


def impact(edges: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Files that depend on each target, with depth and the smallest of the shortest chains."""
    found = reach(reversed_edges(edges), _seeds(targets), max_depth, chains=True).where("depth > 0")
    return found.select(F.col("source").alias("target"), F.col("node").alias("path"), "depth", F.array_join("chain", " <- ").alias("chain"))


def _counted(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, node, depth) of dependents -> their numbers for every target."""
    counted = pairs.groupBy(F.col("source").alias("target")).agg(F.count(F.when(F.col("depth") == 1, 1)).alias("direct"), F.count("*").alias("dependents"), F.max("depth").alias("deepest"))
    rows = targets.select(F.col("path").alias("target")).distinct().join(counted, "target", "left")
    return rows.select("target", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("direct", "dependents", "deepest")))


def impact_counts(edges: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Direct and transitive dependents of every target, and the greatest depth."""
    return _counted(reach(reversed_edges(edges), _seeds(targets), max_depth).where("depth > 0 AND source <> node"), targets)


def all_impact_counts(edges: DataFrame, files: DataFrame) -> DataFrame:
    """As impact_counts() for every file, by sweeps of bitsets: no row per pair of files."""
    counts = dependents(edges.select("src", "dst", F.lit(True).alias("on")))
    rows = files.select(F.col("path").alias("target")).distinct().join(counts.withColumnRenamed("node", "target"), "target", "left")
    return rows.select("target", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("direct", "dependents", "deepest")))


def dependencies(edges: DataFrame, targets: DataFrame, files: DataFrame, max_depth: int = 2) -> DataFrame:
    """Files that each target needs, to a depth; files without a row are walked through and not returned."""
    found = reach(edges, _seeds(targets), max_depth).where("depth > 0")
    return found.join(files.select(F.col("path").alias("node"), "loc"), "node").select(F.col("source").alias("target"), F.col("node").alias("path"), "depth", "loc")


def consumers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Direct importers, and further ones only through files that re-export; without the target itself."""
    again = edges.where("label = 'reexport'").select(F.col("src").alias("node")).distinct()

    def on(frontier: DataFrame) -> DataFrame:
        return frontier.where("depth = 0").unionByName(frontier.where("depth > 0").join(again, "node", "left_semi").select(*frontier.columns))

    found = reach(reversed_edges(edges), _seeds(targets), through=on)
    return found.where("depth > 0 AND source <> node").select(F.col("source").alias("target"), F.col("node").alias("path"))


def focus(edges: DataFrame, files: DataFrame, directory: str, max_depth: int = 2) -> DataFrame:
    """A directory's files (core), what they need beyond it (deps) and who imports them from outside (consumers)."""
    inside = lambda c: (c == directory) | F.startswith(c, F.lit(directory + "/"))
    core = files.where(inside(F.col("path"))).select("path")
    out = edges.where(~inside(F.col("dst")))
    deps = reach(out, core.select(F.lit(directory).alias("source"), F.col("path").alias("node")), max_depth).where("depth > 0")
    users = edges.where(inside(F.col("dst")) & ~inside(F.col("src"))).select("src").distinct()
    part = lambda df, c, layer, depth: df.select(F.col(c).alias("path"), F.lit(layer).alias("layer"), depth.cast("long").alias("depth"))
    return part(core, "path", "core", F.lit(0)).union(part(deps, "node", "deps", F.col("depth"))).union(part(users, "src", "consumers", F.lit(1)))


def who_imports(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Importers of each target, also those that reach it through re-exports."""
    through = reach(reversed_edges(edges.where("label = 'reexport'")), _seeds(targets))
    rows = through.join(edges.select(F.col("dst").alias("node"), "src").distinct(), "node")
    return rows.where("src <> source").select(F.col("source").alias("target"), F.col("src").alias("path")).distinct()


def transitive_importers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Number of importers of every file that has any, re-exports followed: sets of importers flow along re-exports."""
    counts = dependents(edges.select("src", "dst", (F.col("label") == "reexport").alias("on")))
    rows = counts.join(files.select(F.col("path").alias("node")).distinct(), "node", "left_semi")
    return rows.select(F.col("node").alias("target"), F.col("dependents").alias("importers"))


def blast_radius(edges: DataFrame, targets: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Dependents along edges of some labels only."""
    return impact_counts(edges.where(F.col("label").isin(*labels)), targets)


def dynamic_reach(edges: DataFrame) -> DataFrame:
    """Files that are reached from the targets of lazy imports."""
    lazy = edges.where("label = 'lazy_import'").select(F.lit("dynamic").alias("source"), F.col("dst").alias("node"))
    found = reached(edges, lazy)
    found = reach(edges, lazy) if found is None else found
    return found.select(F.col("node").alias("path"), F.col("depth").cast("long").alias("depth"))


def components(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected components with their sizes and lines; files without edges are their own."""
    found = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    rows = files.join(found, files["path"] == found["node"], "left").select("path", "loc", F.coalesce("component", "path").alias("component"))
    return rows.groupBy("component").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


#: Edges that don't make a cycle at load time, and those that make none at all.
LAZY, NEVER = ("lazy_import", "type_import", "mod"), ("type_import", "mod")


def keyed_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between module keys, without those that only the keys make loops, and (key, path): the smallest path of each key."""
    key = lambda c: module_key(F.col(c))
    rows = edges.select("src", "dst", key("src").alias("s"), key("dst").alias("d"))
    paths = rows.select(F.col("s").alias("key"), F.col("src").alias("path")).union(rows.select("d", "dst")).groupBy("key").agg(F.min("path").alias("path"))
    return rows.where("s <> d OR src = dst").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct(), paths


def import_cycles(edges: DataFrame, strict: bool = False) -> DataFrame:
    """path, component of every module in an import cycle; component: the smallest path in it."""
    keyed, paths = keyed_edges(edges.where(~F.col("label").isin(*(LAZY if strict else NEVER))))
    found = strongly_connected(keyed).join(paths, F.col("node") == F.col("key")).select("path", F.col("component").alias("of"))
    return found.join(found.groupBy("of").agg(F.min("path").alias("component")), "of").select("path", "component")


def cyclic_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Raw edge rows with both ends in one cyclic component: src, dst, label, component."""
    side = lambda c, name: members.select(F.col("path").alias(c), F.col("component").alias(name))
    inside = edges.join(side("src", "c1"), "src").join(side("dst", "c2"), "dst").where("c1 = c2")
    return inside.select("src", "dst", "label", F.col("c1").alias("component"))


# Kinds of cycles with their severity.
CYCLE_SEVERITY = {"cfg_gated": 1, "wildcard_import": 2, "module_self_reference": 0, "fan_pattern": 0, "hard_bidirectional": 3, "unknown": 2}


def _parent_and_child(a: Column, b: Column) -> Column:
    """Whether a module's file stands for the directory of the other one."""
    bare = F.regexp_replace(F.regexp_replace(a, r"\.rs$", ""), "/mod$", "")
    return F.startswith(b, F.concat(bare, F.lit("/"))) | ((bare == dirname(b)) & (a != b))


def classified_cycles(edges: DataFrame, strict: bool = False) -> DataFrame:
    """A row per cyclic component: its smallest member, size, raw edges inside, kind, severity, compilability, risk and whether all members are fixtures or tests.

    Kinds in this order: conditional edges, wildcard imports, a module and its parent, a
    fan (a member that at least half of them import and that imports at most twice), two
    files or both directions at every member, unknown.
    """
    members = materialize(import_cycles(edges, strict), "cycles")
    inside = materialize(cyclic_edges(edges.where(~F.col("label").isin(*(LAZY if strict else NEVER))), members), "cycle-edges")
    ends = inside.select("component", F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(inside.select("component", "src", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("component", "path").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    sized = members.groupBy("component").agg(F.count("*").alias("size"), F.max("path").alias("last"), F.bool_and(is_non_production(F.col("path"))).alias("fixture"))
    per = degrees.join(sized.select("component", "size"), "component").groupBy("component").agg(
        F.bool_or((F.col("i") >= F.floor(F.col("size") / 2)) & (F.col("o") <= 2)).alias("fan"), F.bool_or((F.col("i") >= 2) & (F.col("o") <= 1)).alias("shared"),
        F.bool_and((F.col("i") > 0) & (F.col("o") > 0)).alias("both"),
    )
    label = F.col("label")
    marks = inside.groupBy("component").agg(
        F.count("*").alias("edges"), F.bool_or(label.rlike("cfg|conditional")).alias("cfg"), F.bool_or(label.rlike("wildcard")).alias("wildcard"),
        F.bool_or(label.isin("use", "import") | ((label == "mod") & F.endswith("src", F.lit("/mod.rs")))).alias("plain"), F.bool_and(label.rlike("type")).alias("types"),
    )
    pair = _parent_and_child(F.col("component"), F.col("last")) | _parent_and_child(F.col("last"), F.col("component"))
    kind = (
        F.when(F.col("cfg"), "cfg_gated").when(F.col("wildcard"), "wildcard_import").when((F.col("size") == 2) & pair, "module_self_reference")
        .when((F.col("size") >= 3) & F.col("fan"), "fan_pattern").when((F.col("size") >= 2) & F.col("both"), "hard_bidirectional").otherwise("unknown")
    )
    rows = sized.join(per, "component").join(marks, "component").withColumn("kind", kind)
    looked_at = F.col("kind").isin("hard_bidirectional", "wildcard_import") & ~F.col("plain") & ~F.col("types") & (F.col("size") >= 3) & F.col("shared")
    diamond = (F.col("kind") == "fan_pattern") | looked_at
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in CYCLE_SEVERITY.items() for x in kv]), F.col("kind"))
    return rows.select(
        "component", "size", "edges", "kind", severity.alias("severity"), F.when(diamond, "diamond").otherwise("structural").alias("compilability"),
        F.when(diamond, "none").when(F.col("size") > 5, "medium").otherwise("low").alias("risk"), "fixture",
    )


def lazy_cycles(edges: DataFrame) -> DataFrame:
    """Cyclic components that exist only with lazy edges: component, size.

    A component without lazy edges lies in one with them, so equal smallest members and
    sizes mean equal members.
    """
    sizes = lambda strict: import_cycles(edges, strict).groupBy("component").agg(F.count("*").alias("size"))
    return sizes(False).join(sizes(True), ["component", "size"], "left_anti")


def simple_cycles(edges: DataFrame, longest: int | None = None, each: int = 10) -> DataFrame:
    """Simple cycles, each from its smallest file; the first ones of every component by length and path.

    Paths grow by joins within a component, so no component is ever in one task. A
    component is done when it has its number of cycles or no open path is left.
    """
    members = materialize(import_cycles(edges), "cycles")
    steps = materialize(cyclic_edges(edges, members).select("src", "dst", "component").distinct(), "cycle-edges")
    paths = steps.where("src <= dst").select("component", F.col("src").alias("start"), F.array("src").alias("cycle"), F.col("dst").alias("at"))
    rows = paths.where("at = start").select("component", "cycle").limit(0)
    for _ in count() if longest is None else range(longest):
        closed = paths.where("at = start").select("component", "cycle")
        open_ = paths.where((F.col("at") > F.col("start")) & ~F.array_contains("cycle", F.col("at")))
        if not closed.isEmpty():
            rows = materialize(rows.union(closed), "closed-cycles")
        done = rows.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= each)
        open_ = open_.join(done, "component", "left_anti")
        walked = open_.withColumn("cycle", F.array_append("cycle", F.col("at"))).withColumnRenamed("at", "src").join(steps.select("src", "dst"), "src")
        paths = materialize(walked.select("component", "start", "cycle", F.col("dst").alias("at")), "cycle-paths")
        if paths.isEmpty():
            break
    order = Window.partitionBy("component").orderBy(F.size("cycle"), "cycle")
    ranked = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    return ranked.select(F.array_join("cycle", ">").alias("cycle"), F.size("cycle").cast("long").alias("length"))


def refactor_plan(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: dependents, direct consumers, whether in a cycle, risk and phase of moving it."""
    counts = all_impact_counts(edges, files)
    cyclic = import_cycles(edges).select("path").withColumn("cyclic", F.lit(True))
    rows = files.select("path", "loc").join(counts, F.col("path") == F.col("target"), "left").join(cyclic, "path", "left")
    n, loc, loop = F.coalesce("direct", F.lit(0)), F.col("loc"), F.coalesce("cyclic", F.lit(False))
    risk = F.when((n > 20) | (loc > 500) & loop, "high").when((n > 5) | (loc > 500) | loop, "medium").otherwise("low")
    return rows.select(
        "path", n.cast("long").alias("consumers"), F.coalesce("dependents", F.lit(0)).cast("long").alias("dependents"), loop.alias("cyclic"),
        (n > 3).alias("needs_shim"), risk.alias("risk"), F.when(risk == "low", 1).when(risk == "medium", 2).otherwise(3).cast("long").alias("phase"),
    )
