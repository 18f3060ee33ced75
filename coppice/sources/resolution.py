"""Imports to the files that they lead to: relative paths, aliases, base folders, crates and packages.

Nothing is probed on a disk. Every import becomes a few candidates, each with a rank,
and one equality join with the paths of the files keeps the best that exists.

Aliases (`paths` of script configurations, with what they extend) are a table of patterns
keyed by the text before their first star. An import is exploded to its prefixes, met
with the patterns of the nearest configuration above it by equality, and the longest
prefix ranks first. Packages work the other way round: each Python file is named from
every root above it, so an import meets its module by equality. Crate paths are
exploded to their prefixes, and the deepest module file wins.

Defined results: an import of nothing known, a null name and a broken configuration give
a null; equal imports are resolved alike; cyclic `extends` ends; unknown columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.paths import basename, dirname, extension
from coppice.plans.storage import materialize
from coppice.plans.traversal import reach

# Endings that script paths may have, endings and index files that are tried, in this order.
SCRIPT_ENDINGS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "svelte", "vue", "astro")
TRIED = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".svelte", ".vue", ".astro", ".css", ".scss", ".py", ".rs", ".sh")
INDEXES = ("/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.svelte", "/index.vue", "/index.astro")
PACKAGE_FILES = ("/__init__.py", "/__init__.pyi", "/mod.py", ".py", ".pyi")
#: Files that mark a folder as a root of Python modules, beside the top folder and `src`.
ROOT_MARKS = ("pyproject.toml", "setup.py", "setup.cfg")
SCRIPTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "svelte", "vue", "astro")
CONFIG = "extends string, compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"


def joined(directory: Column, source: Column) -> Column:
    """A path below a directory, with `.` and `..` resolved."""
    parts = F.filter(F.split(F.concat_ws("/", directory, source), "/"), lambda x: ~x.isin("", "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.array_join(done, "/")


def above(path: Column) -> Column:
    """Every directory above a path, the top ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))


def configurations(texts: DataFrame) -> DataFrame:
    """dir, base (folder of plain names), alias and targets of every script configuration; alias is null in a row that tells the base alone.

    A configuration's own settings go before those that it extends; an alias is taken
    whole from the nearest one that has it. Comments and commas before an end are read.
    """
    named = texts.where(basename(F.col("path")).rlike(r"^(ts|js)config(\.[\w.-]+)?\.json$|^[\w.-]*tsconfig[\w.-]*\.json$"))
    clean = F.regexp_replace("content", r",(\s*[}\]])", "$1")
    parsed = named.select("path", F.from_json(clean, CONFIG, {"allowComments": "true"}).alias("c"))
    parsed = materialize(parsed.select("path", "c.extends", "c.compilerOptions.baseUrl", "c.compilerOptions.paths"), "configurations")
    up = joined(dirname(F.col("path")), F.col("extends"))
    up = F.when(F.endswith(up, F.lit(".json")), up).otherwise(F.concat(up, F.lit(".json")))
    leaves = parsed.where(basename(F.col("path")).isin("tsconfig.json", "jsconfig.json"))
    chain = reach(parsed.where("extends IS NOT NULL").select(F.col("path").alias("src"), up.alias("dst")), leaves.select(F.col("path").alias("source"), F.col("path").alias("node")))
    settings = chain.join(parsed, F.col("node") == F.col("path")).select("source", "depth", "baseUrl", "paths")
    base = settings.groupBy("source").agg(F.min_by("baseUrl", F.when(F.col("baseUrl").isNotNull(), F.col("depth"))).alias("baseUrl"))
    base = base.select("source", dirname(F.col("source")).alias("dir"), joined(dirname(F.col("source")), F.coalesce("baseUrl", F.lit("."))).alias("base"))
    aliases = settings.select("source", "depth", F.explode("paths").alias("alias", "targets")).groupBy("source", "alias").agg(F.min_by("targets", "depth").alias("targets"))
    return base.join(aliases, "source", "left").select("dir", "base", "alias", "targets")


def alias_patterns(settings: DataFrame) -> DataFrame:
    """dir, prefix (the text before a star), pattern and replacement as regular expressions, exact, place of every target."""
    stars = F.split("alias", r"\*")
    quoted = F.transform(stars, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E")))
    between = F.array_join(F.slice(quoted, 1, F.size(quoted) - 1), "(.*?)")
    pattern = F.when(F.size(stars) == 1, F.concat(F.lit("^"), quoted[0], F.lit("$"))).otherwise(F.concat(F.lit("^"), between, F.lit("(.*)"), F.element_at(quoted, -1), F.lit("$")))
    safe = F.regexp_replace("target", r"([$\\])", r"\\$1")
    # One star: its text goes to every star of the target; more: one after the other.
    pieces = F.split(safe, r"\*")
    numbered = F.aggregate(
        F.sequence(F.lit(1), F.size(pieces)), F.lit(""),
        lambda acc, n: F.concat(acc, F.element_at(pieces, n), F.when(n == F.size(pieces), "").otherwise(F.concat(F.lit("$"), F.when(F.size(stars) == 2, F.lit(1)).otherwise(F.least(n, F.size(stars) - 1)).cast("string")))),
    )
    rows = settings.where("alias IS NOT NULL").select("dir", "base", "alias", F.posexplode("targets").alias("place", "target"))
    listed = rows.select("dir", "base", stars[0].alias("prefix"), pattern.alias("pattern"), numbered.alias("replacement"), (F.size(stars) == 1).alias("exact"), "place")
    # Plain names are looked for in the base folder after all aliases.
    plain = settings.select("dir", "base").distinct().select("dir", "base", F.lit("").alias("prefix"), F.lit("^(.*)$").alias("pattern"), F.lit("$1").alias("replacement"), F.lit(False).alias("exact"), F.lit(1_000_000).alias("place"))
    return listed.unionByName(plain)


def _nearest(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows (path, ..) with `scope`, the deepest folder (dir) above the path; none without one."""
    spread = rows.select("path").distinct().select("path", F.explode(above(F.col("path"))).alias("dir"))
    found = spread.join(folders.select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("scope"))
    return rows.join(found, "path")


def _script_files(base: Column) -> Column:
    """Candidates of a script path in their order: with endings, as it is, index files; one that has a script's ending stands for itself alone."""
    ended = extension(base).isin(*SCRIPT_ENDINGS)
    tried = [F.concat(base, F.lit(e)) for e in TRIED]
    return F.when(ended, F.array(base)).otherwise(F.array(*tried, base, *(F.concat(base, F.lit(e)) for e in INDEXES)))


def _spread(rows: DataFrame, candidates: Column, via: Column | str, *ranks: Column) -> DataFrame:
    """path, name, via, rank and candidate of every candidate."""
    via = F.lit(via) if isinstance(via, str) else via
    out = rows.select("path", "name", via.alias("via"), F.array(*(r.cast("int") for r in ranks)).alias("before"), F.posexplode(candidates).alias("place", "candidate"))
    return out.select("path", "name", "via", F.array_append("before", F.col("place")).alias("rank"), "candidate")


def _scripts(asked: DataFrame, texts: DataFrame) -> list[DataFrame]:
    rows = asked.where(F.col("ext").isin(*SCRIPTS, "css", "scss", "html", "htm", "sh", "bash"))
    relative = rows.where("name LIKE '.%' OR NOT ext IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'mts', 'cts', 'svelte', 'vue', 'astro')")
    found = [_spread(relative, _script_files(joined(dirname(F.col("path")), F.col("name"))), "relative", F.lit(0), F.lit(0), F.lit(0))]
    settings = materialize(configurations(texts), "script-settings")
    scoped = _nearest(rows.where("name NOT LIKE '.%'").where(F.col("ext").isin(*SCRIPTS)), settings)
    patterns = alias_patterns(settings)
    asked_once = scoped.select("scope", "name").distinct().select("scope", "name", F.explode(F.sequence(F.lit(0), F.length("name"))).alias("n"))
    prefixed = asked_once.select(F.col("scope").alias("dir"), "name", F.substring(F.col("name"), F.lit(1), F.col("n")).alias("prefix"))
    hit = prefixed.join(patterns, ["dir", "prefix"]).where(F.expr("name RLIKE pattern"))
    target = joined(F.col("base"), F.expr("regexp_replace(name, pattern, replacement)"))
    hit = hit.select(F.col("dir").alias("scope"), "name", target.alias("target"), (~F.col("exact")).alias("wide"), (-F.length("prefix")).alias("short"), "place")
    rows = scoped.join(hit, ["scope", "name"])
    late = F.col("place") >= 1_000_000
    found.append(_spread(rows, _script_files(F.col("target")), F.when(late, "base").otherwise("alias"), F.col("wide").cast("int") + late.cast("int") + 1, F.col("short"), F.col("place")))
    # The conventional folder of one framework, which needs no configuration.
    kits = texts.where(basename(F.col("path")).rlike(r"^svelte\.config\.(js|ts)$")).select(dirname(F.col("path")).alias("dir"))
    kit = _nearest(asked.where(F.col("ext").isin(*SCRIPTS) & F.startswith("name", F.lit("$lib/"))), kits)
    found.append(_spread(kit, _script_files(joined(F.concat_ws("/", "scope", F.lit("src/lib")), F.substring("name", 6, 1 << 20))), "alias", F.lit(0), F.lit(0), F.lit(0)))
    return found


def _python(asked: DataFrame, files: DataFrame, texts: DataFrame) -> list[DataFrame]:
    rows = asked.where("ext IN ('py', 'pyi')")
    dots = F.length(F.regexp_extract("name", r"^(\.*)", 1))
    up = F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/")
    rest = F.replace(F.regexp_replace("name", r"^\.+", ""), F.lit("."), F.lit("/"))
    base = joined(F.concat_ws("/", dirname(F.col("path")), up), rest)
    relative = _spread(rows.where("name LIKE '.%'"), F.transform(F.array(*map(F.lit, PACKAGE_FILES)), lambda e: F.concat(base, e)), "relative", F.lit(0), F.lit(0), F.lit(0))
    # Roots by rank: the top folder, its src, then marked folders and their src.
    marked = texts.where(basename(F.col("path")).isin(*ROOT_MARKS)).select(dirname(F.col("path")).alias("dir")).where("dir <> ''")
    roots = marked.select("dir", F.lit(2).alias("rank")).union(marked.select(F.concat_ws("/", "dir", F.lit("src")), F.lit(3)))
    roots = roots.union(files.limit(1).select(F.explode(F.array(F.struct(F.lit("").alias("dir"), F.lit(0).alias("rank")), F.struct(F.lit("src").alias("dir"), F.lit(1).alias("rank")))).alias("r")).select("r.dir", "r.rank"))
    roots = roots.groupBy("dir").agg(F.min("rank").alias("rank"))
    modules = files.where("path RLIKE '\\.pyi?$'").select("path", F.explode(above(F.col("path"))).alias("dir")).join(roots, "dir")
    below = F.when(F.col("dir") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("dir") + 2, F.length("path")))
    ending = F.regexp_extract(below, r"(/__init__\.pyi?|/mod\.py|\.pyi?)$", 1)
    name = F.replace(F.substring(below, F.lit(1), F.length(below) - F.length(ending)), F.lit("/"), F.lit("."))
    place = F.array_position(F.array(*map(F.lit, PACKAGE_FILES)), ending)
    modules = modules.select(name.alias("name"), "rank", F.col("dir").alias("root"), F.struct(place.cast("int").alias("place"), F.col("path").alias("candidate")).alias("file"))
    hit = rows.where("name NOT LIKE '.%'").join(modules, "name")
    absolute = hit.select("path", "name", F.lit("package").alias("via"), F.array(F.lit(1), F.col("rank"), F.length("root"), F.col("file.place").cast("int")).alias("rank"), F.col("file.candidate").alias("candidate"))
    return [relative, absolute]


def _rust(asked: DataFrame, files: DataFrame) -> list[DataFrame]:
    rows = asked.where("ext = 'rs'")
    own, stem, here = basename(F.col("path")), F.regexp_replace("path", r"\.rs$", ""), dirname(F.col("path"))
    surface = own.isin("mod.rs", "lib.rs", "main.rs")
    # mod declarations: below the file's module, then beside the file.
    declared = rows.where("kind = 'mod'").select("path", "name", F.regexp_replace("name", "^mod::", "").alias("mod"), F.when(surface, here).otherwise(stem).alias("search"), here.alias("here"))
    both = lambda folder, m: [joined(folder, F.concat(m, F.lit(e))) for e in (".rs", "/mod.rs")]
    pathed = F.startswith("mod", F.lit("path:"))
    explicit = F.array(joined(F.col("here"), F.substring("mod", 6, 1 << 20)))
    found = [_spread(declared, F.when(pathed, explicit).otherwise(F.array(*both(F.col("search"), F.col("mod")), *both(F.col("here"), F.col("mod")))), "mod", F.lit(0), F.lit(0), F.lit(0))]
    used = rows.where("coalesce(kind, '') <> 'mod' AND name LIKE '%::%' AND NOT name RLIKE '^(std|core|alloc)::'")
    crates = files.where(basename(F.col("path")) == "Cargo.toml").select(dirname(F.col("path")).alias("dir"))
    with_src = files.where("path RLIKE '(^|/)src/'").select(F.explode(above(F.col("path"))).alias("dir")).where(F.endswith("dir", F.lit("src"))).distinct()
    crates = crates.withColumn("src", F.when(F.col("dir") == "", "src").otherwise(F.concat("dir", F.lit("/src"))))
    crates = crates.join(with_src.select(F.col("dir").alias("src"), F.lit(True).alias("there")), "src", "left").select("dir", F.when(F.col("there"), F.col("src")).otherwise(F.col("dir")).alias("base"))
    crated = _nearest(used.where("NOT name RLIKE '^(super|self)::'"), crates).join(crates.withColumnRenamed("dir", "scope"), "scope")
    crated = crated.select("path", "name", F.regexp_replace("name", "^crate::", "").alias("rest"), "base", F.lit(0).alias("order"))
    local = used.where("name RLIKE '^(super|self)::'")
    rest = F.regexp_replace("name", "^(super|self)::", "")
    # self: the file's own module; super: the module above it, then the folder above its folder.
    bases = F.when(F.startswith("name", F.lit("self")), F.array(F.when(own == "mod.rs", here).otherwise(stem))).when(surface, F.array(dirname(here))).otherwise(F.array(here, dirname(here)))
    local = local.select("path", "name", rest.alias("rest"), F.posexplode(bases).alias("order", "base"))
    walked = crated.select("path", "name", "rest", "base", "order").unionByName(local.select("path", "name", "rest", "base", "order"))
    segments = F.split("rest", "::")
    deep = walked.select("path", "name", "base", "order", segments.alias("s"), F.explode(F.sequence(F.lit(1), F.size(segments))).alias("n"))
    module = joined(F.col("base"), F.array_join(F.slice("s", F.lit(1), F.col("n")), "/"))
    found.append(_spread(deep, F.array(F.concat(module, F.lit(".rs")), F.concat(module, F.lit("/mod.rs"))), "crate", F.col("order"), -F.col("n"), F.lit(0)))
    return found


def resolve(imports: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """Import rows (path, name, kind, ..) with resolved_path and via, the way that found it; texts: path and content of at least the configurations."""
    asked = imports.select("path", "name", "kind").distinct().where("path IS NOT NULL AND name IS NOT NULL").withColumn("ext", extension(F.col("path")))
    options = None
    for rows in (*_scripts(asked, texts), *_python(asked, files, texts), *_rust(asked, files)):
        options = rows if options is None else options.unionByName(rows)
    there = options.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    best = there.groupBy("path", "name").agg(F.min_by(F.struct(F.col("candidate").alias("resolved_path"), "via"), "rank").alias("to"))
    best = best.select(F.col("path").alias("p"), F.col("name").alias("n"), "to.resolved_path", "to.via")
    return imports.join(best, (F.col("path") == F.col("p")) & (F.col("name") == F.col("n")), "left").drop("p", "n")
