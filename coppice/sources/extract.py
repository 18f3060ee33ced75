"""Source files to symbol tables with Spark's own text functions.

A language is a list of rules: a table, a pattern for one line and what its groups are.
Files are read with the binary or text sources, split into lines once, and every rule
is a regular expression over a line, so extraction runs in the JVM, scales with the
number of lines, and a language is added by adding rows to a table.

It reads declarations and imports that stand on one line; a parser's view of nested or
many-line constructs is out of its reach.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions.paths import artifact_class, basename, dirname, extension, file_kind, is_test_path, matches_glob
from coppice.plans.storage import measured
from coppice.sources import ignore as rules

# Fixed values: (extensions, table, kind, pattern of a line); the first group is the name or source.
RULES = [
    (("py",), "imports", "static", r"^\s*from\s+([\w.]+)\s+import\s"),
    (("py",), "imports", "static", r"^\s*import\s+([\w.]+)"),
    (("py",), "exports", "function", r"^(?:async\s+)?def\s+([A-Za-z]\w*)"),
    (("py",), "exports", "class", r"^class\s+([A-Za-z]\w*)"),
    (("py",), "exports", "const", r"^([A-Z][A-Z0-9_]*)\s*(?::[^=]*)?=[^=]"),
    (("ts", "tsx", "js", "jsx"), "imports", "static", r"^\s*import\s[^'\"]*from\s+['\"]([^'\"]+)['\"]"),
    (("ts", "tsx", "js", "jsx"), "imports", "side_effect", r"^\s*import\s+['\"]([^'\"]+)['\"]"),
    (("ts", "tsx", "js", "jsx"), "imports", "dynamic", r"\bimport\(\s*['\"]([^'\"]+)['\"]"),
    (("ts", "tsx", "js", "jsx"), "imports", "reexport", r"^\s*export\s+(?:\*|\{[^}]*\})\s+from\s+['\"]([^'\"]+)['\"]"),
    (("ts", "tsx", "js", "jsx"), "exports", "function", r"^\s*export\s+(?:default\s+)?(?:async\s+)?function\s+(\w+)"),
    (("ts", "tsx", "js", "jsx"), "exports", "class", r"^\s*export\s+(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    (("ts", "tsx", "js", "jsx"), "exports", "const", r"^\s*export\s+(?:const|let|var)\s+(\w+)"),
    (("ts", "tsx", "js", "jsx"), "exports", "type", r"^\s*export\s+(?:type|interface|enum)\s+(\w+)"),
    (("ts", "tsx", "js", "jsx"), "calls", "command", r"\binvoke\(\s*['\"](\w+)['\"]"),
    (("ts", "tsx", "js", "jsx"), "emits", "event", r"\bemit\(\s*['\"]([\w:/-]+)['\"]"),
    (("ts", "tsx", "js", "jsx"), "listens", "event", r"\blisten\(\s*['\"]([\w:/-]+)['\"]"),
    (("rs",), "imports", "static", r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    (("rs",), "imports", "mod", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;"),
    (("rs",), "exports", "function", r"^\s*pub(?:\([^)]*\))?\s+(?:async\s+)?fn\s+(\w+)"),
    (("rs",), "exports", "class", r"^\s*pub(?:\([^)]*\))?\s+(?:struct|enum|trait)\s+(\w+)"),
    (("rs",), "exports", "const", r"^\s*pub(?:\([^)]*\))?\s+(?:const|static)\s+(\w+)"),
    (("go",), "exports", "function", r"^func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)"),
    (("go",), "exports", "class", r"^type\s+([A-Z]\w*)"),
    (("sh", "bash"), "imports", "source", r"^\s*(?:source|\.)\s+([\w./-]+)"),
    (("sh", "bash"), "exports", "function", r"^\s*(?:function\s+)?(\w+)\s*\(\)"),
    (("css", "scss"), "imports", "static", r"^\s*@import\s+['\"]([^'\"]+)['\"]"),
    (("html", "htm"), "imports", "script", r"<script[^>]*\ssrc=['\"]([^'\"]+)['\"]"),
    (("html", "htm"), "imports", "link", r"<a\s[^>]*href=['\"]([^'\"#]+)['\"]"),
    (("py", "ts", "tsx", "js", "jsx", "rs", "sh"), "env_reads", "env", r"(?:environ(?:\.get)?[\[(]\s*['\"]|process\.env\.|env::var\(\s*\"|\$\{?)([A-Z][A-Z0-9_]{2,})"),
    (("py",), "routes", "route", r"^\s*@\w+\.(?:get|post|put|delete|patch|route)\(\s*['\"]([^'\"]+)"),
    (("py",), "races", "shared_state", r"^\s*global\s+(\w+)"),
    (("makefile", "mk"), "exports", "target", r"^([A-Za-z0-9_.-]+)\s*:(?!=)"),
    (("env", "envrc"), "env_declarations", "dotenv", r"^\s*(?:export\s+)?([A-Z][A-Z0-9_]*)\s*="),
    (("dockerfile",), "env_declarations", "dockerfile", r"^\s*(?:ENV|ARG)\s+([A-Z][A-Z0-9_]*)"),
    (("yml", "yaml"), "env_declarations", "compose", r"^\s*-\s*([A-Z][A-Z0-9_]*)="),
    (("yml", "yaml"), "env_declarations", "k8s", r"^\s*-?\s*name:\s*([A-Z][A-Z0-9_]+)\s*$"),
]


def read_files(spark: SparkSession, root: str, ignore: tuple[str, ...] = ("**/.git/**", "**/node_modules/**"), ignore_files: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), content, mtime and length of every file under root that no ignore pattern matches and that is UTF-8 text.

    ignore_files: names of ignore files whose rules hold as well, for instance ignore.NAMES.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    raw = raw.select("path", "content", F.unix_timestamp("modificationTime").alias("mtime"), "length")
    raw = raw.unionByName(_hidden_files(spark, root))
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    above = root.rstrip("/").replace("file://", "") + "/"
    rows = raw.select(F.when(F.startswith(path, F.lit(above)), F.substring(path, F.lit(len(above) + 1), F.length(path))).otherwise(path).alias("path"), "content", "mtime", "length")
    for pattern in ignore:
        rows = rows.where(~matches_glob(F.concat(F.lit("/"), "path"), pattern))
    text = F.when(F.position(F.lit(b"\0"), F.col("content")) == 0, F.try_validate_utf8(F.col("content").cast("string")))
    texts = rows.select("path", text.alias("content"), "mtime", "length").where("content IS NOT NULL")
    return rules.kept(texts, rules.rules(texts, ignore_files)) if ignore_files else texts


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or local path, which may have any characters."""
    local = uri.removeprefix("file://") if uri.startswith("file://") else uri if "://" not in uri else None
    return (fs.LocalFileSystem(), local) if local is not None else fs.FileSystem.from_uri(uri)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """uri, hidden, mtime and length of every file below root, one round of tasks for each level of folders; links to folders aren't followed."""
    base = _located(root)[1].rstrip("/")
    scheme = root.split("://")[0] + "://" + root.split("://")[1].split("/")[0] if "://" in root and not root.startswith("file:") else ""
    schema = "uri string, folder boolean, hidden boolean, mtime bigint, length bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, hidden in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = _located(uri)
                found = [x for x in store.get_file_info(fs.FileSelector(at)) if x.is_file or not (isinstance(store, fs.LocalFileSystem) and os.path.islink(x.path))]
                columns = [scheme + x.path for x in found], [not x.is_file for x in found], [hidden or x.base_name[0] in "._" for x in found], [int(x.mtime.timestamp()) for x in found], [x.size or 0 for x in found]
                kinds = pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["uri", "folder", "hidden", "mtime", "length"])

    folders, files = spark.createDataFrame([(scheme + base, False)], "uri string, hidden boolean"), None
    while True:
        level, seen = measured(folders.repartition("uri").mapInArrow(run, schema), "tree-level", n=F.count_if("folder"))
        found = level.where("NOT folder").drop("folder")
        files = found if files is None else files.unionByName(found)
        if not seen["n"]:
            return files
        folders = level.where("folder").select("uri", "hidden")


def _hidden_files(spark: SparkSession, root: str) -> DataFrame:
    """Files whose names begin with a dot or an underscore, which Spark's file sources don't list; tasks find and read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for uri in batch.column(0).to_pylist():
                at, path = _located(uri)
                with at.open_input_stream(path, compression=None) as source:
                    content.append(source.read())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), batch.column(1), batch.column(2)], names=["path", "content", "mtime", "length"])

    names = list_tree(spark, root).where("hidden").select("uri", "mtime", "length").repartition("uri")
    return names.mapInArrow(run, "path string, content binary, mtime bigint, length bigint")


def file_table(texts: DataFrame) -> DataFrame:
    """The files table of path and content."""
    return texts.select(
        "path", dirname(F.col("path")).alias("dir"), extension(F.col("path")).alias("language"), file_kind(F.col("path")).alias("kind"),
        F.size(F.split("content", "\n")).cast("long").alias("loc"), is_test_path(F.col("path")).alias("is_test"),
        artifact_class(F.col("path"), F.col("content")).alias("artifact"), F.sha2(F.col("content").cast("binary"), 256).alias("fingerprint"),
    )


def extract(texts: DataFrame) -> DataFrame:
    """path, line, table, kind and name of everything that a rule finds."""
    ext = extension(F.col("path"))
    rows = texts.select("path", F.when(ext == "", F.lower(basename(F.col("path")))).otherwise(ext).alias("ext"), F.posexplode(F.split("content", "\n")).alias("i", "text"))
    found = F.array(*[
        F.struct(F.lit(table).alias("table"), F.lit(kind).alias("kind"), F.when(F.col("ext").isin(*exts) & F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 1)).alias("name"))
        for exts, table, kind, pattern in RULES
    ])
    hits = rows.select("path", (F.col("i") + 1).cast("long").alias("line"), F.explode(F.filter(found, lambda x: x["name"].isNotNull())).alias("x"))
    return hits.select("path", "line", "x.*")


def import_edges(resolved: DataFrame) -> DataFrame:
    """Edges of resolved imports, with the label that the graph operators know."""
    label = F.when(F.col("kind") == "reexport", "reexport").when(F.col("kind") == "dynamic", "lazy_import").when(F.col("kind") == "mod", "mod").otherwise("import")
    return resolved.where("resolved_path IS NOT NULL").select(F.col("path").alias("src"), F.col("resolved_path").alias("dst"), label.alias("label"))


PACKAGE = "name string, version string, main string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>"
# Files and dependencies that tell a framework.
FRAMEWORKS = {"react": ("dependency", "react"), "vue": ("dependency", "vue"), "express": ("dependency", "express"), "rust": ("file", "Cargo.toml"), "python": ("file", "pyproject.toml"), "node": ("file", "package.json")}


def packages(texts: DataFrame) -> DataFrame:
    """A row per package.json: path, name, version, entry file and numbers of scripts and dependencies; broken JSON gives nulls."""
    m = texts.where(basename(F.col("path")) == "package.json").select("path", F.from_json("content", PACKAGE).alias("m"))
    count = lambda c: F.coalesce(F.size(F.map_keys(c)), F.lit(0)).cast("long")
    return m.select("path", "m.name", "m.version", "m.main", count("m.scripts").alias("scripts"), (count("m.dependencies") + count("m.devDependencies")).alias("dependencies"))


def frameworks(texts: DataFrame) -> DataFrame:
    """Frameworks that a marker file or a declared dependency tells, with the first path that does."""
    m = texts.where(basename(F.col("path")) == "package.json").select("path", F.from_json("content", PACKAGE).alias("m"))
    deps = m.select("path", F.explode(F.map_keys("m.dependencies")).alias("name"), F.lit("dependency").alias("by"))
    marks = deps.union(texts.select("path", basename(F.col("path")).alias("name"), F.lit("file").alias("by")))
    rules = F.explode(F.array(*[F.struct(F.lit(f).alias("framework"), F.lit(by).alias("rule_by"), F.lit(n).alias("rule_name")) for f, (by, n) in FRAMEWORKS.items()]))
    hits = marks.select("path", "name", "by", rules.alias("r")).where("r.rule_by = by AND r.rule_name = name")
    return hits.groupBy(F.col("r.framework").alias("framework")).agg(F.min("path").alias("evidence"))
