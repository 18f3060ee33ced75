"""Imported, re-exported and locally used names of source files.

Scripts and Rust are read by patterns over whole texts, so that clauses may span lines,
in Spark's own expressions; Python by its own parser in Arrow batches. Each row is one
name: path, line, kind, source (what the module is called there), name ('*' for all of
it) and alias. Kinds: static, type, side_effect, dynamic, lazy (inside a function),
reexport; and, without a source, use (a name that a file reads) and export.

Defined results: a null or empty text has no names; a Python text that doesn't parse has
one row of kind `unparsed`; names within comments are left out where the comment begins
its line.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.paths import extension

SCRIPTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "svelte", "vue", "astro")
COLUMNS = "path string, line bigint, kind string, source string, name string, alias string"
# Patterns of script clauses: (kind, pattern); groups are the clause and the source.
SCRIPT_CLAUSES = [
    ("static", r"(?m)^[ \t]*import\s+((?!type\b)[\w$*{][\w$*{},\s]*?)\s*from\s*['\"]([^'\"]+)['\"]"),
    ("type", r"(?m)^[ \t]*import\s+type\s+([\w$*{][\w$*{},\s]*?)\s*from\s*['\"]([^'\"]+)['\"]"),
    ("reexport", r"(?m)^[ \t]*export\s+(?:type\s+)?(\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s*['\"]([^'\"]+)['\"]"),
]
SCRIPT_WHOLE = [("side_effect", r"(?m)^[ \t]*import\s*['\"]([^'\"]+)['\"]"), ("dynamic", r"\bimport\(\s*['\"]([^'\"]+)['\"]"), ("static", r"\brequire\(\s*['\"]([^'\"]+)['\"]")]
EXPORT_LIST = r"(?m)^[ \t]*export\s*\{([^}]*)\}(?!\s*from)"
RUST_USE = r"(?m)^[ \t]*((?:pub(?:\([^)]*\))?\s+)?use)\s+([\w:]+?)(?:::(\{[^;]*\}|\*|\w+))?(\s+as\s+\w+)?\s*;"


def _line(content: Column, match: Column) -> Column:
    before = F.substring(content, F.lit(1), F.greatest(F.position(F.ltrim(match), content) - 1, F.lit(0)))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _named(clause: Column) -> Column:
    """(name, alias) of a clause: a default, `* as x`, or a list in braces, with `as`."""
    listed = F.split(F.regexp_replace(F.regexp_extract(clause, r"\{([^}]*)\}", 1), r"\btype\s+|\s+", " "), ",")
    outside = F.split(F.regexp_replace(clause, r"\{[^}]*\}", ""), ",")
    trimmed = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    pair = lambda name, alias: F.struct(name.alias("name"), alias.alias("alias"))
    none = F.lit(None).cast("string")
    inside = F.transform(trimmed(listed), lambda x: pair(F.regexp_extract(x, r"^([\w$*]+)", 1), F.nullif(F.regexp_extract(x, r"\bas ([\w$]+)$", 1), F.lit(""))))
    star = lambda x: F.startswith(x, F.lit("*"))
    others = F.transform(trimmed(outside), lambda x: pair(F.when(star(x), "*").otherwise("default"), F.when(star(x), F.nullif(F.regexp_extract(x, r"\bas ([\w$]+)$", 1), F.lit(""))).otherwise(F.coalesce(x, none))))
    return F.concat(inside, others)


def script_names(texts: DataFrame) -> DataFrame:
    rows = texts.where(extension(F.col("path")).isin(*SCRIPTS)).select("path", "content")
    out = None
    for kind, pattern in SCRIPT_CLAUSES:
        found = rows.select("path", "content", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("m"))
        each = found.select("path", _line(F.col("content"), F.col("m")).alias("line"), F.regexp_extract("m", pattern, 2).alias("source"), F.explode(_named(F.regexp_extract("m", pattern, 1))).alias("x"))
        part = each.select("path", "line", F.lit(kind).alias("kind"), "source", "x.name", "x.alias")
        out = part if out is None else out.unionByName(part)
    for kind, pattern in SCRIPT_WHOLE:
        found = rows.select("path", "content", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("m"))
        whole = F.lit("" if kind == "side_effect" else "*")
        out = out.unionByName(found.select("path", _line(F.col("content"), F.col("m")).alias("line"), F.lit(kind).alias("kind"), F.regexp_extract("m", pattern, 1).alias("source"), whole.alias("name"), F.lit(None).cast("string").alias("alias")))
    lists = rows.select("path", "content", F.explode(F.regexp_extract_all("content", F.lit(EXPORT_LIST), F.lit(0))).alias("m"))
    each = lists.select("path", _line(F.col("content"), F.col("m")).alias("line"), F.explode(_named(F.concat(F.lit("{"), F.regexp_extract("m", EXPORT_LIST, 1), F.lit("}")))).alias("x"))
    out = out.unionByName(each.select("path", "line", F.lit("export").alias("kind"), F.lit(None).cast("string").alias("source"), F.coalesce("x.alias", "x.name").alias("name"), F.lit(None).cast("string").alias("alias")))
    uses = rows.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("content", r"(?m)^[ \t]*(import|export)\b[^;\n]*|//[^\n]*|'[^'\n]*'|\"[^\"\n]*\"", ""), F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("name"))
    return out.unionByName(uses.select("path", F.lit(None).cast("long").alias("line"), F.lit("use").alias("kind"), F.lit(None).cast("string").alias("source"), "name", F.lit(None).cast("string").alias("alias")))


def rust_names(texts: DataFrame) -> DataFrame:
    """`use` clauses, also of lists in braces one deep; `pub use` is a re-export."""
    rows = texts.where(extension(F.col("path")) == "rs").select("path", "content")
    found = rows.select("path", "content", F.explode(F.regexp_extract_all("content", F.lit(RUST_USE), F.lit(0))).alias("m"))
    part = lambda n: F.regexp_extract("m", RUST_USE, n)
    last, plain = part(3), F.nullif(F.trim(F.regexp_replace(part(4), r"^\s*as\s+", "")), F.lit(""))
    listed = F.when(F.startswith(last, F.lit("{")), _named(last)).otherwise(F.array(F.struct(F.when(last == "", F.regexp_extract(part(2), r"([^:]+)$", 1)).otherwise(last).alias("name"), plain.alias("alias"))))
    kind = F.when(F.startswith(part(1), F.lit("pub")), "reexport").otherwise("static")
    return found.select("path", _line(F.col("content"), F.col("m")).alias("line"), kind.alias("kind"), part(2).alias("source"), F.explode(listed).alias("x")).select("path", "line", "kind", "source", "x.name", "x.alias")


def _python(content: str) -> list[tuple]:
    """(line, kind, source, name, alias) of one module."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(None, "unparsed", None, "", None)]
    out, inside, typed = [], set(), set()
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            inside.update(id(x) for x in ast.walk(node) if isinstance(x, ast.Import | ast.ImportFrom))
        elif isinstance(node, ast.If) and "TYPE_CHECKING" in ast.unparse(node.test):
            typed.update(id(x) for y in node.body for x in ast.walk(y))
    for node in ast.walk(tree):
        kind = "type" if id(node) in typed else "lazy" if id(node) in inside else "static"
        if isinstance(node, ast.Import):
            out += [(node.lineno, kind, x.name, "*", x.asname) for x in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(node.lineno, kind, "." * node.level + (node.module or ""), x.name, x.asname) for x in node.names]
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            out.append((None, "use", None, node.id, None))
        elif isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            called = ast.unparse(node.func)
            if called in ("importlib.import_module", "import_module", "__import__"):
                out.append((node.lineno, "dynamic", node.args[0].value, "*", None))
    listed = None
    for node in tree.body:
        names = []
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            names = [node.name]
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            names = [t.id for t in targets if isinstance(t, ast.Name)]
            if "__all__" in names and isinstance(node.value, ast.List | ast.Tuple):
                listed = {x.value for x in node.value.elts if isinstance(x, ast.Constant) and isinstance(x.value, str)}
        out += [(node.lineno, "export", None, n, None) for n in names if not n.startswith("_")]
    if listed is not None:
        out = [x for x in out if x[1] != "export" or x[3] in listed]
    return list(dict.fromkeys(out))


def python_names(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *x) for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in _python(content)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(cols)], names=["path", "line", "kind", "source", "name", "alias"]
            )

    rows = texts.where((extension(F.col("path")) == "py") & F.col("content").isNotNull())
    return rows.select("path", "content").mapInArrow(run, COLUMNS)


def names(texts: DataFrame) -> DataFrame:
    """All names of all languages that are read for them."""
    return script_names(texts).unionByName(rust_names(texts)).unionByName(python_names(texts))


def syntax_nodes(texts: DataFrame, kind: str) -> DataFrame:
    """path, line, column (from 1) and text of every node of a kind (such as Call or With) in Python files."""
    if not issubclass(getattr(ast, kind, type(None)), ast.AST):
        raise ValueError(f"{kind} is no kind of node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    tree = ast.parse(content)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                rows += [(path, n.lineno, n.col_offset + 1, ast.unparse(n).split("\n")[0]) for n in ast.walk(tree) if type(n).__name__ == kind and hasattr(n, "lineno")]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "line", "column", "text"])

    rows = texts.where((extension(F.col("path")) == "py") & F.col("content").isNotNull())
    return rows.select("path", "content").mapInArrow(run, "path string, line bigint, column bigint, text string")
