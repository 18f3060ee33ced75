"""Definitions and the lines of their bodies, from lexed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.paths import extension

# Fixed values: (endings, pattern of code that defines a name).
DEFINING = [
    (("ts", "tsx", "js", "jsx", "mjs", "cjs"), r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)"),
    (("py", "pyi"), r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)"),
    (("rs",), r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:fn|struct|enum|trait|mod|const|static|type)\s+(\w+)"),
    (("go",), r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)"),
    (("sh", "bash", "zsh"), r"^\s*(?:function\s+)?(\w+)\s*\(\)"),
]


def definitions(lexed: DataFrame) -> DataFrame:
    """path, name, line, depth and body_end of every definition that stands in code."""
    ext, found = extension(F.col("path")), F.lit(None)
    for endings, pattern in reversed(DEFINING):
        found = F.when(ext.isin(*endings), F.regexp_extract("code", pattern, 1)).otherwise(found)
    rows = lexed.where("code IS NOT NULL").select("path", found.alias("name"), "line", "depth", "body_end")
    return rows.where("name <> ''")


def bodies(named: DataFrame, lexed: DataFrame) -> DataFrame:
    """path, name, line and last_line of definitions (path, name, line): to the bracket or line that ends them.

    A statement that nothing ends goes to the line before the next definition of its depth.
    Definitions in files without lexed lines have no row; those of definitions() know their line's depth and end already.
    """
    rows = named
    if not {"depth", "body_end"} <= set(named.columns):
        rows = named.select("path", "name", "line").join(lexed.select("path", "line", "depth", "body_end"), ["path", "line"])
    rows = rows.where("body_end IS NOT NULL")
    following = F.lead("line").over(Window.partitionBy("path", "depth").orderBy("line", "name"))
    # In Python depth is indentation, and bodies end by it already.
    rows = rows.withColumn("next", F.when((following > F.col("line")) & ~extension(F.col("path")).isin("py", "pyi"), following))
    last = F.when(F.col("next") <= F.col("body_end"), F.greatest(F.col("next") - 1, "line")).otherwise(F.col("body_end"))
    return rows.select("path", "name", "line", last.alias("last_line"))


def sources(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Bodies with their source text."""
    rows = found.join(texts.select("path", F.split("content", "\n").alias("lines")), "path")
    return rows.select(*found.columns, F.array_join(F.slice("lines", F.col("line").cast("int"), (F.col("last_line") - F.col("line") + 1).cast("int")), "\n").alias("source"))
