"""Ignore files: ordered patterns of many nested files, the last match of the nearest one wins.

A file's rules are one array in their order, keyed by the folder that they hold for.
Every path and every folder above it is a subject; it meets the rules of the folders
above it by equality, and the deepest folder with a matching rule decides by its last
one, `!` included. A file goes if it, or a folder above it, is ignored, so nothing below
an ignored folder comes back.

Defined results: comments, empty lines and directives are no rules; a leading or inner
slash ties a pattern to its folder; a trailing one means folders only; without rules
nothing is ignored; null paths are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.paths import basename, dirname
from coppice.sources.resolution import above

#: Names of ignore files; of two in one folder the rules of the later name come last.
NAMES = (".gitignore", ".ignore")


def glob_to_regex(glob: Column) -> Column:
    """A glob of a column as a regular expression: `*` and `?` stay within a folder, `**` doesn't, `[!a]` is a class."""
    steps = [
        (r"([.+^$(){}|])", r"\\$1"), (r"\[!", "[^"), (r"^\*\*/", "\u0001"), (r"/\*\*/", "/\u0001"), (r"/\*\*$", "/\u0002"), (r"\*\*", "\u0002"), (r"\*", "[^/]*"), (r"(?<!\\)\?", "[^/]"),
        ("\u0001", "(?:.*/)?"), ("\u0002", ".*"),
    ]
    out = glob
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return out


def rules(texts: DataFrame, names: tuple[str, ...] = NAMES, anchored: bool = False) -> DataFrame:
    """dir, rules: the ordered array of (regex, negated, folders) of every folder that has an ignore file.

    anchored: a pattern without a slash also stands for a path in the file's folder alone.
    """
    order = F.array_position(F.array(*map(F.lit, names)), basename(F.col("path")))
    lines = texts.where(basename(F.col("path")).isin(*names) & F.col("content").isNotNull()).select(dirname(F.col("path")).alias("dir"), order.alias("file"), F.posexplode(F.split("content", r"\r?\n")).alias("line", "text"))
    text = F.trim("text")
    lines = lines.select("dir", "file", "line", text.alias("text")).where((F.col("text") != "") & ~F.col("text").rlike("^[#@]"))
    negated = F.startswith("text", F.lit("!"))
    body = F.regexp_replace(F.regexp_replace("text", "^!", ""), r"^\\", "")
    folders = F.endswith(body, F.lit("/"))
    bare = F.regexp_replace(body, "/+$", "")
    tied = F.contains(bare, F.lit("/")) | F.lit(anchored)
    regex = F.concat(F.when(tied, "^").otherwise("^(?:.*/)?"), glob_to_regex(F.regexp_replace(bare, r"^(\./|/)", "")), F.lit("$"))
    rows = lines.select("dir", F.struct("file", "line", regex.alias("regex"), negated.alias("negated"), folders.alias("folders")).alias("rule"), bare.alias("bare")).where("bare <> ''")
    return rows.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list("rule")), lambda r: F.struct(r["regex"].alias("regex"), r["negated"].alias("negated"), r["folders"].alias("folders"))).alias("rules"))


def ignored(paths: DataFrame, by: DataFrame) -> DataFrame:
    """path and cause (the ignored folder above it, or itself) of every path that the rules ignore."""
    files = paths.select("path").where("path IS NOT NULL").distinct()
    # Subjects: every path as a file, every folder above one once.
    folders = F.transform(F.filter(above(F.col("path")), lambda d: d != ""), lambda d: F.struct(d.alias("subject"), F.lit(True).alias("folder")))
    itself = F.struct(F.col("path").alias("subject"), F.lit(False).alias("folder"))
    spread = files.select("path", F.explode(F.array_append(folders, itself)).alias("s"))
    spread = spread.select("path", "s.subject", "s.folder")
    asked = spread.select("subject", "folder").distinct().select("subject", "folder", F.explode(above(F.col("subject"))).alias("dir"))
    met = asked.join(by, "dir")
    below = F.when(F.col("dir") == "", F.col("subject")).otherwise(F.substring(F.col("subject"), F.length("dir") + 2, F.length("subject")))
    met = met.withColumn("below", below)
    matching = F.filter("rules", lambda r: (F.col("folder") | ~r["folders"]) & F.rlike(F.col("below"), r["regex"]))
    decided = met.select("subject", "folder", "dir", F.try_element_at(matching, F.lit(-1)).alias("last"))
    decided = decided.where("last IS NOT NULL").groupBy("subject", "folder").agg(F.max_by("last.negated", F.length("dir")).alias("negated"))
    gone = decided.where("NOT negated").select("subject", "folder")
    return spread.join(gone, ["subject", "folder"]).groupBy("path").agg(F.min_by("subject", F.length("subject")).alias("cause"))


def kept(files: DataFrame, by: DataFrame) -> DataFrame:
    """Rows whose path the rules don't ignore."""
    return files.join(ignored(files, by).select("path"), "path", "left_anti").select(*files.columns)


def directives(texts: DataFrame, directive: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """dir and glob of lines like `@name:directive glob` in ignore files."""
    lines = texts.where(basename(F.col("path")).isin(*names)).select(dirname(F.col("path")).alias("dir"), F.explode(F.split("content", r"\r?\n")).alias("text"))
    glob = F.regexp_extract("text", rf"^\s*@[\w-]+:{directive}\s+(\S.*?)\s*$", 1)
    return lines.select("dir", glob.alias("glob")).where("glob <> ''")
