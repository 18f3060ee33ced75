"""What a language's own conventions say of symbols: tags, entry points and dispatch.

Rules are patterns over whole texts, by language; each finds names and gives them a tag.
Defined results: null texts say nothing; a name may have several tags, each once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.paths import basename, extension

SHELL, MAKE = ("sh", "bash", "zsh"), ("mk", "make", "makefile")
# Fixed values: (extensions, tag, pattern); the first group is the name, which the runtime or a tool calls.
TAGS = [
    (("py",), "test", r"(?m)^\s*(?:async\s+)?def\s+(test_\w+)"),
    (("py",), "handler", r"(?m)^\s*@[\w.]+\.(?:route|get|post|put|delete|patch|command|task|event|on_event|handler|callback)\b[^\n]*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(\w+)"),
    (("py",), "test", r"(?m)^\s*@(?:pytest\.)?fixture\b[^\n]*\n\s*(?:async\s+)?def\s+(\w+)"),
    (("py",), "entry", r"(?ms)^if\s+__name__\s*==\s*['\"]__main__['\"]\s*:\s*\n\s+(?:sys\.exit\()?(?:asyncio\.run\()?(\w+)\("),
    (("rs",), "handler", r"#\[(?:tauri::)?command[^\]]*\]\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
    (("rs",), "test", r"#\[(?:tokio::)?test[^\]]*\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"),
    (("rs",), "entry", r"(?m)^\s*(?:pub\s+)?(?:async\s+)?fn\s+(main)\s*\("),
    (("rs",), "constructor", r"(?m)^\s*pub\s+(?:const\s+)?fn\s+((?:new|from|into|with|try)(?:_\w+)?)\s*[(<]"),
    (SHELL, "handler", r"(?m)^\s*trap\s+['\"]?(\w+)['\"]?\s+[A-Z]"),
    (SHELL, "entry", r"(?m)^(main)\s+\"?\$@"),
    (MAKE, "entry", r"(?m)^(all|test|build|install|clean|check|help)\s*:(?!=)"),
    (("ts", "tsx", "js", "jsx"), "handler", r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?function\s+(on[A-Z]\w*|handle[A-Z]\w*)"),
    (("ts", "js"), "entry", r"(?m)^\s*export\s+(?:async\s+)?function\s+(activate|deactivate)\s*\("),
]
# Fixed values: (extensions, kind, pattern); the groups are who dispatches and to whom, names parted by spaces.
DISPATCH = [
    (MAKE, "depends", r"(?m)^([\w.-]+)\s*:(?!=)[ \t]*([\w.\-/ \t]+)$"),
    (SHELL, "case", r"(?m)^\s*([\w|-]+)\)\s*(\w+)(?:\s+\"?\$|\s*;;|\s*$)"),
]


def _language(df: DataFrame) -> DataFrame:
    ext = extension(F.col("path"))
    return df.select("path", "content", F.when(ext == "", F.lower(basename(F.col("path")))).otherwise(ext).alias("ext"))


def semantic_tags(texts: DataFrame) -> DataFrame:
    """path, name, tag."""
    found = F.concat(*(_tagged(*rule) for rule in TAGS))
    return _language(texts).select("path", F.explode(found).alias("x")).select("path", "x.name", "x.tag").distinct()


def _tagged(exts: tuple[str, ...], tag: str, pattern: str):
    """Names that a rule finds, with its tag; none in other languages."""
    names = F.when(F.col("ext").isin(*exts), F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.struct(x.alias("name"), F.lit(tag).alias("tag")))


def entry_points(texts: DataFrame) -> DataFrame:
    """path of files that run by themselves: a shebang, a main guard or function, or a Swift entry."""
    main = (
        F.startswith("content", F.lit("#!")) | (F.col("ext") == "py") & F.col("content").rlike(r"(?m)^if\s+__name__\s*==")
        | (F.col("ext") == "rs") & F.col("content").rlike(r"(?m)^\s*(?:pub\s+)?(?:async\s+)?fn\s+main\s*\(") | (F.col("ext") == "swift") & F.col("content").rlike(r"(?m)^\s*@main\b")
        | (F.col("ext") == "go") & F.col("content").rlike(r"(?m)^func\s+main\s*\(")
    )
    return _language(texts).where(main).select("path")


def dispatch_edges(texts: DataFrame) -> DataFrame:
    """path, kind, src and dst: prerequisites of make targets, and shell cases with the function that they call."""
    rows, out = _language(texts), None
    for exts, kind, pattern in DISPATCH:
        found = rows.where(F.col("ext").isin(*exts)).select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("m"))
        heads, tails = F.split(F.regexp_extract("m", pattern, 1), r"\|"), F.split(F.trim(F.regexp_extract("m", pattern, 2)), r"\s+")
        part = found.select("path", F.lit(kind).alias("kind"), F.explode(heads).alias("src"), tails.alias("to")).select("path", "kind", "src", F.explode("to").alias("dst")).where("dst <> '' AND src <> '.PHONY'")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
