"""Text search: literals, regular expressions, fuzzy names, silencers, style maps and lints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.names import edit_similarity


def lines(texts: DataFrame) -> DataFrame:
    """path, line (from 1) and its text; a null content has no line."""
    rows = texts.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return rows.select("path", (F.col("i") + 1).cast("long").alias("line"), "text")


def literal_pattern(needle: str, whole_token: bool = False) -> str:
    """Identifier-like needles match at identifier boundaries, others anywhere."""
    quoted = re.escape(needle)
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", needle):
        edge = "[A-Za-z0-9_-]" if whole_token else "[A-Za-z0-9_]"
        return f"(?<!{edge}){quoted}(?!{edge})"
    return quoted


def literal_hits(texts: DataFrame, needles: list[str], whole_token: bool = False) -> DataFrame:
    """path, line, term, hits and first column (from 1) of every line with a needle."""
    rows = lines(texts.where(_any(F.col("content"), needles)))
    found = rows.select("*", F.explode(F.array(*[
        F.struct(F.lit(n).alias("term"), F.regexp_count("text", F.lit(p)).alias("hits"), F.regexp_instr("text", F.lit(p)).alias("column"))
        for n in needles for p in [literal_pattern(n, whole_token)]
    ])).alias("hit"))
    return found.where("hit.hits > 0").select("path", "line", "hit.term", F.col("hit.hits").cast("long").alias("hits"), F.col("hit.column").cast("long").alias("column"))


def _any(content: Column, needles: list[str]) -> Column:
    out = F.contains(content, F.lit(needles[0]))
    for n in needles[1:]:
        out = out | F.contains(content, F.lit(n))
    return out


def regex_hits(texts: DataFrame, pattern: str) -> DataFrame:
    """path, line and number of non-overlapping matches; look-around and back-references are refused."""
    if re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    rows = lines(texts).withColumn("hits", F.regexp_count("text", F.lit(pattern)).cast("long"))
    return rows.where("hits > 0").select("path", "line", "hits")


def rollup(hits: DataFrame) -> DataFrame:
    """Per file and term: lines and hits, and the first line."""
    return hits.groupBy("path", "term").agg(F.count("*").alias("lines"), F.sum("hits").alias("hits"), F.min("line").alias("first_line"))


def universe(files: DataFrame, texts: DataFrame) -> DataFrame:
    """How many of the indexed files a text search covers, and how many have no text; searches read texts of any size."""
    state = F.when(F.col("content").isNull(), "no_text").otherwise("scanned")
    return files.select("path").join(texts.select("path", "content"), "path", "left").groupBy(state.alias("state")).agg(F.count("*").alias("files"))


def symbol_search(pattern: str, **tables: tuple[DataFrame, str]) -> DataFrame:
    """Rows of several tables whose name column matches, ignoring case: kind and name with the number of places."""
    rows = None
    for kind, (df, column) in tables.items():
        part = df.where(F.col(column).rlike(f"(?i){pattern}")).select(F.lit(kind).alias("kind"), F.col(column).alias("name"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("kind", "name").agg(F.count("*").alias("places"))


def fuzzy(names: DataFrame, query: str, above: float = 0.4, limit: int = 20) -> DataFrame:
    """The names closest to a query by edit similarity."""
    score = edit_similarity(F.lower("name"), F.lit(query.lower()))
    rows = names.select("name").distinct().withColumn("score", F.round(score, 6)).where(F.col("score") > above)
    return rows.orderBy(F.desc("score"), "name").limit(limit)


# What silences a checker.
SILENCERS = {
    "nosemgrep": r"(//|#)\s*nosemgrep(\s*:\s*[\w./:-]+)?\s*$",
    "dead-code": r"#!?\[(allow|expect|deny|warn)\([^)]*\bdead_code\b[^)]*\)\]",
    "allow": r"#!?\[(allow|expect|deny|warn)\(([^)]*,)?\s*(?!dead_code\b)[\w:]+\s*(,[^)]*)?\)\]",
    "ignore": r"^\s*#\[ignore", "unsafe": r"\bunsafe\s*\{(?!.*env::(set_var|remove_var)\s*\()", "unsafe-env-var": r"\bunsafe\s*\{.*env::(set_var|remove_var)\s*\(",
    "ts-ignore": r"@ts-ignore\b", "ts-expect-error": r"@ts-expect-error\b", "ts-nocheck": r"@ts-nocheck\b",
    "eslint-disable": r"eslint-disable(-next-line|-line)?(\s+[\w,/@\s-]+?)?(\s*\*/|$|\s*//)", "noqa": r"#\s*noqa(\s*:\s*[\w,\s]+)?",
    "type-ignore": r"#\s*type\s*:\s*ignore(\[[\w,\s-]+\])?", "pylint-disable": r"#\s*pylint\s*:\s*disable\s*=\s*[\w,\s-]+", "mypy-ignore": r"#\s*mypy\s*:\s*[\w=,\s-]+",
    "shellcheck": r"#\s*shellcheck\s+disable\s*=\s*[\w,\s]+",
}
#: What every line with a silencer holds, whichever of them it is.
SILENCER_HINT = r"nosemgrep|#!?\[|unsafe|@ts-|eslint-disable|noqa|ignore|pylint|mypy|shellcheck"
#: A style declaration that says something about layout: z-index, position and display, with its value.
STYLE = r"(?i)(z-index|position|display)\s*:\s*([^;}\"'<]+)"
# Lints of scripts, by line.
LINTS = {
    "ts/explicit-any": r":\s*any\b|\bas\s+any\b|<any>", "ts/ts-ignore": r"@ts-ignore\b", "ts/ts-expect-error": r"@ts-expect-error\b", "ts/ts-nocheck": r"@ts-nocheck\b",
    "mem/global-interval": r"(?<!=\s)\bsetInterval\s*\(", "mem/global-event-listener": r"\b(window|document|globalThis)\.addEventListener\s*\(",
    "mem/module-cache-unbounded": r"^\s*(export\s+)?(const|let|var)\s+\w*([cC]ache|[rR]egistry|[sS]tore)\w*\s*(:[^=]*)?=\s*new\s+(Map|Set)\b",
    "mem/subscription-leak": r"\.subscribe\s*\(",
}
# What an effect starts, and what its cleanup has to hold.
EFFECTS = {
    "react/settimeout-no-cleanup": (r"\bsetTimeout\s*\(", r"\bclearTimeout\s*\("), "react/setinterval-no-cleanup": (r"\bsetInterval\s*\(", r"\bclearInterval\s*\("),
    "react/eventlistener-no-cleanup": (r"\.addEventListener\s*\(", r"\.removeEventListener\s*\("), "react/async-effect-no-cleanup": (r"\bawait\b|\.then\s*\(", r"\breturn\b"),
}
EFFECT_BODY = r"(?s)(?:React\.)?useEffect\s*\((.*?)(?:,\s*\[[^\]]*\]\s*\)|\n\}\s*\))"


def inventory(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Per kind of pattern: matching lines and distinct files."""
    rows = lines(texts)
    kinds = F.filter(F.array(*[F.when(F.col("text").rlike(p), k) for k, p in patterns.items()]), lambda x: x.isNotNull())
    found = rows.select("path", F.explode(kinds).alias("kind"))
    return found.groupBy("kind").agg(F.count("*").alias("lines"), F.count_distinct("path").alias("files"))


#: Silencers that are code; all others work in comments alone.
IN_CODE = ("dead-code", "allow", "ignore", "unsafe", "unsafe-env-var")


def silencer_places(lexed: DataFrame) -> DataFrame:
    """path, line and kind of every silencer that stands where it works: attributes and blocks in code, the others in comments.

    Lines of files without a lexer are taken as they are.
    """
    where = lambda k: F.coalesce("code" if k in IN_CODE else "comments", "text")
    kinds = F.filter(F.array(*[F.when(where(k).rlike(p), k) for k, p in SILENCERS.items()]), lambda x: x.isNotNull())
    return lexed.where(F.col("text").rlike(SILENCER_HINT)).select("path", "line", F.explode(kinds).alias("kind"))


def silencer_inventory(lexed: DataFrame) -> DataFrame:
    """Per kind the lines and files of silencer_places()."""
    return silencer_places(lexed).groupBy("kind").agg(F.count("*").alias("lines"), F.count_distinct("path").alias("files"))


def styles(texts: DataFrame) -> DataFrame:
    """path, line, selector, property and value of every layout declaration; the selector is what stands before the last open brace."""
    rows = lines(texts)
    found = rows.select("path", "line", F.regexp_extract("text", r"([^{};]+)\{[^{}]*$|^\s*([^{};]+?)\s*\{", 1).alias("selector"), F.explode(F.regexp_extract_all("text", F.lit(STYLE), F.lit(0))).alias("declared"))
    prop, value = F.lower(F.trim(F.regexp_extract("declared", STYLE, 1))), F.trim(F.regexp_extract("declared", STYLE, 2))
    return found.select("path", "line", F.trim("selector").alias("selector"), prop.alias("property"), value.alias("value"))


def effect_lints(texts: DataFrame) -> DataFrame:
    """path, rule and number of effects that start something and don't end it in their cleanup."""
    bodies = texts.select("path", F.explode(F.regexp_extract_all("content", F.lit(EFFECT_BODY), F.lit(1))).alias("body"))
    missing = F.filter(F.array(*[F.when(F.col("body").rlike(start) & ~F.col("body").rlike(end), rule) for rule, (start, end) in EFFECTS.items()]), lambda x: x.isNotNull())
    return bodies.select("path", F.explode(missing).alias("rule")).groupBy("path", "rule").agg(F.count("*").alias("effects"))


def links(pages: DataFrame) -> DataFrame:
    """Targets of a page's links with the number of pages that have them."""
    rows = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))).alias("target"))
    return rows.groupBy("target").agg(F.count("*").alias("pages"))
