"""Every place of a literal, with what it is there, ranked; combined searches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.paths import artifact_class, extension, is_test_path
from coppice.operators.search import lines, literal_pattern


def expanded(needles: list[str]) -> list[str]:
    """`a|b` is two literals if each part is a plain one; a backslash before the bar keeps it."""
    out = []
    for needle in needles:
        parts = [p.replace("\\|", "|") for p in re.split(r"(?<!\\)\|", needle)]
        plain = len(parts) > 1 and all(p and not re.search(r"[\[\](){}.*+?^$\\]", p) for p in parts)
        out += parts if plain else [needle.replace("\\|", "|")]
    return list(dict.fromkeys(out))


def normalised_query(query: str) -> str:
    """A query with a bar stays; otherwise its words of two or more bytes are joined by bars."""
    return query if "|" in query else "|".join(w for w in query.split() if len(w.encode()) >= 2)


def occurrences(texts: DataFrame, needles: list[str], whole_token: bool = False) -> DataFrame:
    """path, line, column (from 1), term, before and after: a row per place; long lines are whole."""
    rows = None
    for needle in expanded(needles):
        pattern = literal_pattern(needle, whole_token)
        hit = lines(texts.where(F.contains("content", F.lit(needle)))).where(F.contains("text", F.lit(needle)))
        # Splitting at the matches gives what stands between them; their lengths give the columns.
        parts = hit.select("path", "line", "text", F.split("text", pattern, -1).alias("parts"))
        size = len(needle)
        before = lambda k: F.aggregate(F.slice("parts", 1, k), F.lit(0), lambda acc, x: acc + F.length(x)) + (k - 1) * size  # noqa: E731, B023
        each = parts.where(F.size("parts") > 1).select("path", "line", "text", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), before)).alias("at"))
        found = each.select("path", "line", (F.col("at") + 1).cast("long").alias("column"), F.lit(needle).alias("term"), F.substring("text", F.lit(1), F.col("at")).alias("before"), F.substring("text", F.col("at") + 1 + len(needle), F.length("text")).alias("after"))
        rows = found if rows is None else rows.unionByName(found)
    return rows


STYLES, SCRIPTS = ("css", "scss", "sass", "less"), ("html", "htm", "jsx", "tsx", "vue", "svelte", "astro")


def _odd(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit(""))) - 2 * (F.length(text) - F.length(F.replace(text, F.lit("\\" + mark), F.lit("")))) / 2


def kind_of(path: Column, before: Column, after: Column, term: Column, commented: Column | None = None, quoted: Column | None = None) -> Column:
    """What a place is by its line; the first that holds. commented, quoted: what the lexer knows, null where it knows nothing."""
    ext, pre, suf = extension(path), F.rtrim(before), F.ltrim(after)
    inside = lambda mark: F.pmod(_odd(before, mark).cast("int"), F.lit(2)) == 1
    hash_comment = ext.isin("py", "sh", "bash", "rb", "yml", "yaml", "toml", "mk") & before.rlike(r"(^|\s)#")
    comment = before.rlike(r"(^|[^:])//") | hash_comment | before.rlike(r"/\*(?!.*\*/)") | before.rlike(r"^\s*\*\s") | before.rlike(r"<!--(?!.*-->)")
    comment = comment if commented is None else F.coalesce(commented, comment)
    strung = inside('"') | inside("'") | inside("`")
    strung = strung if quoted is None else F.coalesce(quoted, strung)
    markup = ext.isin(*SCRIPTS)
    identifier = term.rlike(r"^[A-Za-z_$][A-Za-z0-9_$-]*$")
    return (
        F.when(comment, "comment").when(pre.rlike(r"(^|\s)(use|import|from)(\s|$)") & pre.rlike(r"^\s*(pub\s+)?(use|import|from)\b"), "import_like")
        .when(markup & pre.rlike(r"(^|\s)data-$"), "data_attribute").when(pre.rlike(r"--$") & (ext.isin(*STYLES) | markup | pre.rlike(r"var\(--$")), "custom_property")
        .when(ext.isin(*STYLES) & pre.rlike(r"\.$"), "class_token").when(ext.isin(*STYLES) & suf.rlike(r"^:[^:]") & pre.rlike(r"(^|[{;])$"), "css_property")
        .when(before.rlike(r"""class(Name)?\s*=\s*["'{`][^"'`}]*$"""), "class_token").when(strung, "string_literal")
        .when(pre.rlike(r"(^|\s)(let|let\s+mut|const|var|fn|def|class|function|struct|enum|type|interface)$"), "definition_like")
        .when(suf.rlike(r"^(<<=|>>=|[-+*/%&|^]=|=(?![=>]))"), "mutation_like").when(pre.rlike(r"\{[^(){}\[\]]*$") & suf.rlike(r"^(,|\}|$)"), "field_emit_like")
        .when(identifier, "identifier").otherwise("unknown")
    )


# The role that a kind has, and where a role and a scope stand in the ranking.
ROLE_OF = {
    "definition_like": "local_binding", "import_like": "import", "mutation_like": "mutation", "field_emit_like": "field_emission", "css_property": "style_property",
    "class_token": "class_token", "custom_property": "style_variable", "comment": "comment", "string_literal": "string_literal", "data_attribute": "data_attribute",
    "identifier": "reference", "unknown": "unknown",
}
ROLE_RANK = {
    "definition": 0, "local_binding": 1, "mutation": 2, "field_emission": 2, "import": 3, "reference": 4, "style_property": 5, "class_token": 5, "style_variable": 5,
    "comment": 6, "string_literal": 6, "data_attribute": 6, "unknown": 7,
}
SCOPE_RANK = {"production": 0, "config": 1, "unknown": 2, "test": 3, "generated": 4, "docs": 5}


def _mapped(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def scope_of(path: Column) -> Column:
    """production, test, docs, config, generated or unknown."""
    ext = extension(path)
    return (
        F.when(is_test_path(path), "test").when(artifact_class(path).isin("generated", "vendored"), "generated").when(ext.isin("md", "markdown", "mdx", "rst", "txt"), "docs")
        .when(ext.isin("json", "toml", "yaml", "yml", "ini", "cfg", "env"), "config").when(ext == "", "unknown").otherwise("production")
    )


def classified(found: DataFrame, lexed: DataFrame | None = None) -> DataFrame:
    """Places with kind, role, confidence and scope; lexed lines tell comments and strings that go over lines."""
    known = (None, None)
    if lexed is not None:
        found = found.join(lexed.select("path", "line", "code", "comments"), ["path", "line"], "left")
        blank = lambda c: F.substring(F.col(c), F.col("column").cast("int"), F.lit(1)) != F.substring("term", 1, 1)
        known = (~blank("comments"), blank("comments") & blank("code"))
    rows = found.withColumn("kind", kind_of(F.col("path"), F.col("before"), F.col("after"), F.col("term"), *known)).withColumn("role", _mapped(ROLE_OF, F.col("kind")))
    confidence = F.when(F.col("kind") == "unknown", "low").when(F.col("kind") == "identifier", "medium").otherwise("high")
    return rows.select("path", "line", "column", "term", "kind", "role", confidence.alias("confidence"), scope_of(F.col("path")).alias("scope"))


def enriched(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Places that the index knows as the definition of their term, (path, name, line), become definitions."""
    known = definitions.where("line IS NOT NULL").select("path", F.col("name").alias("term"), "line").distinct().withColumn("known", F.lit(True))
    joined = rows.join(known, ["path", "term", "line"], "left")
    is_known = F.coalesce("known", F.lit(False))
    return joined.withColumns({"role": F.when(is_known, "definition").otherwise(F.col("role")), "confidence": F.when(is_known, "high").otherwise(F.col("confidence"))}).select(*rows.columns)


def ranked(rows: DataFrame) -> DataFrame:
    """Places with their ranks: scope, then role; path, line and column make the order total."""
    return rows.withColumns({"scope_rank": _mapped(SCOPE_RANK, F.col("scope")), "role_rank": _mapped(ROLE_RANK, F.col("role"))})


def first_page(rows: DataFrame, limit: int) -> DataFrame:
    return ranked(rows).orderBy("scope_rank", "role_rank", "path", "line", "column").limit(limit)


def near_names(term: str, names: DataFrame, above: float = 0.7, limit: int = 10) -> DataFrame:
    """The closest names, for a term without a place."""
    from coppice.operators.search import fuzzy

    return fuzzy(names, term, above, limit)


def combined_search(query: str, exports: DataFrame, params: DataFrame, dead: DataFrame, silencers: DataFrame, hits: DataFrame) -> DataFrame:
    """One table of what a query finds: symbols and parameters by pattern, with whether they are dead, silencers and files that several terms meet in.

    exports, params: (path, name); dead: (path, name); silencers: (path, line, kind); hits: (path, term).
    """
    pattern = f"(?i){normalised_query(query)}"
    row = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), "path", detail.cast("string").alias("detail"))
    named = exports.where(F.col("name").rlike(pattern)).select("path", "name").distinct()
    state = named.join(dead.select("path", "name").distinct().withColumn("dead", F.lit(True)), ["path", "name"], "left")
    symbols = row(state, "symbol", F.concat_ws(" ", "name", F.when(F.col("dead"), "(dead)")))
    cross = hits.groupBy("path").agg(F.count_distinct("term").alias("terms")).where("terms > 1")
    parts = [row(params.where(F.col("name").rlike(pattern)).distinct(), "param", F.col("name")), row(silencers, "silencer", F.concat_ws(":", "kind", "line")), row(cross, "cross_match", F.col("terms"))]
    for part in parts:
        symbols = symbols.union(part)
    return symbols


def tagmap(word: str, paths: DataFrame, imports: DataFrame, exports: DataFrame, literals: DataFrame, dead: DataFrame) -> DataFrame:
    """Where a word stands: in paths, exported and imported names, literals and dead code, as numbers of rows and files."""
    has = lambda c: F.contains(F.lower(c), F.lit(word.lower()))
    row = lambda df, kind, c: df.where(has(c)).select(F.lit(kind).alias("where"), "path")
    rows = row(paths, "path", "path").union(row(exports, "export", "name")).union(row(imports, "import", "name")).union(row(literals, "literal", "name")).union(row(dead, "dead", "name"))
    return rows.groupBy("where").agg(F.count("*").alias("rows"), F.count_distinct("path").alias("files"))
