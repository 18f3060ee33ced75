"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of a module path, in the order in which they are tried, and the family that shares one key.
MODULE_SUFFIXES = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "rs", "py", "css", "svelte", "vue", "astro")
SCRIPT_FAMILY = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "svelte", "vue", "astro")
# Directories and file-name patterns that mark each artifact class; the classes are tried in this order.
ARTIFACT_PARTS = {
    "fixture": (("fixtures", "fixture", "testdata"), r"__fixtures__"),
    "vendored": (("vendor", "vendored", "node_modules", "third_party", "thirdparty"), r"(\.min\.(js|mjs|cjs|css)|\.bundle\.js)$"),
    "generated": (("dist", "public_dist", "__generated__"), r"(\.lock|\.map)$|-lock\.[^/]*$"),
    "template": ((), r"(^|/)(example|sample|template)\.[^/]*$|\.(example|sample|template)[^/]*$"),
}
# Endings of generated sources.
GENERATED = r"(\.generated\.[a-z]+|\.gen\.[a-z]+|\.pb\.go|_pb2\.py|\.g\.dart|\.freezed\.dart)$"
MINIFIED_LINE = 5000


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def module_key(path: Column) -> Column:
    """path:language with one language for the script family; the join key of module identity."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    suffix = F.regexp_extract(clean, rf"\.({'|'.join(MODULE_SUFFIXES)})$", 1)
    body = F.regexp_replace(F.regexp_replace(clean, rf"\.({'|'.join(MODULE_SUFFIXES)})$", ""), "/index$", "")
    return F.concat(body, F.lit(":"), F.when(suffix.isin(*SCRIPT_FAMILY), "ts").otherwise(suffix))


def artifact_class(path: Column, content: Column | None = None) -> Column:
    """fixture, vendored, generated, template or product; a line of over 5000 bytes among the first ten means vendored."""
    lowered = F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"^(\./)+", "")
    parts = F.slice(F.split(lowered, "/"), 1, F.greatest(F.size(F.split(lowered, "/")) - 1, F.lit(0)))
    out = None
    for name, (marks, pattern) in ARTIFACT_PARTS.items():
        hit = lowered.rlike(pattern)
        if marks:
            hit = hit | F.arrays_overlap(parts, F.array(*map(F.lit, marks)))
        if name == "generated":
            hit = hit | lowered.rlike(GENERATED)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    if content is not None:
        long_line = F.exists(F.slice(F.split(content, "\n"), 1, 10), lambda x: F.octet_length(x) > MINIFIED_LINE)
        out = out.when(F.coalesce(long_line, F.lit(False)), "vendored")
    return out.otherwise("product")


# Directories and file names of tests.
TEST_PLACES = r"(^|/)(tests?|spec)/|__tests__|/fixtures/|^fixtures/|/mocks/|__mocks__|test-utils|/testing/"
TEST_NAMES = r"_test\.|\.test\.|_spec\.|\.spec\.|_tests\.|^test_|^spec_|^tests\.|^conftest\.py$|setup\.tsx?$"


def is_test_path(path: Column) -> Column:
    """A directory or file name that marks tests."""
    lowered = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return lowered.rlike(TEST_PLACES) | basename(lowered).rlike(TEST_NAMES)


def is_dev_path(path: Column) -> Column:
    """Tests' directories, stories and fixtures."""
    return path.rlike(r"__tests__|stories|story\.|fixture") | is_test_path(path)


def is_non_production(path: Column) -> Column:
    """Paths that reports leave out: tests, and anything that isn't product."""
    return is_test_path(path) | (artifact_class(path) != "product")


# Why an export of a path is no candidate for dead code; the first that holds.
DEAD_SKIPS = {
    "example": r"/(examples?|samples?|demos?|playground|showcase)/|testfixtures",
    "story_or_test": r"stories|__tests__|__mocks__|__fixtures__|/(cypress|e2e|playwright|tests?|spec)/",
    "declarations": r"\.d\.ts$",
    "generated": r"\.(g|freezed|gr|pb|pbjson|pbenum|pbserver|config)\.dart$|generated_plugin_registrant\.dart$",
    "config": r"\.config\.",
    "helper": r"(^|/)(scripts?|tools|docs)/",
    "framework_entry": r"\+(page|layout|server|error)\.|/(page|layout|route)\.tsx?|/(error|loading|not-found)\.tsx|hooks\.(client|server)\.|/hooks\.",
    "runtime": r"(/\.svelte-kit/|/runtime/|/app/router/|/app/routes/).*\.(ts|tsx|js|jsx|mjs|cjs)$|jsx[-_](dev-)?runtime",
    "library_surface": r"/(packages|libs|library)/.*/(index\.(ts|tsx|js|mjs|cjs)|mod\.(ts|js))$",
    "entry": r"(^|/)(lib|main)\.rs$",
    "build_rules": r"(^|/)makefile$|\.(mk|make)$",
    "public_language": r"\.go$",
}


def dead_skip(path: Column, language: Column) -> Column:
    """Why exports of a path are never candidates for dead code; null if they are."""
    lowered = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.when(artifact_class(path) != "product", artifact_class(path)).when(is_test_path(path), "test").when(language == "go", "public_language")
    for name, pattern in DEAD_SKIPS.items():
        out = out.when(lowered.rlike(pattern), name)
    return out


def file_kind(path: Column) -> Column:
    """code, style, markup, data, docs or other, by extension."""
    e = extension(path)
    return (
        F.when(e.isin("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "swift", "dart", "sh", "zig", "c", "h", "cpp", "svelte", "vue", "astro"), "code")
        .when(e.isin("css", "scss", "sass", "less"), "style").when(e.isin("html", "htm"), "markup")
        .when(e.isin("json", "yaml", "yml", "toml"), "data").when(e.isin("md", "txt", "rst"), "docs").otherwise("other")
    )


def prefixes(path: Column) -> Column:
    """Every directory above a path, from the root ('.') down."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))),
    ).otherwise(F.array(F.lit(".")))


def suffixes(path: Column) -> Column:
    """Every tail of a path at a '/' boundary, itself included: a suffix match becomes an equality."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: `*` stays within a directory, `**` doesn't."""
    out = ""
    for part in pattern.replace("**/", "\0").replace("**", "\1").replace("*", "\2").replace("?", "\3"):
        out += {"\0": "(.*/)?", "\1": ".*", "\2": "[^/]*", "\3": "[^/]"}.get(part, part if part.isalnum() or part in "_/" else "\\" + part)
    return f"^{out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def is_template(path: Column) -> Column:
    """Whether a file only shows what a source of settings looks like."""
    return (artifact_class(path) == "template") | F.lower(basename(path)).rlike("example|template|sample")
