"""Lines of source files with what the lexer knows of them: comments, strings, bracket depth and where a body ends.

One pass per file finds the comments and strings of a language family, also those that
go over lines (block comments, nested ones in Rust, templates with their `${}` parts,
triple quotes, raw strings); brackets count outside of them. A row per line carries its
code and its comments, each with everything else blanked, so a pattern over a line can't
match in the wrong place; columns stay as they are.

Defined results: a file of no known family has nulls beside its text; what is open at the
end of a file ends there; a quote that a line leaves open ends with it where the language
says so; a null content gives no rows. Quotes in regular expressions of scripts are taken
for strings until the end of their line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.paths import extension
from coppice.plans.storage import dealt

# Endings of each family.
FAMILIES = {
    "script": ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "vue", "svelte", "astro"), "c": ("c", "h", "cc", "cpp", "hpp", "java", "kt", "swift", "dart", "zig", "cs", "scss", "less"),
    "go": ("go",), "rust": ("rs",), "python": ("py", "pyi"), "shell": ("sh", "bash", "zsh", "rb"), "data": ("toml", "yml", "yaml", "mk"), "style": ("css",),
}
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)', r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_HASH = r"(?:^|(?<=\s))\#[^\n]*"
#: Per family patterns of comments and strings; what else ends or begins something is found below.
TOKENS = {
    "script": (f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}"), "c": (f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}"), "go": (f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}|`[^`]*(?:`|\\Z)"), "style": (_BLOCK, f"{_DOUBLE}|{_SINGLE}"),
    "rust": (_LINE, r"""\bb?r(?P<fence>\#*)".*?(?:"(?P=fence)|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\[^\n]+?|[^'\\\n])'"""),
    "python": (r"\#[^\n]*", rf"""(?P<triple>\"\"\"|''')(?:\\.|(?!(?P=triple)).)*(?:(?P=triple)|\Z)|{_DOUBLE}|{_SINGLE}"""),
    "shell": (_HASH, r"""\"(?:\\.|[^"\\])*(?:"|\Z)|'[^']*(?:'|\Z)"""), "data": (_HASH, f"{_DOUBLE}|{_SINGLE}"),
}
MASTER = {k: re.compile(rf"(?P<comment>{c})|(?P<string>{s})|(?P<nested>/\*)|(?P<tick>`)|(?P<open>[(\[{{])|(?P<close>[)\]}}])", re.S | re.M) for k, (c, s) in TOKENS.items()}
BLANKED = re.compile(r"[^\n]")
NESTED, TEMPLATE = re.compile(r"/\*|\*/"), re.compile(r"\\.|`|\$\{", re.S)
#: Lines, or characters of texts, that go from a worker at once.
LINES, CHARACTERS = 8_192, 1 << 22
#: How the code of a line looks that ends a statement or a block.
ENDING = re.compile(r"[};][)\],;]*\s*$")


def scan(text: str, family: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of comments and strings, and (place, 1 or -1) of brackets in code."""
    spans, brackets, at, depth = [], [], 0, 0
    templates: list[int] = []

    def template(start: int) -> int:
        """The end of a template's text from a place in it: behind its tick, or behind a `${`."""
        for m in TEMPLATE.finditer(text, start):
            if m[0] == "`":
                return m.end()
            if m[0] == "${":
                templates.append(depth)
                return m.end()
        return len(text)

    while m := MASTER[family].search(text, at):
        kind = m.lastgroup
        start, at = m.span()
        if kind == "comment" or kind == "string":
            if kind == "string" and family == "rust" and m["fence"] is None and text[start] == "'" and at - start < 3:
                continue
            spans.append((kind, start, at))
        elif kind == "nested":
            if family == "rust":
                level = 1
                for n in NESTED.finditer(text, at):
                    level += 1 if n[0] == "/*" else -1
                    if not level:
                        break
                at = n.end() if not level else len(text)
                spans.append(("comment", start, at))
        elif kind == "tick":
            if family == "script":
                at = template(at)
                spans.append(("string", start, at))
        elif kind == "open":
            depth += 1
            brackets.append((start, 1))
        elif templates and text[start] == "}" and depth == templates[-1]:
            templates.pop()
            at = template(at)
            spans.append(("string", start, at))
        else:
            depth = max(0, depth - 1)
            brackets.append((start, -1))
    return spans, brackets


def body_ends(code: list[str], depths: list[int], ends: list[int], family: str, within: list[bool]) -> list[int]:
    """Per line the last line of a definition that begins there."""
    n, out = len(code), [0] * len(code)
    if family == "python":
        # It ends before the next line of code that isn't deeper; blank lines before that one are not its own.
        stack: list[tuple[int, int]] = []
        filled = None
        for k in range(n - 1, -1, -1):
            # Lines that begin within a string or an open bracket have no indentation of their own.
            own = bool(code[k].strip()) and not within[k] and not depths[k]
            if own:
                indent = len(code[k]) - len(code[k].lstrip())
                while stack and stack[-1][0] > indent:
                    stack.pop()
                out[k] = stack[-1][1] if stack else (filled or k)
                stack.append((indent, k - 1))
            if filled is None and code[k].strip():
                filled = k
                if own:
                    out[k] = k
        last = [0] * (n + 1)
        for k in range(n):
            last[k] = k if code[k].strip() or within[k] else (last[k - 1] if k else 0)
        return [max(k, last[e]) for k, e in enumerate(out)]
    best: dict[int, int] = {}
    for k in range(n - 1, -1, -1):
        if ENDING.search(code[k]):
            for d in [d for d in best if d >= ends[k]]:
                del best[d]
            best[ends[k]] = k
        below = [best[d] for d in best if d <= depths[k]]
        out[k] = min(below) if below else n - 1
    return out


def _blank(text: str) -> str:
    return BLANKED.sub(" ", text) if "\n" in text else " " * len(text)


def lex(text: str, family: str) -> list[tuple]:
    """(line, text, state, depth, body_end, code, comments) of every line."""
    spans, brackets = scan(text, family)
    # What a span covers is blanked on one side, what lies between spans on the other.
    code, comments, at = [], [], 0
    for kind, a, b in spans:
        between, blank = text[at:a], _blank(text[a:b])
        code += between, blank
        comments += _blank(between), text[a:b] if kind == "comment" else blank
        at = b
    code.append(text[at:])
    comments.append(_blank(text[at:]))
    lines, starts = text.split("\n"), [0]
    for line in lines[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    state, depths, deltas = ["code"] * len(lines), [0] * len(lines), [0] * len(lines)
    for kind, a, b in spans:
        for k in range(bisect_right(starts, a), bisect_right(starts, b - 1)):
            state[k] = kind
    for at, change in brackets:
        deltas[bisect_right(starts, at) - 1] += change
    ends, depth = [], 0
    for k, change in enumerate(deltas):
        depths[k] = depth
        depth = max(0, depth + change)
        ends.append(depth)
    coded, commented = "".join(code).split("\n"), "".join(comments).split("\n")
    until = body_ends(coded, depths, ends, family, [s != "code" for s in state])
    return [(k + 1, line, state[k], depths[k], until[k] + 1, coded[k], commented[k]) for k, line in enumerate(lines)]


def lexed(texts: DataFrame) -> DataFrame:
    """path, line, text, state (what the line begins in), depth, body_end, code and comments of every line."""
    family = F.create_map(*[F.lit(x) for k, v in FAMILIES.items() for e in v for x in (e, k)])
    rows = texts.where("content IS NOT NULL").select("path", F.try_element_at(family, extension(F.col("path"))).alias("family"), "content")

    kinds = {"path": pa.string(), "line": pa.int64(), "text": pa.string(), "state": pa.string(), "depth": pa.int64(), "body_end": pa.int64(), "code": pa.string(), "comments": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda found: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds.values(), strict=True)], names=list(kinds))
        for batch in batches:
            found, held = [], 0
            for path, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found += [(path, *r) for r in (lex(content, kind) if kind else [(k, x, None, None, None, None, None) for k, x in enumerate(content.split("\n"), 1)])]
                held += len(content)
                # Many short texts make one batch; a long one is a batch by itself.
                if len(found) >= LINES or held >= CHARACTERS:
                    yield made(found)
                    found, held = [], 0
            if found:
                yield made(found)

    # Texts are often made of a file that is one partition.
    return dealt(rows, "path").mapInArrow(run, "path string, line bigint, text string, state string, depth bigint, body_end bigint, code string, comments string")
