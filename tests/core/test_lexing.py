"""Comments, strings, depths and bodies of lines, and what places and silencers make of them."""

import random

import pytest
from pyspark.sql import functions as F

from coppice.operators import bodies, occurrences, search
from coppice.sources import lexing

CODE = {
    "a.ts": """/* track {
 * @ts-ignore track
 */ export function one(a: string) {
  const s = "}} // track"; // @ts-ignore
  const t = `line ${track({ a: `in ${x} }` })} {
    // track in a template
  `;
  return s;
}
export const two = (x) => {
  if (x) { return '}'; }
};
export const three = 5
export class Four
{
  m() { return [1, 2]; }
}
""",
    "b.rs": """/* outer /* inner */ unsafe { track */
#[allow(unused)]
pub fn life<'a>(x: &'a str) -> char {
    let r = r#"quote " } unsafe { track"#;
    let c = '}';
    let q = '\\'';
    unsafe { go() }
}
pub struct Unit;
pub fn later(
    a: i32,
) -> i32
where
    i32: Copy,
{
    a // nosemgrep
}
""",
    "c.py": '''def one():
    """Doc
def not_me(): track
    # noqa: no comment
    """
    x = "# noqa"  # noqa: E501

    y = (
1, 2)
    return x


class Two:
    def m(self):
        return 1

    n = 2
z = 'track'
''',
    "d.sh": "#!/bin/sh\necho \"a # no\n# still a string\" # shellcheck disable=SC1\nf() {\n  echo '}'\n}\n",
    "e.go": "var q = `raw {\n// track\n`\nfunc F() {\n\treturn\n}\n",
    "f.md": "# track {\n",
    "g.ts": "",
    "h.ts": "/* never closed\n{",
}
DEFINITIONS = [
    ("a.ts", "one", 3, 9), ("a.ts", "two", 10, 12), ("a.ts", "three", 13, 13), ("a.ts", "Four", 14, 17), ("b.rs", "life", 3, 8), ("b.rs", "Unit", 9, 9), ("b.rs", "later", 10, 17),
    ("c.py", "one", 1, 10), ("c.py", "Two", 13, 17), ("c.py", "m", 14, 15), ("c.py", "z", 18, 18), ("d.sh", "f", 4, 6), ("e.go", "F", 4, 6),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([*CODE.items(), ("n.ts", None)], "path string, content string")


def test_states_depths_and_blanked_text(texts):
    rows = {(r["path"], r["line"]): r for r in lexing.lexed(texts).collect()}
    assert len(rows) == sum(c.count("\n") + 1 for c in CODE.values())
    states = lambda p: [rows[p, k]["state"] for k in range(1, CODE[p].count("\n") + 2)]
    assert states("a.ts")[:9] == ["code", "comment", "comment", "code", "code", "string", "string", "code", "code"]
    assert states("b.rs")[:2] == ["code", "code"] and states("e.go")[:4] == ["code", "string", "string", "code"] and states("h.ts") == ["code", "comment"]
    assert [rows["a.ts", k]["depth"] for k in range(1, 14)] == [0, 0, 0, 1, 1, 1, 1, 1, 1, 0, 1, 1, 0]
    assert [rows["b.rs", k]["depth"] for k in range(1, 10)] == [0, 0, 0, 1, 1, 1, 1, 1, 0]
    assert rows["f.md", 1]["state"] is None and rows["g.ts", 1]["text"] == "" and all(len(r["code"] or r["text"]) == len(r["text"]) for r in rows.values())
    assert "track" not in rows["a.ts", 4]["code"] and "track" in rows["a.ts", 4]["text"] and rows["a.ts", 4]["comments"].strip() == "// @ts-ignore"


def test_bodies_end_at_their_bracket_or_indentation(spark, texts):
    named = spark.createDataFrame([d[:3] for d in DEFINITIONS] + [("n.ts", "none", 1)], "path string, name string, line long")
    got = {(r["path"], r["name"]): (r["line"], r["last_line"]) for r in bodies.bodies(named, lexing.lexed(texts)).collect()}
    assert got == {d[:2]: d[2:] for d in DEFINITIONS}
    found = {(r["path"], r["name"], r["line"]) for r in bodies.definitions(lexing.lexed(texts)).collect()}
    assert found >= {d[:3] for d in DEFINITIONS if d[1] != "z"} and not {"not_me"} & {n for _, n, _ in found}
    source = {r["name"]: r["source"] for r in bodies.sources(bodies.bodies(named, lexing.lexed(texts)), texts).collect()}
    assert source["two"] == "\n".join(CODE["a.ts"].split("\n")[9:12]) and source["m"] == "    def m(self):\n        return 1"


def test_places_within_comments_and_strings_over_lines(texts):
    found = occurrences.occurrences(texts, ["track"])
    got = {(r["path"], r["line"]): r["kind"] for r in occurrences.classified(found, lexing.lexed(texts)).collect()}
    want = {("a.ts", 1): "comment", ("a.ts", 2): "comment", ("a.ts", 4): "string_literal", ("a.ts", 5): "identifier", ("a.ts", 6): "string_literal", ("b.rs", 1): "comment", ("b.rs", 4): "string_literal",
            ("c.py", 3): "string_literal", ("c.py", 18): "string_literal", ("e.go", 2): "string_literal", ("f.md", 1): "identifier"}
    assert got == want


def test_silencers_where_they_work(texts):
    got = {tuple(r) for r in search.silencer_places(lexing.lexed(texts)).select("path", "line", "kind").collect()}
    assert got == {("a.ts", 2, "ts-ignore"), ("a.ts", 4, "ts-ignore"), ("b.rs", 2, "allow"), ("b.rs", 7, "unsafe"), ("b.rs", 16, "nosemgrep"), ("c.py", 6, "noqa"), ("d.sh", 3, "shellcheck")}


def test_random_nesting_against_a_stack():
    rng = random.Random(4)
    for _ in range(300):
        lines, depth, want, open_ = [], 0, [], []
        for k in range(rng.randint(1, 25)):
            if depth and rng.random() < 0.4:
                depth -= 1
                lines.append("}")
                want.append(None)
                want[open_.pop()] = k
            elif rng.random() < 0.6:
                open_.append(k)
                lines.append(rng.choice(["f() {", "g('}') {", "h() { // }", "/* { */ i() {", "j(`}${'{'}`) {"]))
                want.append(None)
                depth += 1
            else:
                lines.append(rng.choice(["x;", "y('{');", "z(); // {"]))
                want.append(k)
        got = [r[4] - 1 for r in lexing.lex("\n".join(lines), "script")]
        for k, w in enumerate(want):
            if w is not None:
                assert got[k] == w, (lines, k)


def test_texts_stay_dealt_out_and_go_in_batches(spark):
    few = spark.range(40).selectExpr("concat('f', id, '.ts') AS path", "'let a = 1\n// @ts-ignore' AS content").coalesce(1)
    lines = lexing.lexed(few)
    assert "REPARTITION_BY_NUM" in lines._jdf.queryExecution().executedPlan().toString()
    assert search.silencer_places(lines).count() == 40
    # Adaptive execution put parts of few bytes together before.
    assert lines.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_hint_lets_every_silencer_through(spark):
    lines = {
        "nosemgrep": "x // nosemgrep", "dead-code": "#[allow(dead_code)]", "allow": "#![allow(unused)]", "ignore": "  #[ignore]", "unsafe": "unsafe { go() }", "unsafe-env-var": "unsafe { std::env::set_var(a, b) }",
        "ts-ignore": "// @ts-ignore", "ts-expect-error": "// @ts-expect-error", "ts-nocheck": "// @ts-nocheck", "eslint-disable": "// eslint-disable-next-line", "noqa": "#noqa", "type-ignore": "# type:ignore",
        "pylint-disable": "# pylint: disable=a", "mypy-ignore": "# mypy: ignore-errors", "shellcheck": "# shellcheck disable=SC1",
    }
    got = {(r["path"], r["kind"]) for r in search.silencer_places(lexing.lexed(spark.createDataFrame([*lines.items()], "path string, content string"))).collect()}
    assert {(kind, kind) for kind in search.SILENCERS} <= got
