"""Dead code, defects, lookups, pages and places of literals on small tables with nulls and repeats."""

import random

import pytest
from pyspark.sql import functions as F

from coppice.functions import paths
from coppice.operators import bridges, explore, graph, occurrences, search, symbols, truth

rng = random.Random(4)
EXPORT = "path string, name string, kind string, language string, line long"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_dead_verdicts_and_truth(spark):
    exports = [
        ("src/a.ts", "used", "function", "ts", 1), ("src/a.ts", "idle", "function", "ts", 2), ("src/a.ts", "idle", "function", "ts", 9), ("src/b.ts", "starred", "const", "ts", 1),
        ("src/c.ts", "local", "const", "ts", None), ("src/d.rs", "cmd", "function", "rs", 3), ("src/e.ts", "lazy", "const", "ts", 1), ("src/f.py", "is_ok", "function", "py", 1),
        ("src/g.ts", "elsewhere", "const", "ts", 1), ("tests/h.ts", "t", "const", "ts", 1), ("src/i.go", "Api", "function", "go", 1), ("vendor/j.ts", "v", "const", "ts", 1),
        ("src/app.config.ts", "conf", "const", "ts", 1), ("src/k.ts", "again", "reexport", "ts", 1), ("run.sh", "step", "function", "sh", 1), ("ok/l.ts", "fine", "const", "ts", 1),
        ("src/voice_bridge.ts", "Bridge", "class", "ts", 1), ("src/m.ts", "named", "const", "ts", 1), ("src/n.ts", "start", "function", "ts", 1),
    ]
    imports = frame(spark, [("x.ts", "src/a.tsx", "used"), ("x.ts", "src/b.ts", "*"), ("x.ts", None, "elsewhere"), ("x.ts", "src/a.tsx", "used")], "path string, resolved_path string, name string")
    pair = "path string, name string"
    verdicts = truth.dead_verdicts(
        frame(spark, exports, EXPORT), imports, frame(spark, [("src/c.ts", "local"), (None, None)], pair), frame(spark, [("src/d.rs", "cmd")], pair),
        frame(spark, [("src/e.ts",)], "path string"), frame(spark, [("src/f.py", "is_ok", "predicate")], pair + ", tag string"), ("ok/**",),
    )
    got = {(r["path"], r["name"]): (r["reason"], r["confidence"], r["line"]) for r in verdicts.collect()}
    why = {k[1]: v[0] for k, v in got.items()}
    assert len(got) == len(exports) - 1 and got["src/a.ts", "idle"] == (None, "high", 2) and got["run.sh", "step"] == (None, "medium", 1)
    assert why == {
        "used": "imported", "idle": None, "starred": "imported whole", "local": "used in its file", "cmd": "handler", "lazy": "reached dynamically", "is_ok": "called by convention",
        "elsewhere": "imported by name", "t": "skipped: test", "Api": "skipped: public_language", "v": "skipped: vendored", "conf": "skipped: config", "again": "reexport", "step": None,
        "fine": "allowed", "Bridge": None, "named": None, "start": None,
    }
    texts = frame(spark, [("src/z.ts", "named('x'); run(\"voice-bridge\")"), ("src/m.ts", "named idle"), ("src/a.ts", "idle"), ("n", None)], "path string, content string")
    dead = {r["name"]: r for r in truth.dead_truth(verdicts, texts, frame(spark, [("src/n.ts",)], "path string")).collect()}
    assert {n: r["confidence"] for n, r in dead.items()} == {"idle": "low", "step": "medium", "Bridge": "low", "named": "low", "start": "low"}
    assert dead["Bridge"]["started_in"] == 1 and dead["named"]["named_in"] == 1 and dead["start"]["entry_point"]
    assert truth.dead_truth(verdicts, texts, frame(spark, [], "path string"), high_only=True).count() == 1
    assert truth.dead_truth(verdicts.limit(0), texts.limit(0), frame(spark, [], "path string")).collect() == []


def test_health_counts_each_dimension(spark):
    names = [n for group in truth.DEFECTS.values() for n in group]
    row = spark.createDataFrame([(3, 5000, *([0] * len(names)))], ", ".join(f"{c} long" for c in (*truth.SIZES, *names)))
    assert truth.health(row).first()["score"] == 100
    worse = row.withColumns({"missing_handlers": F.lit(4), "dead_exports": F.lit(9), "duplicate_exports": F.lit(14)})
    got = truth.health(worse).first()
    assert (got["certain"], got["high"], got["smell"]) == (4, 9, 2)
    assert got["score"] == round(100 - 50 * 0.18895 - 30 * 0.27034 - 20 * 0.12898)
    assert truth.health(row.withColumn("loc", F.lit(0)).withColumn("missing_handlers", F.lit(3))).first()["score"] == 100


def test_idiom_twins(spark):
    twins = frame(spark, [("on_x",), ("run_y",)], "name string")
    exports = frame(spark, [("a", "on_x"), ("b", "on_x"), ("a", "run_y"), ("b", "run_y")], "path string, name string")
    tags = frame(spark, [("a", "on_x", "handler"), ("b", "on_x", "handler"), ("a", "run_y", "entry"), ("b", "run_y", "test")], "path string, name string, tag string")
    assert [r["name"] for r in truth.idiom_twins(twins, exports, tags).collect()] == ["run_y"]


def test_cycle_kinds(spark):
    edges = [
        ("a.ts", "b.ts", "import"), ("b.ts", "a.ts", "import"), ("c/mod.rs", "c/d.rs", "use"), ("c/d.rs", "c/mod.rs", "use"), ("e.ts", "f.ts", "wildcard"), ("f.ts", "e.ts", "import"),
        ("g.rs", "h.rs", "cfg_use"), ("h.rs", "g.rs", "use"), ("s.ts", "s.ts", "import"), *((f"r{k}.ts", f"r{(k + 1) % 7}.ts", "import") for k in range(7)),
        ("i.ts", "j.ts", "import"), ("j.ts", "i.ts", "type_import"), ("k.ts", "k.js", "import"), ("tests/p.ts", "tests/q.ts", "import"), ("tests/q.ts", "tests/p.ts", "import"),
        *((f"x{k}.ts", "hub.ts", "import") for k in range(3)), ("hub.ts", "x0.ts", "import"), ("x0.ts", "x1.ts", "import"), ("x0.ts", "x2.ts", "import"),
    ]
    got = {r["component"]: r for r in graph.classified_cycles(frame(spark, edges, "src string, dst string, label string")).collect()}
    kinds = {k: r["kind"] for k, r in got.items()}
    assert kinds == {
        "a.ts": "hard_bidirectional", "c/d.rs": "module_self_reference", "e.ts": "wildcard_import", "g.rs": "cfg_gated", "s.ts": "unknown", "r0.ts": "hard_bidirectional",
        "tests/p.ts": "hard_bidirectional", "hub.ts": "fan_pattern",
    }
    assert got["r0.ts"]["risk"] == "medium" and got["hub.ts"]["risk"] == "none" and got["tests/p.ts"]["fixture"] and not got["a.ts"]["fixture"] and got["a.ts"]["severity"] == 3


def test_targets(spark):
    files = frame(spark, [("src/lib.rs",), ("app/src/lib.rs",), ("app/main.rs",), ("lib.rs",)], "path string")
    got = {r["asked"]: (r["path"], r["state"]) for r in explore.resolve_targets(files, frame(spark, [("main.rs",), ("./lib.rs",), ("src/lib.rs",), ("app\\main.rs",), ("gone",)], "asked string")).collect()}
    assert got == {"main.rs": ("app/main.rs", "suffix"), "./lib.rs": ("lib.rs", "exact"), "src/lib.rs": ("src/lib.rs", "exact"), "app\\main.rs": ("app/main.rs", "exact"), "gone": (None, "missing")}
    two = frame(spark, [("a/x.ts",), ("b/x.ts",)], "path string")
    assert explore.resolve_targets(two, frame(spark, [("x.ts",)], "asked string")).first()["state"] == "ambiguous"


def test_pages_by_cursor(spark):
    rows = frame(spark, [(k % 3, f"p{k:02}") for k in range(25)], "a long, b string")
    seen, cursor = [], None
    while True:
        page, cursor = explore.cursor_page(rows, ["a", "b"], "v1", 10, cursor)
        seen += [tuple(r) for r in page.collect()]
        if cursor is None:
            break
    assert seen == sorted((k % 3, f"p{k:02}") for k in range(25))
    _, cursor = explore.cursor_page(rows, ["a", "b"], "v1", 10)
    with pytest.raises(ValueError, match="another snapshot"):
        explore.cursor_page(rows, ["a", "b"], "v2", 10, cursor)
    with pytest.raises(ValueError, match="1 to 500"):
        explore.cursor_page(rows, ["a", "b"], "v1", 501)


def test_artifacts(spark, tmp_path):
    explore.write_artifacts(f"file://{tmp_path}", dead=frame(spark, [("a", 1), ("b", None)], "path string, line int"), empty=frame(spark, [], "x string"))
    got = {r["name"]: (r["columns"], r["rows"]) for r in spark.read.json(f"file://{tmp_path}/manifest").collect()}
    assert got == {"dead": ("path,line", 2), "empty": ("x", 0)}


def test_focus_keeps_groups_that_a_member_hits(spark):
    groups = frame(spark, [("a", "src/x.ts"), ("a", "lib/x.ts"), ("b", "lib/y.ts"), ("b", "lib/z.ts"), ("c", "src/q.ts"), ("c", "tests/q.ts")], "name string, path string")
    assert sorted(tuple(r) for r in explore.focused(groups, ("src/**",), ("tests/**",)).collect()) == [("a", "lib/x.ts"), ("a", "src/x.ts")]


def test_where_symbol(spark):
    exports = frame(spark, [("a", "f", "function", 3), ("a", "f", "function", 3), ("b", "f", "class", None)], "path string, name string, kind string, line long")
    locals_ = frame(spark, [("a", "f", "var", 3), ("c", "f", "var", 7)], "path string, name string, kind string, line long")
    nodes = frame(spark, [("a", "f", 1, 9), ("d", "f", 5, 6), ("c", "f", 8, 9)], "path string, name string, start_line long, end_line long")
    got = sorted((r["path"], r["line"], r["context"]) for r in explore.where_symbol(exports, locals_, nodes).collect())
    assert got == [("a", 3, "export function f"), ("c", 7, "local var f"), ("c", 8, "node f"), ("d", 5, "node f")]


def test_places(spark):
    texts = {
        "a.rs": "let mut size = 1;\nsize += 2;\nuse crate::size;\nif size == 3 { f(size) }\nPoint { size, x }\n// size here",
        "b.css": ".size { color: red }\nsize: 3px;\nwidth: var(--size);", "c.tsx": '<div className="big size" data-size="1">\nconst s = "the size";', "d.py": "x = size  # size", "e.md": "the size", "f.ts": "size size sizes",
    }
    rows = frame(spark, [*texts.items(), ("n", None)], "path string, content string")
    found = occurrences.occurrences(rows, ["size"])
    got = sorted((r["path"], r["line"], r["column"]) for r in found.collect())
    want = []
    import re

    for path, text in texts.items():
        for k, line in enumerate(text.split("\n"), 1):
            want += [(path, k, m.start() + 1) for m in re.finditer(r"(?<![A-Za-z0-9_])size(?![A-Za-z0-9_])", line)]
    assert got == sorted(want)
    kinds = {(r["path"], r["line"], r["column"]): r["kind"] for r in occurrences.classified(found).collect()}
    assert [kinds["a.rs", k, c] for k, c in ((1, 9), (2, 1), (3, 12), (4, 4), (5, 9), (6, 4))] == ["definition_like", "mutation_like", "import_like", "identifier", "field_emit_like", "comment"]
    assert [kinds["b.css", k, c] for k, c in ((1, 2), (2, 1), (3, 14))] == ["class_token", "css_property", "custom_property"]
    assert kinds["c.tsx", 1, 21] == "class_token" and kinds["c.tsx", 1, 32] == "data_attribute" and kinds["c.tsx", 2, 16] == "string_literal"
    assert kinds["d.py", 1, 5] == "identifier" and kinds["d.py", 1, 13] == "comment"
    first = occurrences.first_page(occurrences.enriched(occurrences.classified(found), frame(spark, [("a.rs", "size", 4)], "path string, name string, line long")), 2).collect()
    assert [(r["path"], r["line"], r["role"]) for r in first] == [("a.rs", 4, "definition"), ("a.rs", 4, "definition")]


def test_queries_expand_and_normalise():
    assert occurrences.expanded(["a|b", "c\\|d", "x|(y", "a"]) == ["a", "b", "c|d", "x|(y"]
    assert occurrences.normalised_query("ab c de") == "ab|de" and occurrences.normalised_query("a|b") == "a|b"


@pytest.mark.parametrize(
    ("line", "kinds"),
    [
        ("#[allow(dead_code)]", {"dead-code"}), ("#[allow(unused, dead_code)]", {"dead-code", "allow"}), ("#[expect(clippy::all)]", {"allow"}), ("unsafe { std::env::set_var(a, b) }", {"unsafe-env-var"}),
        ("unsafe {", {"unsafe"}), ("x = 1  # noqa: E501", {"noqa"}), ("// nosemgrep: rule.a", {"nosemgrep"}), ("// nosemgrep can also appear", set()), ("# type: ignore[arg]", {"type-ignore"}),
        ("// eslint-disable-next-line no-x", {"eslint-disable"}), ("# shellcheck disable=SC2086", {"shellcheck"}), ("#[ignore]", {"ignore"}), ("plain", set()),
    ],
)
def test_silencers(spark, line, kinds):
    texts = frame(spark, [("a", line)], "path string, content string")
    assert {r["kind"] for r in search.inventory(texts, search.SILENCERS).collect()} == kinds


def test_effect_lints(spark):
    code = "useEffect(() => { const t = setTimeout(f, 1); return () => clearTimeout(t) }, [])\nuseEffect(() => {\n  setInterval(f, 1)\n  window.addEventListener('x', f)\n}, [])"
    got = {r["rule"] for r in search.effect_lints(frame(spark, [("a.tsx", code), ("b", None)], "path string, content string")).collect()}
    assert got == {"react/setinterval-no-cleanup", "react/eventlistener-no-cleanup"}


def test_events_by_pattern(spark):
    event = "path string, name string, line long"
    emits = frame(spark, [("a", "job:1:done", 1), ("a", "job:*", 2), ("a", "job:", 3)], event)
    listens = frame(spark, [("b", "job:*:done", 1), ("b", "JOB:*", 2), ("b", "*", 3)], event)
    assert [tuple(r) for r in bridges.wildcard_events(emits, listens).collect()] == [("job_*", 1, 1)]
    got = sorted((r["pattern"], r["event"]) for r in bridges.matching_events(emits, listens).collect())
    assert got == [("*", "job_"), ("*", "job_1_done"), ("job_*", "job_"), ("job_*", "job_1_done"), ("job_*_done", "job_1_done")]


def test_constants_and_artifact_classes(spark):
    names = frame(spark, [("a", "SAVED", 1), ("a", "BOTH", 2), ("a", "plain", 3)], "path string, name string, line long")
    values = frame(spark, [("SAVED", "doc:saved"), ("SAVED", "doc:saved"), ("BOTH", "x"), ("BOTH", "y")], "name string, value string")
    assert sorted((r["name"], r["resolved"]) for r in bridges.resolved_constants(names, values).collect()) == [("BOTH", False), ("doc:saved", True), ("plain", False)]
    want = {"a/Cargo.lock": "generated", "x.map": "generated", ".env.example": "template", "third_party/x.c": "vendored", "dist/a.js": "generated", "build/a.js": "product", "package-lock.json": "generated"}
    got = frame(spark, [(p,) for p in want], "path string").select("path", paths.artifact_class(F.col("path")).alias("c"))
    assert {r["path"]: r["c"] for r in got.collect()} == want


def test_similar_files_of_a_popular_module(spark):
    rows = [(f"f{k}", m) for k in range(30) for m in ("popular", f"own{k}")]
    assert symbols.similar_files(frame(spark, rows, "path string, resolved_path string"), 0.5).collect() == []


def test_twin_classes(spark):
    exports = [
        ("a", "same", "function", ["x", "y"]), ("b", "same", "function", ["y", "x"]), ("a", "near", "function", ["x", "y"]), ("b", "near", "function", ["x", "z", "y"]), ("a", "far", "function", ["x"]),
        ("b", "far", "function", ["q"]), ("a", "mixed", "class", ["x"]), ("b", "mixed", "function", ["x"]), ("a", "bare", "class", None), ("b", "bare", "class", None), ("a", "to_x", "method", ["x"]),
        ("b", "to_x", "method", ["x"]), ("a", "draw", "method", ["x"]), ("b", "draw", "method", ["x"]), ("a", "alone", "class", ["x"]),
    ]
    imports = frame(spark, [("z", "b", "same")], "path string, resolved_path string, name string")
    got = {r["name"]: (r["class"], r["canonical"]) for r in symbols.exact_twins(frame(spark, exports, "path string, name string, kind string, signature array<string>"), imports).collect()}
    assert got == {
        "same": ("EXACT", "b"), "near": ("SHAPE_SIMILAR", "a"), "far": ("NAME_COLLISION", "a"), "mixed": ("NAME_COLLISION", "a"), "bare": ("NAME_COLLISION", "a"), "to_x": ("IDIOM", "a"), "draw": ("NAME_COLLISION", "a"),
    }
