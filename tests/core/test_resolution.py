"""Imports of small trees with aliases, base folders, crates and packages."""

import json

import pytest

from coppice.sources import resolution

TREE = {
    "tsconfig.json": '{ // root\n "extends": "./config/tsconfig.base", "compilerOptions": {"paths": {"@app/*": ["src/app/*"], "exact": ["src/exact.ts"], "@one/*/two/*": ["src/*/deep/*",],},}}',
    "config/tsconfig.base.json": json.dumps({"extends": "../tsconfig.json", "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["wrong/*"], "@ui/*": ["gone/*", "src/ui/*"], "@ui/core/*": ["src/core/*"], "~/*.svg": ["assets/*.svg"]}}}),
    "packages/web/tsconfig.json": json.dumps({"compilerOptions": {"baseUrl": "lib", "paths": {"@app/*": ["*"]}}}),
    "broken/tsconfig.json": "{ not json",
    "svelte.config.js": "export default {}",
}
FILES = [
    *TREE, "src/app/main.ts", "src/app/page/index.tsx", "src/exact.ts", "src/ui/button.tsx", "src/ui/core/list.ts", "src/core/list.ts", "src/core/list.js", "assets/a.svg", "src/x/deep/y.ts", "src/lib/store.ts",
    "src/app/styles.css", "packages/web/lib/util.ts", "packages/web/src/page.ts", "broken/a.ts", "broken/b.ts",
    "app/__init__.py", "app/service.py", "app/sub/__init__.py", "app/sub/deep.py", "src/tool/run.py", "svc/pyproject.toml", "svc/jobs/work.py", "svc/src/later.py", "app/stub.pyi",
    "Cargo.toml", "src/lib.rs", "src/main.rs", "src/net/mod.rs", "src/net/http.rs", "src/util.rs", "src/util/time.rs", "src/odd_file.rs", "tools/x/Cargo.toml", "tools/x/main.rs", "tools/x/args.rs",
]
WANT = [
    ("src/app/main.ts", "./page", "static", "src/app/page/index.tsx", "relative"), ("src/app/main.ts", "../ui/button", "static", "src/ui/button.tsx", "relative"),
    ("src/app/main.ts", "@app/page", "static", "src/app/page/index.tsx", "alias"), ("src/app/main.ts", "exact", "static", "src/exact.ts", "alias"), ("src/app/main.ts", "@ui/button", "dynamic", "src/ui/button.tsx", "alias"),
    ("src/app/main.ts", "@ui/core/list", "static", "src/core/list.ts", "alias"), ("src/app/main.ts", "@ui/core/list.js", "static", "src/core/list.js", "alias"), ("src/app/main.ts", "~/a.svg", "static", "assets/a.svg", "alias"),
    ("src/app/main.ts", "@one/x/two/y", "static", "src/x/deep/y.ts", "alias"), ("src/app/main.ts", "src/core/list", "static", "src/core/list.ts", "base"), ("src/app/main.ts", "$lib/store", "static", "src/lib/store.ts", "alias"),
    ("src/app/main.ts", "./styles.css", "side_effect", "src/app/styles.css", "relative"), ("src/app/main.ts", "react", "static", None, None), ("src/app/main.ts", None, "static", None, None),
    ("packages/web/src/page.ts", "@app/util", "static", "packages/web/lib/util.ts", "alias"), ("packages/web/src/page.ts", "util", "static", "packages/web/lib/util.ts", "base"), ("packages/web/src/page.ts", "@ui/button", "static", None, None),
    ("broken/a.ts", "b", "static", "broken/b.ts", "base"), ("broken/a.ts", "./b", "static", "broken/b.ts", "relative"),
    ("app/service.py", "app.sub", "static", "app/sub/__init__.py", "package"), ("app/service.py", "app.sub.deep", "static", "app/sub/deep.py", "package"), ("app/sub/deep.py", "..service", "static", "app/service.py", "relative"),
    ("app/sub/deep.py", ".", "static", "app/sub/__init__.py", "relative"), ("app/sub/deep.py", "..", "static", "app/__init__.py", "relative"), ("app/service.py", "tool.run", "static", "src/tool/run.py", "package"), ("app/service.py", "app.stub", "static", "app/stub.pyi", "package"),
    ("svc/jobs/work.py", "jobs.work", "static", "svc/jobs/work.py", "package"), ("svc/jobs/work.py", "later", "static", "svc/src/later.py", "package"), ("svc/jobs/work.py", "os.path", "static", None, None),
    ("src/lib.rs", "net", "mod", "src/net/mod.rs", "mod"), ("src/lib.rs", "util", "mod", "src/util.rs", "mod"), ("src/util.rs", "time", "mod", "src/util/time.rs", "mod"), ("src/net/mod.rs", "http", "mod", "src/net/http.rs", "mod"), ("src/lib.rs", "path:odd_file.rs", "mod", "src/odd_file.rs", "mod"),
    ("src/main.rs", "crate::net::http::Client", "static", "src/net/http.rs", "crate"), ("src/main.rs", "crate::net::{A, B}", "static", "src/net/mod.rs", "crate"), ("src/net/http.rs", "super::Client", "static", None, None),
    ("src/net/mod.rs", "super::util::time::now", "static", "src/util/time.rs", "crate"), ("src/net/http.rs", "crate::util::Clock", "static", "src/util.rs", "crate"), ("src/util.rs", "self::time::now", "static", "src/util/time.rs", "crate"),
    ("src/main.rs", "std::fmt", "static", None, None), ("tools/x/main.rs", "crate::args::Args", "static", "tools/x/args.rs", "crate"), ("src/net/http.rs", "super::super::x", "static", None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame([(f,) for f in FILES], "path string")
    texts = spark.createDataFrame(list(TREE.items()) + [("svc/pyproject.toml", None)], "path string, content string")
    return files, texts


def test_every_way(spark, tables):
    rows = [(*w[:3], k, "kept") for k, w in enumerate(WANT)]
    imports = spark.createDataFrame([*rows, (*rows[0][:3], 999, "kept")], "path string, name string, kind string, line int, candidate string")
    got = {r["line"]: r for r in resolution.resolve(imports, *tables).collect()}
    found = {k: (got[k]["resolved_path"], got[k]["via"]) for k in range(len(WANT))}
    assert {WANT[k][:2]: v for k, v in found.items()} == {w[:2]: w[3:] for w in WANT}
    assert got[999]["resolved_path"] == WANT[0][3] and got[0]["candidate"] == "kept"


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert resolution.resolve(none("path string, name string, kind string"), none("path string"), none("path string, content string")).collect() == []
    one = spark.createDataFrame([("a.ts", "@x/y", "static")], "path string, name string, kind string")
    assert [r["resolved_path"] for r in resolution.resolve(one, none("path string"), none("path string, content string")).collect()] == [None]
