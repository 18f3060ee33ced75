"""Names from source texts, and the operators on symbols end to end from a scan."""

import pytest

from coppice.operators import coverage, facts, symbols, truth
from coppice.sources import extract, names
from coppice.sources.snapshot import Snapshot

TREE = {
    "src/app.ts": """import def, { alpha as first,
  beta } from './lib'
import * as all from './util'
import type { Shape } from './lib'
import './style.css'
const x = await import('./lazy')
export { gamma as delta } from './util'
export * from './lib'
const local = 1
export { local as shown, x }
first(beta, all, def)
""",
    "src/lib.ts": "export const alpha = 1\nexport function beta() { return alpha }\nexport interface Shape {}\nexport const idle = 2\nexport default alpha\n",
    "src/util.ts": "export const gamma = 3\nexport const alpha = 4\n", "src/lazy.ts": "export const late = 1\n", "src/style.css": "a { color: red }",
    "tests/lib.test.ts": "import { beta } from '../src/lib'\nbeta()\n",
    "pkg/model.py": "__all__ = ['Model']\nclass Model: pass\nclass Hidden: pass\nLIMIT = 3\n",
    "pkg/service.py": "from .model import Model as M, LIMIT\nimport os.path as p\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from .types import T\ndef run():\n    import json\n    import_module('pkg.late')\n    return M(p)\n_private = 1\n",
    "pkg/late.py": "x = 1\n", "pkg/broken.py": "def (:\n",
    "core/lib.rs": "pub use crate::model::{User, Role as R};\nuse std::fmt;\nuse crate::api::*;\nuse a::b as c;\npub fn go() {}\n", "empty.py": "",
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([*TREE.items(), ("null.ts", None)], "path string, content string").cache()


def test_imported_names(texts):
    got = {(r["path"], r["kind"], r["source"], r["name"], r["alias"]) for r in names.names(texts).where("source IS NOT NULL").collect()}
    assert {x[1:] for x in got if x[0] == "src/app.ts"} == {
        ("static", "./lib", "default", "def"), ("static", "./lib", "alpha", "first"), ("static", "./lib", "beta", None), ("static", "./util", "*", "all"), ("type", "./lib", "Shape", None),
        ("side_effect", "./style.css", "", None), ("dynamic", "./lazy", "*", None), ("reexport", "./util", "gamma", "delta"), ("reexport", "./lib", "*", None),
    }
    assert {x[1:] for x in got if x[0] == "pkg/service.py"} == {
        ("static", ".model", "Model", "M"), ("static", ".model", "LIMIT", None), ("static", "os.path", "*", "p"), ("static", "typing", "TYPE_CHECKING", None), ("type", ".types", "T", None),
        ("lazy", "json", "*", None), ("dynamic", "pkg.late", "*", None),
    }
    assert {x[1:] for x in got if x[0] == "core/lib.rs"} == {
        ("reexport", "crate::model", "User", None), ("reexport", "crate::model", "Role", "R"), ("static", "std", "fmt", None), ("static", "crate::api", "*", None), ("static", "a", "b", "c"),
    }


def test_exports_uses_and_lines(texts):
    rows = names.names(texts).collect()
    exports = {(r["path"], r["name"]) for r in rows if r["kind"] == "export"}
    assert exports == {("src/app.ts", "shown"), ("src/app.ts", "x"), ("pkg/model.py", "Model"), ("pkg/late.py", "x"), ("pkg/service.py", "run")}
    assert ("pkg/broken.py", "unparsed") in {(r["path"], r["kind"]) for r in rows}
    assert {"M", "p", "import_module"} <= {r["name"] for r in rows if r["path"] == "pkg/service.py" and r["kind"] == "use"}
    lines = {(r["source"], r["name"]): r["line"] for r in rows if r["path"] == "src/app.ts" and r["source"]}
    assert lines["./lib", "beta"] == 1 and lines["./util", "*"] == 3 and lines["./lazy", "*"] == 6 and lines["./util", "gamma"] == 7


def test_operators_run_on_a_scan(spark, texts, tmp_path):
    Snapshot.of_texts(texts).save(str(tmp_path / "s"))
    scan = Snapshot.load(spark, str(tmp_path / "s"))
    imports, exports = scan.imports().cache(), scan.exports().cache()
    led = {(r["path"], r["name"]): r["resolved_path"] for r in imports.collect()}
    assert led["src/app.ts", "beta"] == "src/lib.ts" and led["pkg/service.py", "Model"] == "pkg/model.py" and led["tests/lib.test.ts", "beta"] == "src/lib.ts"
    none = spark.createDataFrame([], "path string, name string, tag string")
    scripts = exports.where("language IN ('ts', 'py')")
    dead = truth.dead_verdicts(scripts, imports.where("kind <> 'reexport'"), none.select("path", "name"), none.select("path", "name"), none.select("path"), none)
    reasons = {(r["path"], r["name"]): r["reason"] for r in dead.collect()}
    assert reasons["src/lib.ts", "alpha"] == "imported" and reasons["src/lib.ts", "idle"] is None and reasons["src/util.ts", "gamma"] == "imported whole"
    assert reasons["src/app.ts", "delta"] == "reexport" and reasons["pkg/model.py", "Model"] == "imported"
    assert {(r["path"], r["name"]) for r in coverage.covered_exports(exports, imports).collect()} == {("src/lib.ts", "beta")}
    assert {r["name"] for r in symbols.duplicate_exports(exports).collect()} >= {"alpha"}
    bound = {(r["path"], r["name"]): r["target"] for r in facts.bind_symbols(scan.uses().withColumn("dir", facts.F.lit("src")), exports).collect()}
    assert bound["tests/lib.test.ts", "beta"] == "src/lib.ts"


def test_a_new_file_satisfies_old_imports(spark, texts):
    before = Snapshot.of_texts(texts.where("path <> 'src/util.ts'"))
    after = before.patched(Snapshot.of_texts(texts.where("path = 'src/util.ts'")), spark.createDataFrame([("src/util.ts",)], "path string"))
    edges = lambda s: {(r["src"], r["dst"], r["label"]) for r in s.edges.collect()}
    assert edges(after) == edges(Snapshot.of_texts(texts)) != edges(before)


def test_syntax_nodes(texts):
    got = [(r["path"], r["line"], r["text"]) for r in names.syntax_nodes(texts, "Call").collect()]
    assert ("pkg/service.py", 9, "M(p)") in got and len(got) == 2
    with pytest.raises(ValueError, match="no kind"):
        names.syntax_nodes(texts, "Nothing")


def test_hidden_files_and_odd_roots_are_read(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    for name, text in ((".env", "KEY=1"), ("pkg/__init__.py", "x = 1"), ("pkg/m.py", "y = 2"), (".git/config", "no"), ("bin.dat", "a\0b")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = {r["path"]: r["content"] for r in extract.read_files(spark, str(root)).collect()}
    assert got == {".env": "KEY=1", "pkg/__init__.py": "x = 1", "pkg/m.py": "y = 2"}
