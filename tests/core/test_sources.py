"""Extraction from files, import resolution, snapshots, paths, names and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from coppice.functions import names, paths
from coppice.operators import diff, search, symbols
from coppice.sources import extract
from coppice.sources.snapshot import Snapshot
from coppice.streaming import patch

SOURCES = {
    "src/index.ts": "import { greet } from './greet';\nexport * from './util/date';\nconst x = import('./lazy');\nexport function main() { invoke('load_user') }\n",
    "src/greet.ts": "import { day } from './util/date'\nexport const greet = () => day // @ts-ignore\n",
    "src/util/date.ts": "import '../greet'\nexport class Day {}\nexport type Span = number\n",
    "src/lazy/index.ts": "export interface Lazy {}\n",
    "app/__init__.py": "",
    "app/service.py": "from app.model import User\nimport os\nKEY = os.environ['API_KEY']\nasync def serve(): pass  # noqa\n",
    "app/model.py": "from . import service\nclass User: pass\n",
    "core/lib.rs": "use crate::a::b;\npub mod item;\npub fn run() {}\n",
    "vendor/x.js": "export function v() {}\n",
    ".env": "API_KEY=1\nexport UNUSED=2\n",
}


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, content in SOURCES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    (root / "logo.png").write_bytes(b"\x89PNG\0\xff")
    (root / "node_modules").mkdir()
    (root / "node_modules/skip.js").write_text("export const no = 1")
    return extract.read_files(spark, str(root)).cache()


def test_scan_skips_binary_hidden_and_ignored_files(texts):
    assert sorted(r["path"] for r in texts.collect()) == sorted(SOURCES)


def test_extraction(texts):
    got = {(r["path"], r["table"], r["kind"], r["name"]) for r in extract.extract(texts).collect()}
    for row in [
        ("src/index.ts", "exports", "function", "main"), ("src/index.ts", "calls", "command", "load_user"), ("src/index.ts", "imports", "dynamic", "./lazy"),
        ("src/util/date.ts", "exports", "type", "Span"), ("app/service.py", "exports", "function", "serve"), ("app/service.py", "env_reads", "env", "API_KEY"),
        ("app/model.py", "exports", "class", "User"), ("core/lib.rs", "imports", "mod", "item"), (".env", "env_declarations", "dotenv", "UNUSED"),
    ]:
        assert row in got


def test_import_resolution(texts):
    snapshot = Snapshot.of_texts(texts)
    got = {(r["src"], r["dst"], r["label"]) for r in snapshot.edges.collect()}
    assert {
        ("src/index.ts", "src/greet.ts", "import"), ("src/index.ts", "src/util/date.ts", "reexport"), ("src/index.ts", "src/lazy/index.ts", "lazy_import"),
        ("src/greet.ts", "src/util/date.ts", "import"), ("src/util/date.ts", "src/greet.ts", "import"), ("app/service.py", "app/model.py", "import"),
    } <= got


def test_snapshot_patch_equals_a_new_scan(spark, texts, tmp_path):
    before = Snapshot.of_texts(texts)
    before.save(str(tmp_path / "a"))
    saved = Snapshot.load(spark, str(tmp_path / "a"))
    edited = texts.where("path <> 'src/lazy/index.ts'").withColumn("content", F.when(F.col("path") == "src/greet.ts", F.lit("export const other = 1\n")).otherwise(F.col("content")))
    changed = spark.createDataFrame([("src/greet.ts",), ("src/lazy/index.ts",)], "path string")
    after = saved.patched(Snapshot.of_texts(edited.where("path = 'src/greet.ts'")), changed)
    fresh = Snapshot.of_texts(edited)
    for name in ("files", "symbols", "edges"):
        assert diff.fingerprint(getattr(after, name)).first() == diff.fingerprint(getattr(fresh, name)).first()


def test_paths(spark):
    rows = [("a/index.ts",), ("a.tsx",), ("a\\b.py",), ("x/a.d.ts",), ("README",), ("fixtures/vendor/a.js",), ("lib/a.min.js",)]
    df = spark.createDataFrame(rows, "path string")
    got = {r["path"]: (r["m"], r["c"]) for r in df.select("path", paths.module_key(F.col("path")).alias("m"), paths.artifact_class(F.col("path")).alias("c")).collect()}
    assert got["a/index.ts"][0] == "a:ts" == got["a.tsx"][0] and got["a\\b.py"][0] == "a/b:py" and got["README"][0] == "README:" and got["x/a.d.ts"][0] == "x/a.d:ts"
    assert got["fixtures/vendor/a.js"][1] == "fixture" and got["lib/a.min.js"][1] == "vendored" and got["README"][1] == "product"
    one = df.limit(1).select(paths.matches_glob(F.lit("a/b/c.py"), "a/**/*.py").alias("x"), paths.matches_glob(F.lit("a/b/c.py"), "a/*.py").alias("y")).first()
    assert one["x"] and not one["y"]


def test_names(spark):
    row = spark.range(1).select(
        names.command_key(F.lit("getUserName_command")).alias("a"), names.command_key(F.lit("get-user_name")).alias("b"), names.event_key(F.lit("App:Start*")).alias("e"),
        names.edit_similarity(F.lit(""), F.lit("")).alias("s"), names.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j"),
    ).first()
    assert row["a"] == row["b"] == "getusername" and row["e"] == "app_start*" and row["s"] == 1 and row["j"] == 0


def test_literal_boundaries(spark):
    texts = spark.createDataFrame([("f", "run run_all rerun\nrun-x (run)\néé run"), ("g", None), ("h", "")], "path string, content string")
    got = {(r["line"], r["hits"], r["column"]) for r in search.literal_hits(texts, ["run"]).collect()}
    assert got == {(1, 1, 1), (2, 2, 1), (3, 1, 4)}
    assert {(r["line"], r["hits"]) for r in search.literal_hits(texts, ["run"], whole_token=True).collect()} == {(1, 1), (2, 1), (3, 1)}
    with pytest.raises(ValueError):
        search.regex_hits(texts, "(?<=a)b")


def test_empty_tables(spark):
    exports = spark.createDataFrame([], "path string, name string, kind string, line long, dir string, language string, is_test boolean")
    imports = spark.createDataFrame([], "path string, resolved_path string, name string, source string, is_test boolean")
    for rows in (symbols.dead_exports(exports, imports), symbols.duplicate_exports(exports), symbols.shadow_exports(exports, imports), symbols.inconsistent_paths(imports)):
        assert rows.collect() == []


def test_stream_equals_batch(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, k % 5, at + datetime.timedelta(minutes=(k * 37) % 100), f"v{k}") for k in range(60)]
    frame = spark.createDataFrame(rows, "id long, who long, ts timestamp, v string")
    frame.repartition(4).write.parquet(str(tmp_path / "changes.parquet"))
    got = patch.replay(spark, str(tmp_path), "changes", "who", ["ts", "id"])
    want = patch.newest(frame, "who", ["ts", "id"])
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 5
