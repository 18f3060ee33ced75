"""Ignore rules of nested files, and listings by level."""

import pytest

from coppice.sources import extract, ignore

RULES = {
    ".gitignore": "# top\n*.log\n!keep.log\n/build/\nout/**\ndocs/*.md\n**/cache\n\\#odd\n[!a]x.txt\nsecret?\n@scan:dead-ok src/api/**\n",
    "src/.gitignore": "!*.log\nnested/\n/only.ts\n",
    "src/deep/.gitignore": "*.log\n!nested/\n",
    "src/deep/.ignore": "!last.log\n",
}
FATES = {
    "a.log": True, "keep.log": False, "sub/b.log": True, "sub/keep.log": False, "build/x.o": True, "sub/build/x.o": False, "out/a/b.c": True, "docs/a.md": True, "docs/in/a.md": False, "x/docs/a.md": False,
    "a/cache/f": True, "cache": True, "#odd": True, "bx.txt": True, "ax.txt": False, "secret1": True, "secret": False, "src/c.log": False, "src/only.ts": True, "src/sub/only.ts": False, "src/nested/f.ts": True,
    "src/nested/keep.log": True, "src/deep/d.log": True, "src/deep/last.log": False, "src/deep/nested/f.ts": False, "src/nested": False, "build": False,
}


@pytest.fixture(scope="module")
def by(spark):
    return spark.createDataFrame(list(RULES.items()), "path string, content string")


def test_last_match_of_the_nearest_file_wins(spark, by):
    files = spark.createDataFrame([(p, "kept") for p in FATES] + [("a.log", "again"), (None, "kept")], "path string, dir string")
    gone = {r["path"]: r["cause"] for r in ignore.ignored(files, ignore.rules(by)).collect()}
    assert {p: p in gone for p in FATES} == FATES
    assert gone["build/x.o"] == "build" and gone["src/nested/keep.log"] == "src/nested"
    left = ignore.kept(files, ignore.rules(by))
    assert left.columns == files.columns and {r["path"] for r in left.collect()} == {p for p, f in FATES.items() if not f} | {None}


def test_anchored_rules_directives_and_none(spark, by):
    files = spark.createDataFrame([("gen/a.ts",), ("sub/gen/a.ts",), ("gen",)], "path string")
    own = spark.createDataFrame([(".scanignore", "gen\n")], "path string, content string")
    assert {r["path"] for r in ignore.ignored(files, ignore.rules(own, (".scanignore",), anchored=True)).collect()} == {"gen/a.ts", "gen"}
    assert [tuple(r) for r in ignore.directives(by, "dead-ok").collect()] == [("", "src/api/**")]
    assert ignore.ignored(files, ignore.rules(by.limit(0))).collect() == []
    assert ignore.ignored(files.limit(0), ignore.rules(by)).collect() == []


def test_files_of_a_tree_less_the_ignored(spark, tmp_path):
    for path, content in {**RULES, "src/a.ts": "x", "a.log": "x", "src/nested/b.ts": "x", ".hid/_den/c.ts": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    (tmp_path / "src/loop").symlink_to(tmp_path / "src")
    listed = {r["uri"][len(str(tmp_path)) + 1 :]: r["hidden"] for r in extract.list_tree(spark, str(tmp_path)).collect()}
    assert listed == {**{k: True for k in RULES}, "src/a.ts": False, "a.log": False, "src/nested/b.ts": False, ".hid/_den/c.ts": True}
    got = {r["path"] for r in extract.read_files(spark, str(tmp_path), ignore_files=ignore.NAMES).collect()}
    assert got >= {*RULES, "src/a.ts", ".hid/_den/c.ts"} and not got & {"a.log", "src/nested/b.ts"}
