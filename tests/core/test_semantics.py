"""Tags, entry points and dispatch of small sources."""

from coppice.sources import semantics

TREE = {
    "app.py": "@app.route('/x')\n@login\ndef page():\n    pass\n@pytest.fixture\ndef db():\n    pass\ndef test_it():\n    pass\nif __name__ == '__main__':\n    run()\n",
    "lib.rs": "#[tauri::command]\npub async fn load() {}\n#[test]\nfn works() {}\nimpl A { \n  pub fn new() -> A {} }\nfn main() {}\n",
    "run.sh": "#!/bin/bash\ntrap cleanup EXIT\ncase $1 in\n  up|start) do_start \"$2\" ;;\n  down) do_stop ;;\nesac\nmain \"$@\"\n",
    "Makefile": ".PHONY: all\nall: build docs\nbuild: src/a.c\n\tcc $<\nX := 1\n", "ext.ts": "export function activate(c) {}\nexport function handleSave() {}\n", "m.swift": "@main\nstruct A {}\n", "none": None,
}


def test_semantics(spark):
    texts = spark.createDataFrame(list(TREE.items()), "path string, content string")
    tags = {(r["path"], r["name"], r["tag"]) for r in semantics.semantic_tags(texts).collect()}
    assert tags == {
        ("app.py", "page", "handler"), ("app.py", "db", "test"), ("app.py", "test_it", "test"), ("app.py", "run", "entry"), ("lib.rs", "load", "handler"), ("lib.rs", "works", "test"),
        ("lib.rs", "new", "constructor"), ("lib.rs", "main", "entry"), ("run.sh", "cleanup", "handler"), ("run.sh", "main", "entry"), ("Makefile", "all", "entry"), ("Makefile", "build", "entry"),
        ("ext.ts", "activate", "entry"), ("ext.ts", "handleSave", "handler"),
    }
    assert {r["path"] for r in semantics.entry_points(texts).collect()} == {"app.py", "lib.rs", "run.sh", "m.swift"}
    edges = {(r["kind"], r["src"], r["dst"]) for r in semantics.dispatch_edges(texts).collect()}
    assert edges == {("depends", "all", "build"), ("depends", "all", "docs"), ("depends", "build", "src/a.c"), ("case", "up", "do_start"), ("case", "start", "do_start"), ("case", "down", "do_stop")}
