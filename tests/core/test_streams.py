"""States of streams over restarts, repeated batches and merges."""

import datetime

from coppice.sources.snapshot import Snapshot
from coppice.streaming import patch

AT = datetime.datetime(2024, 1, 1)


def test_state_outlives_the_process_and_repeated_batches(spark, tmp_path):
    rows = [(k, k % 7, AT + datetime.timedelta(minutes=(k * 37) % 101), f"v{k}") for k in range(84)]
    frame = lambda part: spark.createDataFrame(part, "id long, who long, ts timestamp, v string")
    root = f"file://{tmp_path}/state"
    for batch in range(12):
        sink = patch.Upsert(spark, "who", ["ts", "id"], root, most=4)  # a new one each time, as after a restart
        sink(frame(rows[7 * batch : 7 * batch + 7]), batch)
        if batch % 3 == 1:
            sink(frame(rows[7 * batch : 7 * batch + 7]), batch)
        want = patch.newest(frame(rows[: 7 * batch + 7]), "who", ["ts", "id"])
        assert sorted(patch.Upsert(spark, "who", ["ts", "id"], root).table().collect()) == sorted(want.collect())
    assert len(patch.newest_pointer(spark, root)[1]) <= 4


def test_patches_equal_a_new_scan(spark, tmp_path):
    changes = [
        [("a.ts", "import { b } from './b'\n"), ("c.py", "x = 1\n")], [("b.ts", "export const b = 1\n")], [("c.py", None), ("a.ts", "import { b } from './b'\nexport const y = 1\n")],
    ]
    state, root = {}, f"file://{tmp_path}/snap"
    for k, batch in enumerate(changes):
        patch.Patch(spark, root)(spark.createDataFrame([(p, c, AT) for p, c in batch], "path string, content string, ts timestamp"), k)
        state |= dict(batch)
    fresh = Snapshot.of_texts(spark.createDataFrame([(p, c) for p, c in state.items() if c is not None], "path string, content string"))
    got = patch.Patch(spark, root).snapshot()
    for name in ("files", "symbols", "edges", "names"):
        rows = lambda s, n=name: sorted(map(str, getattr(s, n).select(*getattr(fresh, n).columns).collect()))
        assert rows(got) == rows(fresh)
    assert [(r["src"], r["dst"]) for r in got.edges.collect()] == [("a.ts", "b.ts")]


def test_a_batch_writes_its_changes_and_versions_merge(spark, tmp_path):
    root, state = f"file://{tmp_path}/small", {}
    sizes = []
    for k in range(7):
        batch = [(f"f{k}.ts", f"import {{ a }} from './f{k - 1}'\n" if k else "export const a = 1\n")] + ([(f"f{k - 2}.ts", None)] if k == 4 else [])
        if k == 0:
            batch += [(f"old{n}.ts", "export const x = 1\n" * 50) for n in range(30)]
        sink = patch.Patch(spark, root, most=4)
        sink(spark.createDataFrame([(p, c, AT) for p, c in batch], "path string, content string, ts timestamp"), k)
        state |= dict(batch)
        name = patch.newest_pointer(spark, root)[1][-1]
        sizes.append(spark.read.parquet(f"{root}/{name}/symbols").count())
    assert sizes[1] < 3 < sizes[0] and len(patch.newest_pointer(spark, root)[1]) <= 4
    got = patch.Patch(spark, root).snapshot()
    assert {r["path"] for r in got.files.collect()} == {p for p, c in state.items() if c is not None}
    assert {(r["src"], r["dst"]) for r in got.edges.collect()} == {(f"f{k}.ts", f"f{k - 1}.ts") for k in range(1, 7) if k not in (2, 3)}


def test_digests_of_directories(spark):
    from coppice.operators import diff

    files = lambda rows: spark.createDataFrame(rows, "path string, fingerprint string")
    old = files([("a/x", "1"), ("a/b/y", "2"), ("a/b/z", "3"), ("c/w", "4"), ("top", "5"), ("gone/q", "6")])
    new = files([("a/b/z", "3"), ("a/b/y", "9"), ("a/x", "1"), ("c/w", "4"), ("top", "5"), ("d/e/n", "7")])
    dirs = {(r["dir"], r["change"]) for r in diff.changed_directories(diff.directory_digests(old), diff.directory_digests(new)).collect()}
    assert dirs == {(".", "changed"), ("a", "changed"), ("a/b", "changed"), ("gone", "removed"), ("d", "added"), ("d/e", "added")}
    want = {("a/b/y", "changed"), ("gone/q", "removed"), ("d/e/n", "added")}
    assert {tuple(r) for r in diff.changed_contents(old, new).collect()} == want == {tuple(r) for r in diff.changed_contents(old, new, diff.directory_digests(old)).collect()}
    assert diff.changed_contents(old, old).collect() == [] and diff.changed_contents(old.limit(0), old.limit(0)).collect() == []
