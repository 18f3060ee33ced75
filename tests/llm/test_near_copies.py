"""Near copies against brute force on edited copies."""

import random

from coppice.llm import near_copies

gen = random.Random(5)


def invented(n):
    return ["".join(gen.choice("abdeilmnorstuv") for _ in range(gen.randint(3, 9))) for _ in range(n)]


def similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_near_copies_by_edited_words(spark):
    texts = [None, "", "  \n", "one two", "One  two"]
    for _ in range(25):
        base = invented(gen.randint(60, 300))
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5):
            copy = list(base)
            for at in gen.sample(range(len(copy)), edits):
                copy[at] = invented(1)[0]
            texts.append(" ".join(copy))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i] or "", texts[j] or "") >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    rows = [(k, x, "x") for k, x in enumerate(texts)]
    frame = spark.createDataFrame([*rows, rows[9], (None, "lost id", "x")], "doc_id long, text string, key string").repartition(3)
    got = near_copies.one_of_each(frame)
    assert got.columns == frame.columns
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect()) == [-1, *sorted({root.index(x) for x in root})]
    assert 27 <= len(set(root)) < 80 and near_copies.one_of_each(frame.limit(0)).collect() == []
