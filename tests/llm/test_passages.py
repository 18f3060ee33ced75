"""Recall of repeated passages on planted ones, cut by another rule than the operator's."""

import random

from coppice.llm import line_dedup

gen = random.Random(11)


def invented(n):
    return ["".join(gen.choice("abdeilmnorstuv") for _ in range(gen.randint(6, 9))) for _ in range(n)]


def test_planted_passages_go(spark):
    planted = [invented(gen.randint(50, 90)) for _ in range(60)]
    texts = []
    for k, passage in enumerate(planted):  # within a line, a line of its own, or two lines
        mark = (" ", "\n", "\n")[k % 3]
        held = " ".join(passage) if k % 3 < 2 else " ".join(passage[:30]) + "\n" + " ".join(passage[30:])
        texts += [mark.join([" ".join(invented(n)), held, " ".join(invented(20))]) for n in (30 + k, 7 + k)]
    whole = "\n".join(" ".join(invented(n)) for n in (3, 30, 9, 1, 25))
    texts += [whole, whole, "a few words\n of one\n", "", None]
    rows = spark.createDataFrame([(k, x, len(x or "")) for k, x in enumerate(texts)], "doc_id long, text string, n_chars long")
    rows = line_dedup.without_passages(rows.repartition(3)).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
    assert all(got[2 * k] == texts[2 * k] for k in range(60))
    assert [got[k] for k in range(120, 125)] == [whole, "", *texts[122:]]
    lost = []
    for k, passage in enumerate(planted):
        left = set(got[2 * k + 1].split())
        lost.append(sum(w in left for w in passage))
        around = [w for w in texts[2 * k + 1].split() if w not in passage]
        assert left >= set(around)
    # A passage between line ends goes whole; within a line a few words of its ends may stay.
    assert all(n == 0 for k, n in enumerate(lost) if k % 3) and max(lost) < 30 and sum(lost[::3]) < 0.2 * sum(map(len, planted[::3]))


def test_repeats_within_a_text_and_empty_table(spark):
    line = " ".join(invented(25)) + "\n"
    rows = spark.createDataFrame([(1, line * 2000), (1, line * 2000), (None, line)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.without_passages(rows).collect())
    assert got == [(0, line), (1, ""), (1, "")]
    assert line_dedup.without_passages(rows.limit(0)).collect() == []
