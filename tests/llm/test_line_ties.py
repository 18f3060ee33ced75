"""Equal chunks and passages at one doc_id and place, in different texts."""

from coppice.llm import line_dedup

LINES = "\n".join(f"a line of words number {k} which stands in both" for k in range(40))


def test_of_equal_doc_ids_one_text_keeps_a_chunk(spark):
    rows = [(1, LINES + "\nthe end of one"), (1, LINES + "\nquite another end"), (1, LINES + "\nthe end of one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Single-line chunks stay; documents equal in both count as one.
    texts = [r["text"] for r in line_dedup.deduplicated(docs).collect()]
    whole = {t for t in texts if t in (rows[0][1], rows[1][1])}
    assert len(whole) == 1 and all(len(t) < 500 for t in texts if t not in whole)
    texts = [r["text"] for r in line_dedup.without_passages(docs).collect()]
    assert sum(t in (rows[0][1], rows[1][1]) for t in texts) in (1, 2) and min(map(len, texts)) < 200
