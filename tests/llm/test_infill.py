"""Fill-in-middle against a plain version over code points."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coppice.llm import infill

TEXTS = [
    None, "", " ", "a", "é", "word", "two words\n", "Straße, naïve café – 東京 🙂🙂 end", "<P> inside", "a <S", "<M", "x<M>", "🙂" * 50, "́leading mark", "a\x00b", "tab\t\r\n",
    "abc " * 4000, "日本語" * 9000, "line\n" * 7 + "é" * 9 + "z" * 300,
]


def plain_version(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    k1, k2 = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:k1]), "".join(tokens[k1:k2]), "".join(tokens[k2:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def rows():
    out = [(k, t) for k, t in enumerate(TEXTS * 12)]
    return [*out, (None, "lost id"), (3, "same id"), (3, "same id")]


def test_every_column_and_the_round_trip(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, output string, n int").repartition(3)
    got = infill.fill_in_middle(docs).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[5])
    assert sorted((tuple(r)[:6] for r in got), key=order) == sorted((plain_version(*r) for r in rows), key=order)
    assert Counter((r["doc_id"], r["again"]) for r in got) == Counter((k, t or "") for k, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_small_blocks_give_the_same(spark, rows, monkeypatch):
    column = infill.pa.array([(t or "").encode() for _, t in rows])
    monkeypatch.setattr(infill, "BLOCK", 64)
    pieces = list(infill.blocks(column.slice(2)))
    assert b"".join(d.tobytes() for _, _, d, _ in pieces) == b"".join((t or "").encode() for _, t in rows[2:])
    assert [b for b, *_ in pieces[1:]] == [e for _, e, *_ in pieces[:-1]] and pieces[-1][1] == len(rows) - 2


def test_empty_table(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@given(st.text(max_size=60))
def test_the_index_converts_both_ways(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    index = infill.Exceptions(data)
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:k].encode()) for k in chars])
    assert (index.to_bytes(chars) == places).all() and (index.to_chars(places) == chars).all()
    assert len(index.at) == sum(len(c.encode()) > 1 for c in text)


def test_the_query_equals_its_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = duckdb.sql(infill.OP13_SQL).fetchall()
    got = infill.op13_fill_in_middle(spark, at)
    assert got.columns == [d[0] for d in duckdb.sql(infill.OP13_SQL).description]
    assert sorted(map(tuple, got.collect())) == sorted(want)
