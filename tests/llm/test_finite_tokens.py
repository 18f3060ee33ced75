"""Token counts of the compiled transducer against the library itself."""

import random
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coppice.llm import finite_tokens

rng = random.Random(3)
LETTERS = "abcdeorstinhlmgy'.,!? \n\t0189éßΣ日ʼ🙂"
TEXTS = [
    None, "", " ", "a", "hello world", "a'sb 're'ress'' 'd !'s ١٢½² ４ áb ª", "x<|endoftext|>y <|startoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext", "İΣΣ ΑΣ Σ'", "é́ 東京 🙂🙂\n\n'",
    "'", "''s", "'ll've'l're", "aaaaaaaaaaaa" * 50, "word" * 500, "0" * 300, "!?" * 200, "͸\U0001f9fe﷐ x", "z" * 30_000, "東京" * 9000, "the cat " * 9000,
    *("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 80))) for _ in range(300)),
]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: len(made.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def machines():
    return finite_tokens.Counter()


@pytest.mark.parametrize("part", [5, 64, 1 << 16])
def test_counts_of_texts_and_of_their_parts(spark, library, part):
    rows = [*enumerate(TEXTS), (None, "lost id"), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, row string, n_tokens int").repartition(3)
    got = finite_tokens.token_counts(docs, limit=20, part=part).collect()
    want = [(k, len((t or "").encode()), library(t), library(t) > 20) for k, t in rows]
    assert Counter(map(tuple, got)) == Counter(want)


def test_empty_table(spark):
    assert finite_tokens.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=40))
def test_any_text(library, machines, text):
    assert machines.counts([text]) == [library(text)]


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="aeinrst' 1.", max_size=60), size=st.integers(1, 9))
def test_maps_compose(library, machines, text, size):
    (stream,), _ = machines.pieces.streams([text])
    data = stream.tobytes()
    maps = machines.mapped([data[a : a + size] for a in range(0, max(1, len(data)), size)])
    assert machines.composed(maps) == library(text)


def test_lanes_that_a_word_fills_and_a_table_that_is_full(library, machines, monkeypatch):
    texts = [t or "" for t in TEXTS]
    want = [library(t) for t in texts]
    monkeypatch.setattr(finite_tokens, "LANE", 4)
    assert machines.counts(texts[:60]) == want[:60]
    monkeypatch.setattr(finite_tokens, "CELLS", 1 << 16)
    fresh = finite_tokens.Transducer(machines.transducer.vocabulary)
    streams, specials = machines.pieces.streams(texts)
    assert [n + s for n, s in zip(fresh.counted(streams), specials, strict=True)] == want
    assert len(fresh.state) * fresh.width < 1 << 22


def test_a_long_word_takes_linear_time(machines):
    import time

    began = time.time()
    machines.counts(["ab" * 200_000])
    assert time.time() - began < 30


def test_the_query(spark, library):
    at = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = finite_tokens.op11_token_counts(spark, at).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {k: (len((t or "").encode()), library(t), library(t) > 2048) for k, t in texts.items()}
