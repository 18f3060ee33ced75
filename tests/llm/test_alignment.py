"""Token alignment against the libraries and a plain merge of their ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coppice.llm import alignment
from coppice.llm.finite_tokens import byte_letters

rng = random.Random(5)
TEXTS = [
    None, "", " ", "a", "hello world", "two  spaces here", " lead", "trail ", "tab\t and\n\nlines \r\n end", "▁piece ▁ mark", "<s>hi</s> <|endoftext|> <0x41>", "日本語 ☃🙂 Straße naïve", "\x00 x",
    "x" * 200 + " y", "word " * 3000 + "end", "﷐퟿ z", "hello world", "it's we'll they're 123456 3.14!",
    *("".join(rng.choice("abcdeorst  inl.,'\n012é日🙂") for _ in range(rng.randint(1, 120))) for _ in range(150)),
]


def ends_of(tokens):
    total, out = 0, []
    for t in tokens:
        total += len(t)
        out.append(total)
    return out


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    byte = {c: k for k, c in enumerate(byte_letters())}

    def tokens(text):
        if not text:
            return [], [], [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [bytes(byte[c] for c in a.id_to_token(k)) for k in ids]
        other = b.encode(text)
        right = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in other]
        if b"".join(left) != b" " + text.encode() or b"".join(right) != b" " + text.encode():
            return [], [], [], []
        return ids, ends_of(left), other, ends_of(right)

    return tokens


def plain_version(rows, tokens):
    """By sets of ends and dictionaries of counts."""
    seen, counts = [], Counter()
    for k, text in rows:
        a, ends_a, b, ends_b = tokens(text)
        groups, links, done_a, done_b = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end, done_a) + 1, ends_b.index(end, done_b) + 1
            groups.append(",".join(map(str, a[done_a:i])) + "|" + ",".join(map(str, b[done_b:j])))
            links.append((a[i - 1], b[j - 1]))
            done_a, done_b = i, j
        counts.update(links)
        seen.append((k, len(a), len(b), len(groups), ";".join(groups), links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for k, n_a, n_b, n, text, links in seen:
        yield k, n_a, n_b, n, hashlib.sha256(text.encode()).hexdigest() if text else "", n, sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), text


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 40, 1])
def test_every_column(spark, libraries, heavy):
    rows = [*enumerate(TEXTS), (None, "lost id"), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame([(*r, "clash", 7, 1) for r in rows], "doc_id long, text string, row string, links int, pair int").repartition(3)
    got = alignment.token_alignment(docs, heavy=heavy, keep=True).select(*COLUMNS, "groups").collect()
    assert Counter(map(tuple, got)) == Counter(plain_version(rows, libraries))


def test_empty_table(spark):
    assert alignment.token_alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=200, deadline=None)
@given(a=st.sets(st.integers(1, 80)), b=st.sets(st.integers(1, 80)), lane=st.integers(1, 9))
def test_pieces_of_a_merge_find_all_equal_ends(a, b, lane):
    before, alignment.LANE = alignment.LANE, lane
    try:
        x, y = (np.array(sorted(s), dtype=np.int64) for s in (a, b))
        i, j, per_piece = alignment.merge(x, y)
        diagonals = np.arange(0, len(x) + len(y), lane)
        taken = alignment.crossings(x, y, diagonals)
    finally:
        alignment.LANE = before
    both = np.array(sorted(a & b))
    assert (x[i] == both).all() and (y[j] == both).all() and len(i) == len(j) == len(both) == per_piece.sum()
    order = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
    assert [sum(kind == 0 for _, kind in order[:d]) for d in diagonals.tolist()] == taken.tolist()


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab c\n▁é'1", max_size=30), max_size=4))
def test_words_are_the_libraries_tokens(libraries, texts):
    tokens = alignment.words(None, None)
    for text, (a, b) in zip(texts, tokens.packed(texts), strict=True):
        ids_a, _, ids_b, _ = libraries(text)
        assert [x & alignment.ID for x in np.frombuffer(a, dtype=np.uint32).tolist()] == ids_a
        assert [x & alignment.ID for x in np.frombuffer(b, dtype=np.uint32).tolist()] == ids_b


def test_the_query(spark, libraries):
    at = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    got = alignment.op12_token_alignment(spark, at).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(r[:-1] for r in plain_version(rows, libraries))
