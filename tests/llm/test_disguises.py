"""Disguises beyond brackets, spans beside plain ones, and the query's digest and spans against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from coppice.llm import pii

rng = random.Random(21)
PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def added(text):
    base, every = pii.find(text)
    assert all(set(base[k]) <= set(every[k]) for k in base)
    return [text[a:b] for k in every for a, b in sorted(set(every[k]) - set(base[k]))]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("host 192 dot 168 dot 1 dot 10 is up", ["192 dot 168 dot 1 dot 10"]),
        ("host 192 . 168 . 1 . 10 is up", ["192 . 168 . 1 . 10"]),
        ("write john at example.com now", ["john at example.com"]),
        ("write john @ example . com now", ["john @ example . com"]),
        ("write john @example.com now", ["john @example.com"]),
        ("write j o h n @ e x a m p l e . c o m now", ["j o h n @ e x a m p l e . c o m"]),
        ("write j o h n @ example.com", ["j o h n @ example.com"]),
        ("write john&#64;example&#46;com now", ["john&#64;example&#46;com"]),
        ("write john&commat;example&#x2e;com now", ["john&commat;example&#x2e;com"]),
        ("to=john%40example.com", ["john%40example.com"]),
        ("write jοhn@example.com now", ["jοhn@example.com"]),
        ("look at example.com and visit us at shop.example.org", []),
        ("at 5 . 6 . we met @ home. then", []),
        ("plain john@example.com and 10.0.0.1", []),
        ("300 dot 168 dot 1 dot 10", []),
    ],
)
def test_added_spans(text, found):
    assert added(text) == found


def brute(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    keep = {
        "email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda x: 13 <= len(digits(x)) <= 19 and pii.luhn(digits(x)), "phone": lambda x: 9 <= len(digits(x)) <= 15,
    }
    return [(k, *m.span()) for k, p in PLAIN for m in re.finditer(p, text) if keep[k](m[0])]


def test_query_columns(spark):
    parts = ["john@example.com", "10.0.0.1", "4111 1111 1111 1111", "+1 (212) 555-0100", "jοhn@example.com", "é ", "\n", "word ", " [at] ", "192 dot 1 dot 1 dot 9 "]
    rows = [(k, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))) for k in range(300)] + [(None, None), (5, "")]
    got = pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for doc, text in rows:
        spans = brute(text or "")
        n = Counter(k for k, _, _ in spans)
        want.append((doc, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    base = {(doc, text): brute(text or "") for doc, text in rows}
    order = [k for k, _ in PLAIN]
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (order.index(x[0]), *x[1:])) and len(set(spans)) == len(spans)
        plain = [b for (doc, _), b in base.items() if doc == r["doc_id"]]
        assert any(set(b) <= set(spans) and len(spans) == len(b) + r["n_disguised"] for b in plain)
    assert any(r["n_disguised"] for r in got)


def test_long_chains_of_signs_take_linear_time():
    import time

    for text in ("a dot " * 170_000, "a " * 300_000 + "x @ y", "x at a dot " * 60_000, "at dot " * 100_000):
        began = time.time()
        pii.find(text)
        assert time.time() - began < 20
