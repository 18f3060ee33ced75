"""The suffix family over several levels, and its byte comparison, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from coppice.llm import suffix_dedup

rng = random.Random(11)


def noise(n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


def adversarial():
    base, other = noise(1500), noise(1500)
    texts = ["ab" * 600, "ab" * 300 + "c" + "ab" * 300, "z" * 399, "z" * 400, "z" * 401, "é" * 500, "é" * 200, "", noise(399)]
    texts += [base[: 399 + k] + noise(50) for k in range(3)] + [noise(37 + k) + base[700:1100] + noise(80) for k in range(4)]
    for k in range(60):  # near copies: a changed byte here or there, so that ends differ on both sides
        cut = sorted(rng.sample(range(1500), rng.randint(1, 6)))
        near = list(other)
        for c in cut:
            near[c] = "#"
        texts.append(noise(rng.randint(0, 120)) + "".join(near) + noise(rng.randint(0, 60)))
    texts += [noise(100) + base[200:540] + noise(100) for _ in range(3)] + [base, base, other, texts[12], texts[12]]
    texts += [noise(30) + base[a : a + n] + noise(30) for a in (0, 100, 333) for n in (399, 400, 401, 450, 610)]
    return [(k if k % 9 else None, x) for k, x in enumerate(texts)] + [(1, None), (2, texts[2])]


def brute(texts):
    starts = Counter(x[i : i + 400] for x in texts for i in range(len(x) - 399))
    out = []
    for x in texts:
        hit = np.zeros(len(x) + 1, dtype=bool)
        for i in range(len(x) - 399):
            if starts[x[i : i + 400]] > 1:
                hit[i : i + 400] = True
        runs = int((hit[1:] & ~hit[:-1]).sum() + hit[0]) if len(x) else 0
        out.append((len(x), bytes(b for b, h in zip(x, hit, strict=False) if not h), int(hit.sum()), runs))
    return out


@pytest.mark.parametrize(("batches", "crowd"), [(7, 20_000), (1, 20_000), (3, 5)])
def test_levels_and_crowds(spark, monkeypatch, batches, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rows = adversarial()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter((d, *x) for (d, _), x in zip(rows, brute([(t or "").encode() for _, t in rows]), strict=True))
    got = suffix_dedup.removed(docs, batches).collect()
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in got) == want
    assert all(r["repeats"] for r in got if r["n_removed"])


def test_levels_merge_as_a_counter_carries(spark):
    docs = spark.createDataFrame([(k, noise(900)) for k in range(40)], "doc_id long, text string")
    family, every = suffix_dedup.SuffixFamily(), suffix_dedup.entries(suffix_dedup.texts(docs)).cache()
    for k in range(6):
        family.add(every.where(f"pmod(text_hash, 6) = {k}"))
        assert [level is not None for level in family.levels] == [bool(k + 1 >> b & 1) for b in range(len(family.levels))]
    assert sum(level.count() for level in family.levels if level is not None) == every.count()


def test_every_common_run_of_300_bytes_is_flagged(spark):
    run = noise(300)
    rows = [(k, noise(rng.randint(20, 400)) + run + noise(rng.randint(20, 400))) for k in range(2)] + [(k, noise(900)) for k in range(2, 30)]
    got = {r["doc_id"]: r["repeats"] for r in suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k < 2 for k in got}


def test_periodic_text_is_thinned_and_stays_exact(spark):
    long = "Is onhe. " * 600
    texts = [long, noise(70) + long[:2100] + noise(90), noise(10) + long[:450], long[3:420], noise(800), "ab" * 2000 + noise(500) + "ab" * 230]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.removed(docs, 2).collect()
    want = dict(enumerate(brute([t.encode() for t in texts])))
    assert {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in got} == want
    assert suffix_dedup.entries(suffix_dedup.texts(docs.where("doc_id = 0"))).count() < 60
