"""The Viterbi search against an exhaustive decoding, and its time on long words."""

import random
import time

import pytest

from coppice.llm import toxicity as t

rng = random.Random(5)


@pytest.fixture(scope="module")
def model():
    return t.LanguageModel([(rng.randrange(t.SYMBOLS**3), rng.randint(1, 50)) for _ in range(4000)])


def readings(seen, i, spelled, open_):
    """(characters read, cost, what is written) of every step from place i; open_: the last symbol is a letter."""
    c, run = seen[i], 1
    while i + run < len(seen) and seen[i + run] == c:
        run += 1
    if c in t.SEPARATORS and 0 < i < len(seen) - 1:
        yield 1, t.DROP_COST, ""
    for brk in ("", " ") if spelled and open_ else ("",):
        for x in [*t.LEET.get(c, ""), c]:
            letter = x in t.INDEX
            cost = (t.LEET_COST if x != c else 0.0 if letter else t.KEPT_COST) + (t.BREAK_COST if brk else 0.0)
            yield 1, cost, brk + x
            if run > 1:
                yield run, cost + (t.RUN_COST if run > 2 else t.PAIR_COST), brk + x
            if run > 2 and letter:
                yield run, cost + t.RUN_COST, brk + x + x


def exhaustive(seen, model, spelled):
    log, best = model.log, (float("-inf"), "")

    def walk(i, a, b, score, text):
        nonlocal best
        if i == len(seen):
            best = max(best, (score + (log[a][b][0] if b else 0.0), text))
            return
        for read, cost, written in readings(seen, i, spelled, bool(b)):
            a1, b1, s = a, b, score + cost
            for x in written:
                k = t.INDEX.get(x, 0)
                if k or b1:
                    s += log[a1][b1][k]
                a1, b1 = b1, k
            walk(i + read, a1, b1, s, text + written)

    walk(0, t.ANY, 0, 0.0, "")
    return best


@pytest.mark.parametrize("spelled", [False, True])
def test_restored_words_are_the_best_of_all(model, spelled):
    for _ in range(250):
        seen = "".join(rng.choice("aabet013@$.-") for _ in range(rng.randint(1, 6)))
        score, text = exhaustive(seen, model, spelled)
        assert t.restore(seen, model, spelled) == text, (seen, score)


@pytest.mark.parametrize("seen", ["a" * 200_000, "ab3" * 70_000])
def test_long_words_take_linear_time(model, seen):
    began = time.time()
    t.restore(seen, model)
    assert time.time() - began < 8
