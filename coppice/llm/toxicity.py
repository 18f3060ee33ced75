"""Toxicity scores of restored text: noisy-channel deobfuscation, then a linear score.

1. A character language model: trigram counts over all documents.
2. Words that look disguised (digits or signs among letters, letters three times in a
   row, letters parted by dots or dashes, or spelled out with spaces) span a lattice
   of what could have been meant: leetspeak substitutions, shortened repetitions and
   dropped separators. A Viterbi search under the language model restores the word.
3. Restored words and their first 4, 5 and 6 letters are counted by label over at most
   ``SAMPLE`` labelled rows, those of the smallest hashes of doc_id whose
   crc32(doc_id) is not 0 modulo 5. Features whose log odds ratio is clearly positive
   (two standard errors) enter an L1 logistic regression over the same rows, in which
   those that others explain get no weight.
4. A document's score is that regression's probability. Labels, lang, source and
   doc_id play no part in it.

The model has at most ``SYMBOLS``³ counts, and its weights are bounded by the sample's
words, whatever the corpus; counting and scoring read each text once and shuffle no text.

Defined results: a null or empty text has the intercept's score; a document labelled
several times is toxic if any label says so, and null labels are left out; without
toxic or without other labelled rows no feature is known and the score is below a
half; equal texts get equal scores, one row each; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.storage import materialize, table

SAMPLE = 20_000
PENALTY = 1.0
PREFIXES = (4, 5, 6)
MEMO = 200_000
LONGEST = 64

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
SYMBOLS = len(LETTERS) + 1  # 0 is anything that isn't a letter
ANY = SYMBOLS  # unknown first context
INDEX = {c: k for k, c in enumerate(LETTERS, 1)}

# What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i",
}
SEPARATORS = frozenset(".-_*·~'/\\ ")
EDGE = ".,;:?\"'()[]{}<>*#%&~^_=/\\-…»«“”„’"
LEET_COST, KEPT_COST, DROP_COST, BREAK_COST = math.log(0.2), math.log(0.001), math.log(0.5), math.log(0.01)
PAIR_COST, RUN_COST = math.log(0.01), math.log(0.5)

_leet = re.escape("".join(LEET))
DISGUISED = re.compile(rf"[^\W\d_]*[{_leet}]+[^\W\d_]|[^\W\d_][{_leet}]|([^\W\d_])\1\1|(?:[^\W_][.\-_*·~/]){{2,}}[^\W_]")
LETTER = re.compile(r"[^\W\d_]")
SPELLED = re.compile(r"(?<!\S)[^\s.,;:](?:[ \t][^\s.,;:]){3,}(?!\S)")


def symbol_table() -> np.ndarray:
    """Code point -> symbol, for code points below 512."""
    table_ = np.zeros(512, dtype=np.int64)
    for c, k in INDEX.items():
        table_[ord(c)] = k
        if len(c.upper()) == 1 and ord(c.upper()) < 512:
            table_[ord(c.upper())] = k
    return table_


def character_counts(docs: DataFrame) -> DataFrame:
    """(code, n): trigrams of symbols over all documents, runs of non-letters as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, total = symbol_table(), np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
                s = np.zeros(len(points) + 2, dtype=np.int64)
                s[1:-1] = symbols[np.where(points < 512, points, 0)]
                s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        code = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    return docs.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log probabilities of a symbol after two others, interpolated with shorter contexts."""

    def __init__(self, counts: list[tuple[int, int]]):
        tri = np.zeros(SYMBOLS**3)
        for code, n in counts:
            tri[code] = n
        tri = tri.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        bi = tri.sum(axis=0)
        uni = (bi.sum(axis=0) + 1) / (bi.sum() + SYMBOLS)
        p2 = (bi + 5 * uni) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(np.concatenate([p3, p2[None]])).tolist()


def restore(seen: str, model: LanguageModel, spelled: bool = False) -> str:
    """What was most likely meant by a disguised word, in lower case; an exact Viterbi search over its lattice.

    A state is the last two symbols. What it has written is a chain of links that states
    share, so time and memory are linear in the word.
    """
    log, n = model.log, len(seen)
    runs = [1] * n
    for i in range(n - 2, -1, -1):
        if seen[i] == seen[i + 1]:
            runs[i] = runs[i + 1] + 1
    best: dict[int, dict[tuple[int, int], tuple[float, tuple]]] = {0: {(ANY, 0): (0.0, ())}}

    def reach(at: int, state: tuple[int, int], score: float, written: tuple) -> None:
        states = best.setdefault(at, {})
        if state not in states or states[state][0] < score:
            states[state] = (score, written)

    for i, c in enumerate(seen):
        run = runs[i]
        meant = [(x, LEET_COST) for x in LEET.get(c, "")] + [(c, 0.0 if c in INDEX else KEPT_COST)]
        for (a, b), (score, written) in best.pop(i, {}).items():
            if c in SEPARATORS and 0 < i < n - 1:
                reach(i + 1, (a, b), score + DROP_COST, written)
            starts = [(a, b, score, written)]
            if spelled and b:
                starts.append((b, 0, score + log[a][b][0] + BREAK_COST, (written, " ")))
            for a1, b1, so_far, before in starts:
                for x, cost in meant:
                    k = INDEX.get(x, 0)
                    if not k and b1 == 0 and x != c:
                        continue
                    here, link = so_far + cost + (log[a1][b1][k] if k or b1 else 0.0), (before, x)
                    reach(i + 1, (b1, k), here, link)
                    if run > 1:
                        reach(i + run, (b1, k), here + (RUN_COST if run > 2 else PAIR_COST), link)
                        if run > 2 and k:
                            reach(i + run, (k, k), here + RUN_COST + log[b1][k][k], (link, x))
    ends = ((score + (log[a][b][0] if b else 0.0), written) for (a, b), (score, written) in best.get(n, {}).items())
    link = max(ends, key=lambda x: x[0], default=(0.0, ()))[1]
    out = []
    while link:
        link, x = link
        out.append(x)
    return "".join(reversed(out)) or seen


def words_of(text: str, memo: dict[str, tuple[str, ...]], model: LanguageModel) -> set[str]:
    """The distinct restored words of a whole text."""
    lowered = text.lower()
    if len(memo) > MEMO:
        memo.clear()
    out: set[str] = set()
    for token in set(lowered.split()):
        word = memo.get(token)
        if word is None:
            word = tuple(restored(token, model).split())
            if len(token) <= LONGEST:
                memo[token] = word
        out.update(word)
    for run in SPELLED.findall(lowered):
        if len(set(run)) > 3:
            joined = run.replace(" ", "").replace("\t", "")
            out.update(restore(joined, model, spelled=True).split())
            out.update(restore(joined, model).split())
    return out


def restored(token: str, model: LanguageModel) -> str:
    word = token.strip(EDGE)
    if word.endswith("$$$"):
        word = word.rstrip("$")
    if word.endswith("!"):
        word = word.rstrip("!")
    if DISGUISED.search(word) and LETTER.search(word):
        return restore(word, model)
    return word


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chosen_labels(labels: DataFrame, sample: int) -> DataFrame:
    """doc_id and toxic of at most `sample` labelled rows."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    each = usable.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def labelled_words(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(word, toxic, other) counts over labelled rows; the rows themselves count as the word ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.update((w, toxic) for w in words_of(text or "", memo, model))
                counts["", toxic] += 1
            words, toxic = zip(*counts, strict=True) if counts else ((), ())
            n, is_toxic = np.fromiter(counts.values(), dtype=np.int64), np.array(toxic, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(n * is_toxic), pa.array(n * ~is_toxic)], names=["word", "toxic", "other"]
            )

    counted = rows.select("text", "toxic").mapInArrow(run, "word string, toxic bigint, other bigint")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def candidates(words: DataFrame) -> list[str]:
    """Features whose log odds ratio is clearly above 0, the strongest first."""
    total = words.where("word = ''").first()
    if not (total and total["toxic"] and total["other"]):
        return []
    parts = [F.concat(F.lit("="), F.col("word"))] + [
        F.when(F.length("word") >= n, F.concat(F.lit("^"), F.substring("word", 1, n))) for n in PREFIXES
    ]
    each = words.where("word <> ''").select(F.explode(F.array(*parts)).alias("feature"), "toxic", "other").where("feature IS NOT NULL")
    summed = each.groupBy("feature").agg((F.sum("toxic") + 0.5).alias("a"), (F.sum("other") + 0.5).alias("b"))
    ratio = F.log(F.col("a") / F.lit(total["toxic"] + 1.0)) - F.log(F.col("b") / F.lit(total["other"] + 1.0))
    low = ratio - 2 * F.sqrt(1 / F.col("a") + 1 / F.col("b"))
    kept = summed.select("feature", low.alias("w")).where("w >= 0.5").orderBy(F.desc("w"), "feature")
    return [r["feature"] for r in kept.collect()]


def logistic(rows: list[tuple[bool, list[int]]], n_features: int) -> tuple[float, np.ndarray]:
    """Intercept and non-negative weights of a logistic regression on sets of features: L1 selects, a nearly free refit weighs."""
    y = np.array([toxic for toxic, _ in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return -1.0, np.zeros(n_features)
    row = np.repeat(np.arange(len(y)), [len(f) for _, f in rows])
    col = np.array([k for _, f in rows for k in f], dtype=np.int64)
    start = math.log(y.mean() / (1 - y.mean()))
    b, w = _descend(y, row, col, start, np.zeros(n_features), PENALTY)
    selected = w[col] > 0
    return _descend(y, row[selected], col[selected], b, w, PENALTY / 20)


def _descend(y: np.ndarray, row: np.ndarray, col: np.ndarray, b: float, w: np.ndarray, penalty: float, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Accelerated proximal steps; each weight's step follows from how many rows have its feature."""
    crowd = 1 + np.bincount(row, minlength=len(y)).max()
    step = 4 / (crowd * np.maximum(np.bincount(col, minlength=len(w)), 1))
    ahead_b, ahead_w, t = b, w, 1.0
    for _ in range(rounds):
        z = ahead_b + np.bincount(row, ahead_w[col], len(y))
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new_b = ahead_b - 4 / (crowd * len(y)) * miss.sum()
        new_w = np.maximum(ahead_w - step * (np.bincount(col, miss[row], len(w)) + penalty), 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead_b, ahead_w = new_b + (before - 1) / t * (new_b - b), new_w + (before - 1) / t * (new_w - w)
        b, w = new_b, new_w
    return b, w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[LanguageModel, float, dict[str, float]]:
    """Language model, intercept and feature weights."""
    model = LanguageModel([tuple(r) for r in character_counts(docs).collect()])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen_labels(labels, sample)), "doc_id")
    rows = materialize(rows.select("text", "toxic"), "labelled-sample")
    names = candidates(materialize(labelled_words(rows, model), "labelled-words"))
    number = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        known = _Known(number)
        for batch in batches:
            found = [known.of(words_of(text or "", memo, model)) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "features"])

    seen = rows.mapInArrow(run, "toxic boolean, features array<int>").collect()
    intercept, weight = logistic([(r["toxic"], r["features"]) for r in seen], len(names))
    return model, intercept, {f: float(weight[k]) for f, k in number.items() if weight[k] > 0}


def scorer(spark: SparkSession, model: LanguageModel, intercept: float, weight: dict[str, float]):
    """A function to be called once in a task, which makes one of texts to scores."""
    shared = spark.sparkContext.broadcast((model, list(weight), list(weight.values())))

    def start():
        model, names, values = shared.value
        memo: dict[str, tuple[str, ...]] = {}
        known = _Known({f: k for k, f in enumerate(names)})

        def scores(texts: list[str | None]) -> list[float]:
            logits = (intercept + sum(values[k] for k in known.of(words_of(t or "", memo, model))) for t in texts)
            return [1 / (1 + math.exp(-min(x, 30.0))) for x in logits]

        return scores

    return start


def score(docs: DataFrame, model: LanguageModel, intercept: float, weight: dict[str, float]) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    start = scorer(docs.sparkSession, model, intercept, weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = start()
        for batch in batches:
            out = scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with all their columns, that score below a half."""
    start, text = scorer(docs.sparkSession, *fit(docs, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = start()
        for batch in batches:
            yield batch.filter(pa.array([x < 0.5 for x in scores(batch.column(text).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class _Known(dict):
    """word -> numbers of its known features, remembered for a bounded number of words."""

    def __init__(self, number: dict[str, int]):
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        self[word] = found = tuple(k for f in features(word) if (k := self.number.get(f)) is not None)
        return found

    def of(self, words: set[str]) -> list[int]:
        if len(self) > MEMO:
            self.clear()
        return sorted({k for found in filter(None, map(self.__getitem__, words)) for k in found})


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, *fit(docs, labels))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
