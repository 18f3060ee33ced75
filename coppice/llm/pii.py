"""Personal data, also in disguise, by offset-preserving deobfuscation.

Transducers run in turn over a text that shows signs of disguise: character references,
homoglyphs and full-width or invisible characters become ASCII or nothing; spelled
digits become digits; bracketed, spoken and spaced at/dot signs become `@` and `.`, and
addresses that are spelled out letter by letter close up. Each rewrites a list of spans
and carries, for every character it writes, the source characters it stands for.
Identifiers are then detected in the normalised text and their spans mapped back to the
source.

The plain patterns also run on the source itself; the spans found there always stay. A
disguised span is added beside them if it overlaps none of its kind or is wider than all
that it overlaps.

Work is linear in the text: addresses, spoken and spelled ones too, are searched from
their sign outward, and the number patterns start only at the first digit of a run.

Defined results: a null text is empty; an empty text has no span; equal rows get
equal results, one row each; further columns are ignored; an empty table gives an
empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.storage import table

KINDS = ("email", "ip", "card", "phone")

# Letters that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "﹒": ".", "＠": "@", "﹫": "@",
}
# The digits' names.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
SPOKEN = {word: str(k) for names in DIGIT_WORDS.values() for k, word in enumerate(names.split())} | {"oh": "0"}
# Spoken signs.
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arroba", "chez"), ("dot", "punkt", "point", "punto"), ("plus", "más")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ODD = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + "­​-‏⁠﻿！-～]")
_word = "|".join(sorted(map(re.escape, SPOKEN), key=len, reverse=True))
_signs, _plus = "|".join((*DOT_WORDS, *PLUS_WORDS)), "|".join(PLUS_WORDS)
DIGIT_RUN = re.compile(rf"(?<!\w)(?:(?:{_plus})[\s,-]{{1,3}})?(?:{_word})(?:[\s,-]{{1,3}}(?:{_word}|{_signs}|[0-9]+))*(?!\w)", re.I)
DIGIT_PART = re.compile(rf"{_word}|{_signs}|[0-9]+", re.I)
_at, _dot = "|".join(AT_WORDS), "|".join(DOT_WORDS)
BRACKETED = re.compile(rf"(?<!\s)\s*+(?:\[\s*(?:(?P<a>@|{_at})|(?P<d>\.|{_dot}))\s*\]|\(\s*(?:(?P<b>@|{_at})|(?P<e>\.|{_dot}))\s*\)|\{{\s*(?:(?P<c>@|{_at})|(?P<f>\.|{_dot}))\s*\}})\s*", re.I)
SPOKEN_DOMAIN = re.compile(rf"\s(?P<at>{_at})\s(?P<domain>(?:[a-z0-9-]+(?:\s(?:{_dot})\s|\.))+[a-z]{{2,}})(?!\w)", re.I)
FIRST_WORD = re.compile(r"[a-z0-9](?:[a-z0-9_%+-]|\.(?=[a-z0-9]))*", re.I)
LATER_WORD = re.compile(r"[a-z0-9_%+-]+", re.I)
DOT_BEFORE = re.compile(rf"\s(?:{_dot})\s\Z", re.I)
# Words before a spoken `at` and a plain domain that are no mailbox.
NO_MAILBOX = frozenset("look looked see visit visited found find us me them it available online is was are be read sold site page shop here there live meet met hosted published".split())
REFERENCE = re.compile(r"&#(?P<n>[0-9]{2,3});|&#x(?P<x>[0-7][0-9a-f]);|&(?P<w>commat|period|lowbar|plus|hyphen);|(?<=\w)%(?P<q>40|2e)(?=\w)", re.I)
# Named character references.
NAMED = {"commat": "@", "period": ".", "lowbar": "_", "plus": "+", "hyphen": "-"}
SPACED_ADDRESS = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\s?@\s?[A-Za-z0-9-]+(?:\s\.\s[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)*?(?:\s\.\s|\.)[A-Za-z]{2,}(?!\w)", re.A)
SPACED_SIGN = re.compile(r"\s?@\s?|\s\.\s")
LETTERED_DOMAIN = re.compile(r"@(?:(?:\s[A-Za-z0-9.-](?!\S))+|\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
SPACE = re.compile(r"\s")
SPOKEN_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:\s(?:{_dot})\s|\s\.\s)[0-9]{{1,3}}){{3}}(?![\w.])", re.I)
IP_SIGN = re.compile(rf"\s(?:{_dot}|\.)\s", re.I)
SPOKEN_DOT = re.compile(rf"\s(?:{_dot})\s", re.I)
SPACED_DOMAIN = re.compile(rf"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\s(?:{_dot})\s[A-Za-z0-9-]+)+", re.I)
BRACKETS = re.compile(rf"[\[({{]\s*(?:@|\.|{_at}|{_dot})\s*[\])}}]", re.I)
SPOKEN_GATE = re.compile(rf"\s(?:{_dot})\s|\s(?:{_at})\s[a-z0-9-]+\.[a-z]|\s@|@\s|[0-9]\s\.\s[0-9]", re.I)


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of each kind; matches that fail their test are dropped."""
    small = lambda part: len(part := part.lstrip("0")) < 3 or len(part) == 3 and part <= "255"
    return {
        "email": list(emails(text)),
        "ip": [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))],
        "card": [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else [],
    }


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, in order and apart; each written character stands for its whole span."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [self.start[at:a], np.full(len(new), self.start[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start = np.concatenate([*start, self.start[at:]])
        self.end = np.concatenate([*end, self.end[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def plain_letter(c: str) -> str:
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    return unicodedata.normalize("NFKC", c) if "！" <= c <= "～" else ""


def spoken_digits(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn runs of at least four digit names into digits; `dot` and `plus` within become signs."""
    edits = []
    for run in DIGIT_RUN.finditer(text):
        parts = list(DIGIT_PART.finditer(text, *run.span()))
        if sum(p[0].lower() in SPOKEN for p in parts) < 4:
            continue
        for k, part in enumerate(parts):
            word = part[0].lower()
            new = SPOKEN.get(word) or ("." if word in DOT_WORDS else "+" if word in PLUS_WORDS else word)
            edits.append((part.start(), parts[k + 1].start() if k + 1 < len(parts) else part.end(), new))
    return edits


def spoken_addresses(text: str) -> Iterator[tuple[int, int, re.Match]]:
    """(start, end of the mailbox, match of sign and domain) of spoken addresses; each is searched from its sign outward, so long chains are walked once."""
    done = 0
    for m in SPOKEN_DOMAIN.finditer(text):
        start, i, later = None, m.start(), True
        while later:
            end = i
            while i > done and (text[i - 1].isalnum() or text[i - 1] in "._%+-"):
                i -= 1
            if i == end:
                break
            if FIRST_WORD.fullmatch(text, i, end):
                start = i
            before = DOT_BEFORE.search(text, max(done, i - 9), i)
            later = before is not None and LATER_WORD.fullmatch(text, i, end) is not None
            i = before.start() if before else i
        if start is not None:
            done = m.end()
            yield start, m.start(), m


def lettered_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses spelled letter by letter, searched from the sign to the left and matched to the right."""
    done, at = 0, text.find("@")
    while at >= 0:
        i = at
        while i - 2 >= done and text[i - 1].isspace() and text[i - 2] in LOCAL:
            i -= 2
        if i > done and not text[i - 1].isspace():  # the first letter belongs to a word
            i += 2
        if at - i >= 4 and (m := LETTERED_DOMAIN.match(text, at)):
            done = m.end()
            yield i, done
        at = text.find("@", max(done, at + 1))


def signs(mapped: Mapped) -> None:
    """At and dot signs in brackets, spoken or spaced, and addresses spelled letter by letter."""
    mapped.rewrite([(m.start(), m.end(), "@" if m["a"] or m["b"] or m["c"] else ".") for m in BRACKETED.finditer(mapped.text) if m.start() and m.end() < len(mapped.text)])
    if SPOKEN_GATE.search(mapped.text):
        edits = []
        for start, end, m in spoken_addresses(mapped.text):
            if mapped.text[start:end].lower() in NO_MAILBOX and not SPOKEN_DOT.search(m["domain"]):
                continue
            dots = [(d.start(), d.end(), ".") for d in SPOKEN_DOT.finditer(mapped.text, start, m.end())]
            edits += sorted([*dots, (m.start("at") - 1, m.end("at") + 1, "@")])
        mapped.rewrite(edits)
        mapped.rewrite([(d.start(), d.end(), "") for span in lettered_addresses(mapped.text) for d in SPACE.finditer(mapped.text, *span)])
        within = lambda whole, part, new: [(d.start(), d.end(), new(d[0])) for m in whole.finditer(mapped.text) for d in part.finditer(mapped.text, *m.span())]
        mapped.rewrite(within(SPACED_ADDRESS, SPACED_SIGN, str.strip))
        mapped.rewrite(within(SPACED_DOMAIN, SPOKEN_DOT, lambda _: "."))
        mapped.rewrite(within(SPOKEN_IP, IP_SIGN, lambda _: "."))


def referenced(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn character references of printable ASCII signs into them."""
    found = ((m, NAMED[m["w"].lower()] if m["w"] else chr(int(m["n"])) if m["n"] else chr(int(m["x"] or m["q"], 16))) for m in REFERENCE.finditer(text))
    return [(m.start(), m.end(), c) for m, c in found if "!" <= c <= "~"]


def disguised(text: str) -> bool:
    return bool(
        not text.isascii() and ODD.search(text)
        or BRACKETS.search(text)
        or SPOKEN_GATE.search(text)
        or ("&" in text or "%" in text) and REFERENCE.search(text)
        or spoken_digits(text)
    )


def normalised(text: str) -> Mapped:
    mapped = Mapped(text)
    mapped.rewrite(referenced(text))
    mapped.rewrite([(m.start(), m.end(), plain_letter(m[0])) for m in ODD.finditer(mapped.text)])
    mapped.rewrite(spoken_digits(mapped.text))
    signs(mapped)
    return mapped


def _wider(a: int, b: int, overlapped: list[tuple[int, int]]) -> bool:
    return not overlapped or (a <= overlapped[0][0] and overlapped[-1][1] <= b and overlapped != [(a, b)])


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(spans of the plain patterns, all spans) by kind."""
    base = detect(text)
    if not disguised(text):
        return base, base
    mapped, every = normalised(text), {}
    for kind, spans in detect(mapped.text).items():
        plain, begins, ends = base[kind], [a for a, _ in base[kind]], [b for _, b in base[kind]]
        added = {(a, b) for a, b in (mapped.source(*s) for s in spans) if _wider(a, b, plain[bisect_right(ends, a) : bisect_left(begins, b)])}
        every[kind] = sorted([*plain, *added])
    return base, every


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def scan(docs: DataFrame) -> DataFrame:
    """Per document: plain counts, their digest and all spans, with the number that deobfuscation added."""

    def measure(text: str | None) -> tuple:
        base, every = find(text or "")
        added = sum(map(len, every.values())) - sum(map(len, base.values()))
        return (*(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        for batch in batches:
            found = list(zip(*map(measure, batch.column(1).to_pylist()), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], names=["doc_id", *names]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(
        run,
        f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "base_sha256 string, spans string, n_disguised bigint",
    )


def op8_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
