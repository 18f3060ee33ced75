"""Token counts by a tokenizer that is compiled to a finite-state transducer.

The vocabulary file (BPE with word ends) becomes two machines. The first turns a text
into a stream of bytes in which every piece of the pattern ends with `END`, a byte that
UTF-8 never has; what it needs to know of a character is asked of the tokenizer's own
parts once. The second is a deterministic transducer over that stream. A transition
carries the number of tokens by which the encoding of what was read of the piece grows
(it can shrink). Its states are the sets of tokens that may be under way: (place in the
trie of the vocabulary, the last whole token before it, tokens since then). In a state
exactly one token can end with the byte read, namely the one whose merges no merge over
its left border comes before. States are compiled when first met.

A stream is cut into chunks of `LANE` bytes which walk the transducer in step, as the
columns of one matrix. A chunk's map from the state at its start to that at its end is
constant behind its first `END`, so it is walked from a state that waits for it; the
states at the starts then follow from a prefix scan over the maps, and only what stands
before a first `END` is walked again. Texts of more than `PART` bytes are cut into parts
that are dealt to all tasks; a part's map is (open head, tokens, open tail), and a scan
per text composes them.

Defined results: a null or empty text has no tokens; the string of a special token is
one token; a very long word is counted like any other; equal rows are counted as rows of
their own; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.storage import table

LIMIT = 2048
END = 0xFF
#: Bytes that a lane of a walk has; of a stream that is walked at once; of a text that is not cut.
LANE, BLOCK, PART = 128, 1 << 20, 1 << 16
#: Lanes that are walked one by one rather than in step.
FEW = 8
#: Cells of the table of transitions (4 bytes each); beyond them compilation starts anew.
CELLS = 1 << 25
WAIT, START = 0, 1
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
QUOTE = ord("'")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Vocabulary:
    """Merges of a BPE file with word ends, as a trie over symbols: a byte, or 256 + the byte that ends a word."""

    def __init__(self, path: str):
        with open(path) as file:
            self.content = json.load(file)
        model = self.content["model"]
        self.suffix = model["end_of_word_suffix"]
        self.symbol = {c: b for b, c in enumerate(byte_letters())} | {c + self.suffix: 256 + b for b, c in enumerate(byte_letters())}
        self.names: list[str] = list(self.symbol)
        self.rank = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.made_of: dict[str, tuple[int, str, str]] = {}
        for (a, b), k in self.rank.items():
            name = a + b
            if name in self.made_of or any(x in self.made_of and self.made_of[x][0] >= k for x in (a, b)):
                raise ValueError("a token has two merges, or one that comes after its own use")
            self.made_of[name] = (k, a, b)
            self.names.append(name)
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for number, name in enumerate(self.names):
            node = 0
            for symbol in self.symbols(name):
                if symbol not in self.child[node]:
                    self.child[node][symbol] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][symbol]
            self.token[node] = number
        self._fits: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[str, bool], list[tuple[str, float]]] = {}

    def symbols(self, name: str) -> list[int]:
        letters = list(name.removesuffix(self.suffix))
        if name.endswith(self.suffix):
            letters[-1] += self.suffix
        return [self.symbol[c] for c in letters]

    def merged(self, parts: list[str]) -> list[str]:
        """The encoding of single symbols by the rule itself: the best merge first, from the left."""
        while len(parts) > 1:
            best = min(((self.rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def edge(self, name: str, right: bool) -> list[tuple[str, float]]:
        """What stands at one end of a token while it is merged together: (part, rank of the merge that takes it up)."""
        found = self._edges.get((name, right))
        if found is None:
            found, at = [(name, float("inf"))], name
            while at in self.made_of:
                rank, a, b = self.made_of[at]
                at = b if right else a
                found.append((at, rank))
            self._edges[name, right] = found
        return found

    def fits(self, last: int, token: int) -> bool:
        """Whether a token can follow another one (-1: begin a piece), so that no merge over their border comes first."""
        found = self._fits.get((last, token))
        if found is None:
            name = self.names[token]
            if last < 0:
                letters = [self.names[s] for s in self.symbols(name)]
                found = self.merged(letters) == [name]
            else:
                found = self.fits(-1, token) and not any(
                    (rank := self.rank.get((p, q))) is not None and rank < taken and rank <= taken_too
                    for p, taken in self.edge(self.names[last], True)
                    for q, taken_too in self.edge(name, False)
                )
            self._fits[last, token] = found
        return found


class Full(Exception):
    """More states than are kept."""


class Transducer:
    """The states and transitions met so far: `next << 8 | tokens + 128` by state and column of the byte, -1 where not compiled."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.state: list[tuple] = []
        self.number: dict[tuple, int] = {}
        #: Bytes have a column once they occur; END has the first one.
        self.bytes, self.column, self.width = [END], np.full(256, -1, dtype=np.int16), 64
        self.column[END] = 0
        self.moves = np.full((1 << 12, self.width), -1, dtype=np.int32)
        self.add("waits", 0)
        self.moves[WAIT] = (WAIT << 8) | 128
        self.moves[WAIT, 0] = (START << 8) | 128
        self.add(((0, -1, 0),), 0)

    def columns(self, stream: np.ndarray) -> np.ndarray:
        """The columns of a stream's bytes; the table grows by those of new bytes."""
        found = self.column[stream]
        if (found < 0).any():
            for byte in np.unique(stream[found < 0]).tolist():
                self.column[byte] = len(self.bytes)
                self.bytes.append(byte)
            while self.width < len(self.bytes):
                self.moves = np.concatenate([self.moves, np.full_like(self.moves, -1)], axis=1)
                self.moves[WAIT, self.width :] = (WAIT << 8) | 128
                self.width *= 2
            found = self.column[stream]
        return found.astype(np.uint8)

    def add(self, items: tuple | str, closing: int) -> int:
        """The number of a state; closing: tokens that the piece grows by if it ends here."""
        number = self.number.get((items, closing))
        if number is None:
            number = self.number[items, closing] = len(self.state)
            self.state.append(items)
            if len(self.moves) == number:
                self.moves = np.concatenate([self.moves, np.full_like(self.moves, -1)])
            self.moves[number, 0] = (START << 8) | (closing + 128)
        return number

    def crowded(self, share: float = 1.0) -> bool:
        return len(self.state) * self.width >= CELLS * share

    def ends(self, items: tuple, symbol: int) -> tuple[int, int]:
        """The one token that ends with a symbol, and the tokens up to it."""
        v = self.vocabulary
        for node, last, tokens in items:
            at = v.child[node].get(symbol)
            if at is not None and v.token[at] >= 0 and v.fits(last, v.token[at]):
                return v.token[at], tokens + 1
        raise ValueError(f"no token ends with symbol {symbol}")

    def compile(self, state: int, column: int, bounded: bool) -> None:
        if bounded and self.crowded():
            raise Full
        v, items, byte = self.vocabulary, self.state[state], self.bytes[column]
        token, grown = self.ends(items, byte)
        closing = self.ends(items, 256 + byte)[1] - grown
        on = ((v.child[node].get(byte), last, tokens - grown) for node, last, tokens in items)
        following = (*(x for x in on if x[0] is not None and v.child[x[0]]), (0, token, 0))
        to = self.add(following, closing)
        self.moves[state, column] = (to << 8) | (grown + 128)

    def step(self, states: np.ndarray, columns: np.ndarray, bounded: bool) -> np.ndarray:
        at = states * self.width + columns
        moves = self.moves.ravel()[at]
        if (moves < 0).any():
            for key in np.unique(at[moves < 0]).tolist():
                self.compile(*divmod(key, self.width), bounded)
            moves = self.moves.ravel()[at]
        return moves

    def walk(self, state: int, columns: list[int], out: np.ndarray, bounded: bool) -> int:
        """One lane's way to its first END: its last state; the tokens of its bytes go to out."""
        for k, column in enumerate(columns):
            move = self.moves.item(state, column)
            if move < 0:
                self.compile(state, column, bounded)
                move = self.moves.item(state, column)
            state, out[k] = move >> 8, (move & 255) - 128
            if not column:
                break
        return state

    def emitted(self, stream: np.ndarray, bounded: bool = True) -> np.ndarray:
        """Tokens that every byte of a stream adds. The stream begins and ends between pieces."""
        lanes = -(-len(stream) // LANE)
        padded = np.zeros(lanes * LANE, dtype=np.uint8)
        padded[: len(stream)] = self.columns(stream)
        rows = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
        out = np.empty(rows.shape, dtype=np.int8)
        # Maps: what a lane does behind its first END, and the state in which it ends.
        exits = np.full(lanes, WAIT, dtype=np.int32)
        for k in range(LANE):
            moves = self.step(exits, rows[k], bounded)
            exits, out[k] = moves >> 8, (moves & 255) - 128
        # Scan: the last lane with an END behind which the state is known, and how many lanes follow it.
        known = np.maximum.accumulate(np.where(exits != WAIT, np.arange(lanes), -1))
        behind = np.arange(lanes) - np.concatenate([[-1], known[:-1]]) - 1
        for depth in range(int(behind.max(initial=0)) + 1):
            lane = np.flatnonzero(behind == depth)
            states = np.where(lane > 0, exits[lane - 1], START).astype(np.int32)
            if len(lane) <= FEW:
                for one, state in zip(lane.tolist(), states.tolist(), strict=True):
                    state = self.walk(state, rows[:, one].tolist(), out[:, one], bounded)
                    if rows[:, one].all():
                        exits[one] = state
                continue
            for k in range(LANE):
                moves = self.step(states, rows[k, lane], bounded)
                out[k, lane] = (moves & 255) - 128
                states = moves >> 8
                if (rest := rows[k, lane] > 0).all():
                    continue
                lane, states = lane[rest], states[rest]
                if not len(lane):
                    break
            exits[lane] = states
        return np.ascontiguousarray(out.T).ravel()[: len(stream)]

    def counted(self, streams: list[np.ndarray]) -> list[int]:
        """Tokens of every stream; compilation starts anew, and goes stream by stream, where the states are too many."""
        try:
            if self.crowded():
                self.reset()
            return _sums(self.emitted(np.concatenate([*streams, _NOTHING])), streams)
        except Full:
            out = []
            for stream in streams:
                if self.crowded(0.5):
                    self.reset()
                out += _sums(self.emitted(stream, bounded=False), [stream])
            return out


_NOTHING = np.zeros(0, dtype=np.uint8)


def _sums(emitted: np.ndarray, streams: list[np.ndarray]) -> list[int]:
    ends = np.cumsum([len(s) for s in streams])
    total = np.concatenate([[0], np.cumsum(emitted, dtype=np.int64)])
    return (total[ends] - total[ends - [len(s) for s in streams]]).tolist()


class Pieces:
    """Texts to streams: normalised bytes without white space, END behind every piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added)))
        self.hint = added[0][:2] if added else None
        self.kind = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        #: Characters that Python's tables don't know, the library's perhaps do.
        self.foreign = np.zeros(0x110000, dtype=bool)
        self.learn(np.arange(128))

    def learn(self, points: np.ndarray) -> None:
        """Ask the tokenizer's own parts for the kind of characters."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for point in points.tolist():
            char = chr(point)
            self.foreign[point] = unicodedata.category(char) == "Cn"
            if not self.tokenizer.normalizer.normalize_str(char).strip(" ") or not split(char):
                self.kind[point] = SPACE
            elif len(split("a" + char)) == 1:
                self.kind[point] = LETTER
            else:
                self.kind[point] = OTHER if len(split(char + char)) == 1 else NUMBER

    def parts(self, text: str) -> tuple[list[str], int]:
        """Normalised stretches between special tokens, and the number of these."""
        if self.hint is None or self.hint not in text:
            return [self.normal(text)], 0
        found = self.special.split(text)
        return [self.normal(x) for x in found], len(found) - 1

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        self.known(points)
        if self.foreign[points].any():
            return self.tokenizer.normalizer.normalize_str(text)
        # Without the sigma's form at a word's end, which lower() alone takes care of.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def known(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if (kinds == UNKNOWN).any():
            self.learn(np.unique(points[kinds == UNKNOWN]))
            kinds = self.kind[points]
        return kinds

    def stream(self, text: str) -> np.ndarray:
        """The stream of a normalised stretch."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            return _NOTHING
        kinds = self.known(points)
        after = np.full(len(points) + 2, SPACE, dtype=np.uint8)
        after[: len(points)] = kinds
        begins = (kinds == NUMBER) | ((kinds != np.concatenate([[SPACE], kinds[:-1]])) & (kinds != SPACE))
        # A quote that begins a piece takes these letters with it, and the piece ends behind them.
        quotes = np.flatnonzero(begins & (points == QUOTE))
        if len(quotes):
            following = np.concatenate([points, [0, 0]])
            one, two = following[quotes + 1], following[quotes + 2]
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for at, length in ((quotes[single], 2), (quotes[double], 3)):
                begins[at + 1] = False
                behind = at + length
                behind = behind[after[behind] != SPACE]
                begins[behind] = True
        kept = kinds != SPACE
        # A piece ends where the next character begins one or is dropped.
        ends = kept & np.concatenate([begins[1:] | ~kept[1:], [True]])
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        if len(data) != len(points):
            lead = (data & 0xC0) != 0x80
            char = np.cumsum(lead) - 1
            last = np.concatenate([lead[1:], [True]])
            kept, ends = kept[char], ends[char] & last
        place = np.cumsum(kept.astype(np.int64) + ends) - 1
        out = np.full(int(place[-1]) + 1, END, dtype=np.uint8)
        out[(place - ends)[kept]] = data[kept]
        return out

    def streams(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """The streams of texts, and their special tokens; all stretches are worked on as one text."""
        stretches, of, specials = [], [], []
        for k, text in enumerate(texts):
            found, n = self.parts(text)
            stretches += found
            of += [k] * len(found)
            specials.append(n)
        out = [[] for _ in texts]
        for k, stretch in zip(of, stretches, strict=True):
            out[k].append(self.stream(stretch))
        return [np.concatenate([*s, _NOTHING]) for s in out], specials


@cache
def counter(path: str | None) -> Counter:
    """The machines of a file, once in a worker: what one task has compiled serves the next."""
    return Counter(path)


class Counter:
    """Both machines of a vocabulary file."""

    def __init__(self, path: str | None = None):
        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.transducer, self.pieces = Transducer(Vocabulary(path)), Pieces(path)

    def counts(self, texts: list[str]) -> list[int]:
        out, waiting, size = [], [], 0
        streams, specials = self.pieces.streams(texts)
        for stream in streams:
            if waiting and size + len(stream) > BLOCK:
                out += self.transducer.counted(waiting)
                waiting, size = [], 0
            waiting.append(stream)
            size += len(stream)
        if waiting:
            out += self.transducer.counted(waiting)
        return [n + s for n, s in zip(out, specials, strict=True)]

    def mapped(self, parts: list[bytes]) -> list[tuple[bytes, int, bytes | None]]:
        """The maps of parts of streams: what stands before the first END, the tokens of the whole pieces behind it, and what stands behind the last END (None: there is no END)."""
        found, closed = [], []
        for part in parts:
            first, last = part.find(END), part.rfind(END)
            found.append((part, None) if first < 0 else (part[:first], part[last + 1 :]))
            closed.append(np.frombuffer(part, dtype=np.uint8)[first + 1 : last + 1] if first >= 0 else _NOTHING)
        return [(head, n, tail) for (head, tail), n in zip(found, self.transducer.counted(closed), strict=True)]

    def composed(self, maps: list[tuple[bytes, int, bytes | None]]) -> int:
        """The tokens of a text whose parts have these maps, in their order."""
        total, open_, pieces = 0, [], []
        for head, n, tail in maps:
            open_.append(head)
            if tail is not None:
                pieces += [b"".join(open_), b"\xff"]
                open_, total = [tail], total + n
        return total + self.transducer.counted([np.frombuffer(b"".join([*pieces, *open_, b"\xff"]), dtype=np.uint8)])[0]


def _short(tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = counter(tokenizer)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                counts = machines.counts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(tokenizer: str | None, size: int):
    """(doc_id, n_bytes, row, text) -> the stream's parts, numbered; specials go with the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(tokenizer).pieces
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                (stream,), (specials,) = pieces.streams(row.column(3).to_pylist())
                data = stream.tobytes()
                parts = [data[a : a + size] for a in range(0, max(1, len(data)), size)]
                same = pa.array([0] * len(parts))
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c).take(same) for c in range(3)), pa.array(range(len(parts)), pa.int32()), pa.array([specials] + [0] * (len(parts) - 1), pa.int64()), pa.array(parts, pa.binary())],
                    names=["doc_id", "n_bytes", "row", "part", "specials", "stream"],
                )

    return run


def _mapped(tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = counter(tokenizer)
        for batch in batches:
            for begin in range(0, batch.num_rows, 16):
                part = batch.slice(begin, 16)
                head, n, tail = zip(*machines.mapped(part.column(5).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in range(5)), pa.array(head, pa.binary()), pa.array(n, pa.int64()), pa.array(tail, pa.binary())],
                    names=["doc_id", "n_bytes", "row", "part", "specials", "head", "tokens", "tail"],
                )

    return run


def _composed(tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = counter(tokenizer)
        for batch in batches:
            counts = [machines.composed([(m["head"], m["tokens"], m["tail"]) for m in maps]) for maps in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    short = rows.where(F.col("n_bytes") <= part).mapInArrow(_short(tokenizer), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    named = rows.where(F.col("n_bytes") > part).select("doc_id", "n_bytes", F.monotonically_increasing_id().alias("row"), "text")
    columns = f"doc_id {kind}, n_bytes bigint, row bigint, part int, specials bigint"
    parts = named.mapInArrow(_cut(tokenizer, part), columns + ", stream binary").repartition("row", "part")
    maps = parts.mapInArrow(_mapped(tokenizer), columns + ", head binary, tokens bigint, tail binary")
    # A text's maps are few and small: an open head, a number, an open tail for each PART bytes.
    ordered = F.array_sort(F.collect_list(F.struct("part", "head", "tokens", "tail")))
    texts = maps.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("specials").alias("specials"), ordered.alias("maps"))
    joined = texts.select("doc_id", F.struct("n_bytes", "specials").alias("size"), "maps").mapInArrow(
        _composed(tokenizer), f"doc_id {kind}, n_bytes struct<n_bytes:bigint,specials:bigint>, n_tokens bigint"
    )
    long = joined.select("doc_id", "n_bytes.n_bytes", (F.col("n_tokens") + F.col("n_bytes.specials")).alias("n_tokens"))
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
