"""The operators against brute force, on rows with nulls, empties, repeats, ties, long texts and clashing columns."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from coppice.llm import avi, decontamination, line_dedup, packing, pii, sharding, simhash, suffix_dedup, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, n int, key string"
rng = random.Random(7)
WORDS = ["".join(rng.choice("abdeilmnorstuv") for _ in range(rng.randint(2, 8))) for _ in range(120)] + ["été", "Straße", "Ünder"]


def prose(words):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", " ", ".\n", ", "]) for _ in range(words))


def sample():
    base = [prose(rng.choice([3, 20, 90, 200])) for _ in range(24)]
    texts = [None, "", " \n ", "one", "two words", *base, *base[:6], prose(4000)]
    for x in base[:8]:  # near copies and shared passages
        cut = len(x) // 2
        texts += [x[:cut] + "zq " + x[cut:], base[-1][:700] + x]
    rows = [(k, x, "en", "s", len(x or ""), "clash", 1, "k") for k, x in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, "lost id", "en", "s", 7, None, None, None), (5, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(values):
    return Counter(map(tuple, values))


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        least[top(i)].append(d)
    return [min((d for d in least[top(i)] if d is not None), default=None) for i in range(len(prints))]


def test_simhash(docs, rows, empty):
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    expected = counted((d, f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints), strict=True))
    assert counted(simhash.near_duplicates(docs).collect()) == expected
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = len({c for c in brute_components(prints)} - {None}) + sum(c is None for c in brute_components(prints))
    assert kept.count() == groups


def test_simhash_index_splits_heavy_nodes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 20)
    center = rng.getrandbits(64)
    codes = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)}
    codes |= {rng.getrandbits(64) for _ in range(50)}
    codes = sorted(codes)
    frame = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.components(frame).collect()}
    want = brute_components([(k, c) for k, c in enumerate(codes)])
    pairs = {(got[simhash.signed(c)], w) for c, w in zip(codes, want, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_lower_index_nodes_find_all_links():
    codes = np.array(sorted({rng.getrandbits(12) for _ in range(1500)}), dtype=np.uint64)
    left, right = simhash.links(codes)
    want = {(i, j) for i in range(len(codes)) for j in range(i) if int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert {(max(p), min(p)) for p in zip(left.tolist(), right.tolist(), strict=True)} == want


def brute_chunks(text):
    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, held = [], []
    for i, line in enumerate(lines):
        held.append(line)
        if sum(hashes[i - b] * 31**b for b in range(3) if i >= b) % 4 == 0 or i == len(lines) - 1:
            out.append("\n".join(held))
            held = []
    return out


def test_line_dedup(docs, rows, empty):
    first, n = {}, Counter()
    order = lambda d, k: (d is not None, d or 0, k)
    cut = [(r[0], k, c) for r in rows if r[1] is not None for k, c in enumerate(brute_chunks(r[1])) if sum(bool(x.strip(" ")) for x in c.split("\n")) > 1]
    for d, k, c in cut:
        n[c] += 1
        first[c] = min(first.get(c, order(d, k)), order(d, k))
    gone = {(d, k, c) for d, k, c in cut if order(d, k) != first[c]}
    want = [(r[0], None if r[1] is None else "\n".join(c for k, c in enumerate(brute_chunks(r[1])) if (r[0], k, c) not in gone)) for r in rows]
    got = line_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert counted((r["doc_id"], r["text"]) for r in got.collect()) == counted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect() if r["text"] is not None and r["doc_id"] is not None)
    assert len(gone) > 3 and line_dedup.deduplicated(empty).collect() == []


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed(docs, window=256).collect()
    place = defaultdict(list)
    for r in got:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in place.values():
        assert [a for a, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 256
    want = []
    for d, text, *_ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(packing.cut(len(ids), 256)):
            want.append((d, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())))
    assert counted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == counted(want)
    assert len(place) <= 1.05 * sum(w[3] for w in want) / 256 + 1
    assert packing.packed(empty).collect() == []


def test_packing_over_several_rounds(docs, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 10)
    got = packing.packed(docs, window=256).collect()
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 256 and len(got) == packing.pieces(docs, 256).count()


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "it's 'tis", "x\n\ny z", "<|endoftext|> a b", "Ünder die  \t x", "a  b c", "", "ab 12cd!? e"])
def test_token_ids_equal_the_tokenizers(text):
    from tokenizers import Tokenizer

    encode, whole = tokens.Encoder(), Tokenizer.from_file(tokens.public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_suffix_dedup(spark, docs, rows, empty):
    texts = [(r[1] or "").encode() for r in rows]
    starts = Counter(x[i : i + 400] for x in texts for i in range(len(x) - 399))
    want = []
    for r, x in zip(rows, texts, strict=True):
        hit = bytearray(len(x))
        for i in range(len(x) - 399):
            if starts[x[i : i + 400]] > 1:
                hit[i : i + 400] = b"\1" * 400
        runs = sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1]))
        want.append((r[0], len(x), bytes(b for b, h in zip(x, hit, strict=True) if not h), sum(hit), runs))
    got = suffix_dedup.removed(docs).collect()
    assert counted((r["doc_id"], r["n_bytes"], bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in got) == counted(want)
    assert sum(w[3] for w in want) > 1000 and suffix_dedup.removed(empty).collect() == []


def test_warc(spark):
    html = ["<p>" + prose(60), "short", None, "", "<p>é" + prose(40) + "\r\n\r\nWARC/1.1\r\n"]
    rows = [(k, "http://x/\n" if k % 2 else None, html[k % 5], "extra") for k in range(23)] + [(3, None, html[0], "extra")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    first = {}
    for k, _, x, _ in rows:
        first[x or ""] = min(first.get(x or "", k), k)
    want = []
    for k, _, x, _ in rows:
        data = (x or "").encode()
        again = len(data) >= 100 and first[x or ""] != k
        want.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[x or ""] if again else None))
    assert counted(warc.round_trip(pages).collect()) == counted(want)
    assert warc.round_trip(spark.createDataFrame([], pages.schema)).collect() == []


def test_warc_streams_of_one_or_many_members():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"

    class Slow:
        def __init__(self, data):
            self.data = data

        def read(self, _):
            out, self.data = self.data[:7], self.data[7:]
            return out

    for data in (gzip.compress(record * 3), gzip.compress(record) * 3):
        assert [r for _, r in warc.records(warc.inflated(Slow(data)))] == [record] * 3
    with pytest.raises(ValueError):
        list(warc.records(iter([record[:-6]])))


def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for win in ([w] if 0 < len(w) < 10 else [w[i : i + 10] for i in range(len(w) - 9)]):
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    names = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("rows_broadcast", [20_000, 0])
def test_decontamination(spark, docs, rows, empty, monkeypatch, rows_broadcast):
    monkeypatch.setattr(decontamination, "bounded", lambda df, n=0: df.count() <= rows_broadcast)
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 60]
    items = [(1, long[0][20:300]), (2, long[1].upper()[:200]), (3, "zq été"), (10, long[0][20:300]), (4, None), (5, "never-seen words"), (6, "two WORDS")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, bench).drop("text_hash").collect()
    assert counted(got) == counted((r[0], *brute_hits(r[1], items)) for r in rows)
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not brute_hits(r[1], items)[4] for r in rows)
    assert decontamination.contamination(empty, bench).collect() == []
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect())


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_plain(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    keep = {
        "email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda x: 13 <= len(digits(x)) <= 19 and pii.luhn(digits(x)), "phone": lambda x: 9 <= len(digits(x)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if keep[k](m[0])] for k, p in PLAIN.items()}


def test_plain_patterns_by_random_texts():
    for _ in range(3000):
        text = "".join(rng.choice("ab1234567890.@+- ()%_") for _ in range(rng.randint(0, 60)))
        assert pii.detect(text) == brute_plain(text), text


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john.doe [at] example [dot] com now", "john.doe [at] example [dot] com"),
        ("ask anna at mail dot example dot org please", "anna at mail dot example dot org"),
        ("call plus four nine one two three four five six seven eight nine", "plus four nine one two three four five six seven eight nine"),
        ("write jоhn@exаmple.com", "jоhn@exаmple.com"),
        ("card four one one one one one one one one one one one one one one one ok", "four one one one one one one one one one one one one one one one"),
        ("meet me at the dot", None),
        ("one two buckle my shoe", None),
    ],
)
def test_disguises(text, found):
    base, every = pii.find(text)
    assert [text[a:b] for spans in every.values() for a, b in spans] == ([found] if found else [])
    assert all(set(base[k]) <= set(every[k]) for k in base)


def test_pii_frame(docs, rows, empty):
    got = pii.scan(docs).collect()
    assert len(got) == len(rows) and pii.scan(empty).collect() == []
    long = " " * 50_000 + "[" + "9" * 30_000 + "a" * 30_000 + "@" + "dot " * 5_000
    assert pii.find(long)[0] == brute_plain("[" + "9" * 20) | {"email": []}


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs).collect()
    size = lambda r: len((r[1] or "").encode()) + 1
    assert counted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == counted((r[0], size(r), zlib.crc32((r[1] or "").encode())) for r in rows)
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and {r["law"] for r in got} == {"bytes"}
    assert sharding.shard(empty).collect() == []


def test_rebalancing_evens_out_and_moves_little():
    weight = [rng.randint(1, 1000) for _ in range(4096)]
    first = sharding.equal_map(16)
    second = sharding.rebalanced(first, weight, 16)
    load = Counter()
    for slot, s in enumerate(second):
        load[s] += weight[slot]
    assert max(load.values()) - min(load.values()) <= 0.001 * sum(weight) / 16
    assert sum(a != b for a, b in zip(first, second, strict=True)) < 600


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 64, b"hello " * 2000, bytes(range(256)) * 40, b"\xff" * 5000])
def test_avi_round_trip(data):
    payload = avi.payload_of(data)
    frame_us, frames = avi.read_avi(avi.write_avi(avi.frames_of(payload)))
    back = np.concatenate([avi.decode_frame(f) for f in frames]).ravel()
    assert frame_us == avi.FRAME_US and back.tobytes() == payload.tobytes() and len(payload) % 64 == 0 and len(payload)
    slow = [avi.decode_scan(f) for f in frames[:1] + frames[-1:]]
    assert [(x[x[:, 0] != 0] - 256).tolist() for x in slow] == [avi.decode_frame(f).tolist() for f in frames[:1] + frames[-1:]]


def test_avi_frame(docs, rows, empty):
    media = avi.encode(docs)
    got = avi.decode(media).collect()
    want = []
    for r in rows:
        data = (r[1] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        want.append((r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert counted(r[:5] for r in got) == counted(want)
    assert all(r["clips"][0]["first_frame"] == 0 for r in got) and avi.clips(media).count() >= len(rows) and avi.decode(avi.encode(empty)).collect() == []


def test_shots_begin_where_the_histogram_jumps():
    still = np.zeros((12, avi.BINS))
    still[:6, 1], still[6:, 20] = 1, 1
    assert avi.shots(still) == [(0, 5), (6, 11)] and avi.shots(still[:1]) == [(0, 0)]


@pytest.fixture(scope="module")
def judged(spark):
    rows, labels = [], []
    for k in range(500):
        toxic = k % 8 == 0
        words = [rng.choice(WORDS) for _ in range(rng.randint(10, 80))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grumbold", "snarfel"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (900, ""), (7, rows[7][1])], "doc_id long, text string")
    return docs, spark.createDataFrame([*labels, (3, None), (901, 1)], "doc_id long, toxic int")


def test_toxicity(judged):
    docs, labels = judged
    fitted = toxicity.fit(docs, labels)
    got = toxicity.score(docs, *fitted).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got) and len(got) == 503
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    wrong = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 500 and r["predicted"] != (r["doc_id"] % 8 == 0)]
    assert len(wrong) <= 5
    kept = toxicity.not_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got)
    model, _, weight = fitted
    known = toxicity._Known({f: k for k, f in enumerate(weight)})
    for text in ("a gr0mb0ld".replace("gr0", "gru"), "g r u m b o l d", "grummmmbold", "snarf3l", "s.n.a.r.f.e.l"):
        assert known.of(toxicity.words_of(text, {}, model)), text


def test_toxicity_without_labels(judged):
    docs, labels = judged
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert not any(r["predicted"] for r in toxicity.toxicity(docs, some).collect())
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
