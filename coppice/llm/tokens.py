"""Exact token ids of a byte-level BPE tokenizer, fast for prose.

Between single spaces the pieces of this tokenizer's pattern never cross, so a text
is split at its spaces and each part's ids come from a bounded memo. A text in
which a space stands beside other white space, or at either end, goes to the
encoder whole, and one that holds the string of a special token goes to the
tokenizer of the JSON file itself.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers

SPECIAL = "<|endoftext|>"
MEMO = 200_000
LONGEST = 64


class Encoder:
    """text -> ids as packed little-endian unsigned 32-bit integers."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import tiktoken

        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, bytes] = {}
        self.whole = None

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def special(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.special(text)
        first, *rest = text.split(" ")
        if not rest:
            return self.plain(text)
        if not first or first[-1].isspace():
            return self.plain(text)
        memo, out = self.memo, [self.plain(first)]
        if len(memo) > MEMO:
            memo.clear()
        try:
            out += map(memo.__getitem__, rest)
            return b"".join(out)
        except KeyError:
            del out[1:]
        for part in rest:
            ids = memo.get(part)
            if ids is None:
                if not part or part[0].isspace() or part[-1].isspace():
                    return self.plain(text)
                ids = self.plain(" " + part)
                if len(part) <= LONGEST:
                    memo[part] = ids
            out.append(ids)
        return b"".join(out)
