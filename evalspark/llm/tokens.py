"""Byte-level BPE over batches: vectorised pre-tokens, and each distinct pre-token encoded once.

The pre-token pattern of the public vocabulary (fixed value)::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

splits a text into runs of one character class; one blank goes with the run behind it, the last
white space before a run stays alone, and a lone apostrophe takes a contraction's letters. Boundaries
therefore follow from the classes of neighbouring characters, which numpy finds for a whole batch.
Texts with code points that Unicode has assigned no category here go through the library instead.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable

import numpy as np
import regex

from evalspark.llm.words import ranges, spans_hash

LETTER, NUMBER, OTHER, SPACE, END, UNKNOWN = range(6)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
CACHE, CACHE_CHARS = 200_000, 4_000_000  # distinct pre-tokens a worker keeps, and their characters; beyond that it starts anew
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_table: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _table:
        found = np.full(0x110000, OTHER, dtype=np.uint8)
        for low in range(0, 0x110000, 0x4000):  # in pieces, to build it in little memory
            codes = [c for c in range(low, low + 0x4000) if not 0xD800 <= c < 0xE000]
            text = "".join(map(chr, codes))
            at = np.array(codes, dtype=np.int64)
            for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
                for m in regex.finditer(pattern, text):
                    found[at[m.start() : m.end()]] = kind
            found[[c for c, sign in zip(codes, text, strict=True) if unicodedata.category(sign) == "Cn"]] = UNKNOWN
        _table.append(found)
    return _table[0]


def pre_tokens(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """First code points of all pre-tokens. Texts are parted by single END marks, one also at the end;
    the marks are pre-tokens of their own."""
    n = len(codes)
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == END
    space = kind == SPACE
    # the last white space before a run: a blank joins the run, anything else stands alone
    last = np.flatnonzero(space[:-1] & ~space[1:] & (kind[1:] != END))
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    # a pre-token that is a lone apostrophe, before a contraction's letters
    lone = np.flatnonzero(codes == 39)
    lone = lone[start[lone] & (kind[lone + 1] == LETTER)]
    if len(lone):
        one, two = codes[lone + 1], codes[np.minimum(lone + 2, n - 1)]
        length = np.zeros(len(lone), dtype=np.int64)
        for c in CONTRACTIONS:
            hit = one == ord(c[0])
            if len(c) == 2:
                hit &= two == ord(c[1])
            length[hit & (length == 0)] = len(c)
        at, length = lone[length > 0], length[length > 0]
        start[at + 1] = False
        after = at + 1 + length
        start[after] |= kind[after] == LETTER
    return np.flatnonzero(start)


def _newline_parted(many: Callable[[list[str]], list[list[int]]], most: int = 200) -> Callable:
    """Encodes many pre-tokens per library call.

    Behind anything, and before a run with or without its blank, one line break is a pre-token of its own
    and an id of its own, so pre-tokens joined by it are encoded as alone. White space pre-tokens go singly.
    """
    (mark,) = many(["\n"])[0]

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        blank = np.fromiter((p.isspace() for p in pieces), bool, len(pieces))
        solid = [p for p in pieces if not p.isspace()]
        joined = many(["\n".join(solid[i : i + most]) + "\n" for i in range(0, len(solid), most)])
        # the last line break of a text stays a pre-token: white space at the end
        ids = np.concatenate([np.array(x, dtype=np.uint32) for x in joined] or [np.zeros(0, np.uint32)])
        ends = np.flatnonzero(ids == mark)
        count = np.zeros(len(pieces), dtype=np.int64)
        count[~blank] = np.diff(np.append(-1, ends)) - 1
        single = many([p for p in pieces if p.isspace()])
        count[blank] = [len(x) for x in single]
        flat = np.empty(int(count.sum()), dtype=np.uint32)
        first = np.cumsum(count) - count
        flat[ranges(first[~blank], count[~blank])] = ids[ids != mark]
        flat[ranges(first[blank], count[blank])] = [i for x in single for i in x]
        return flat, count

    return encode


class Lexicon:
    """The ids of distinct pieces of text, each encoded once by ``encode`` (ids of all pieces, their number per piece)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        # where a piece's ids and characters begin in the pools, and how many there are
        self.first, self.count, self.begin, self.length = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.pool = np.zeros(0, dtype=np.uint32)
        self.spelt = np.zeros(0, dtype=np.uint32)

    def _learn(self, at: np.ndarray, keys: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: str) -> None:
        flat, count = self.encode([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        length = ends - starts
        self.first = np.insert(self.first, at, len(self.pool) + np.cumsum(count) - count)
        self.begin = np.insert(self.begin, at, len(self.spelt) + np.cumsum(length) - length)
        self.known, self.count, self.length = np.insert(self.known, at, keys), np.insert(self.count, at, count), np.insert(self.length, at, length)
        self.pool = np.concatenate([self.pool, flat])
        self.spelt = np.concatenate([self.spelt, codes[ranges(starts, length)]])

    def ids(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the pieces, how many each has, and the pieces that only share a hash with another piece."""
        value = (codes.astype(np.uint64) + np.uint64(1)) * _SPREAD
        value ^= value >> np.uint64(29)
        unique, where, inverse = np.unique(spans_hash(value, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE or len(self.spelt) > CACHE_CHARS:
            self._clear()
        at = np.searchsorted(self.known, unique)
        old = at < len(self.known)
        old[old] = self.known[at[old]] == unique[old]
        fresh = np.flatnonzero(~old)
        if len(fresh):
            w = where[fresh]
            self._learn(at[fresh], unique[fresh], codes, starts[w], ends[w], joined)
            at = np.searchsorted(self.known, unique)
        slot = at[inverse]
        length = ends - starts
        wrong = self.length[slot] != length
        alike = np.flatnonzero(~wrong & (length > 0))
        n = length[alike]
        differ = codes[ranges(starts[alike], n)] != self.spelt[ranges(self.begin[slot[alike]], n)]
        if differ.any():
            wrong[np.repeat(alike, n)[differ]] = True
        count = self.count[slot]
        return self.pool[ranges(self.first[slot], count)], count, np.flatnonzero(wrong)


class Encoder:
    """Encodes batches of texts by a library's ``many``, which gives the ids of each text of a list."""

    def __init__(self, many: Callable[[list[str]], list[list[int]]]):
        self.many, self.lexicon = many, Lexicon(_newline_parted(many))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's ids begin (one more at the end)."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        joined, codes, marks = end_marked(texts)
        kind = classes()[codes]
        kind[marks] = END
        starts = pre_tokens(codes, kind)
        ends = np.append(starts[1:], len(codes))
        real = kind[starts] != END
        starts, ends = starts[real], ends[real]
        flat, count, wrong = self.lexicon.ids(codes, starts, ends, joined)
        odd = np.union1d(np.searchsorted(marks, np.flatnonzero(kind == UNKNOWN)), np.searchsorted(marks, starts[wrong]))
        return with_whole(texts, flat, count, np.append(0, np.searchsorted(starts, marks)), odd, self.many)


def end_marked(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts with one mark behind each, their code points, and the places of the marks."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return joined, codes, np.cumsum(lengths + 1) - 1


def with_whole(texts: list[str], flat: np.ndarray, count: np.ndarray, first: np.ndarray, odd: np.ndarray, many: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their bounds per text, text i having the pieces first[i]:first[i + 1]; ``odd`` texts go to the library whole."""
    bounds = np.append(0, np.cumsum(count))[first]
    if len(odd):
        parts = [flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i in odd.tolist():
            parts[i] = np.array(many([texts[i]])[0], dtype=np.uint32)
        bounds = np.append(0, np.cumsum([len(p) for p in parts]))
        flat = np.concatenate(parts)
    return flat, bounds


_encoders: dict[tuple[str, str], Encoder] = {}


def tokenizers_encoder(path: str) -> Encoder:
    """By the tokenizers library and its file; special tokens' strings are ordinary text."""
    if ("json", path) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        many = lambda texts: [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]
        _encoders["json", path] = Encoder(many)
    return _encoders["json", path]


def tiktoken_encoder(path: str) -> tuple[Encoder, list[bytes]]:
    """By the tiktoken library and a rank file, without special tokens; the bytes of each id beside it."""
    if ("ranks", path) not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        spelled = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            spelled[rank] = word
        _encoders["ranks", path] = Encoder(lambda texts: [own.encode_ordinary(t) for t in texts]), spelled
    return _encoders["ranks", path]
