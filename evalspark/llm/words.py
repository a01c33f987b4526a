"""Words of whole batches of texts as numpy arrays.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which on UTF-8 is exactly the pattern
``[^\\x20\\x09-\\x0D]+`` on code points. Texts are worked on in slices of a few megabytes, so that a
task's memory does not depend on the number of texts it holds; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

P31 = np.uint64(2**31 - 1)
_WIDTH = np.uint64(31)
_random = np.random.Generator(np.random.PCG64(20_250_101))
_BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64)
_BASES = (0x4F1BBCDC, 0x2545F491)  # two hashes modulo the prime 2**31 - 1 are taken together
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}
_inverse: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the usual xor, shift and multiply finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fold(x: np.ndarray) -> np.ndarray:
    low = x & P31
    low += x >> _WIDTH
    return low


def _mod(x: np.ndarray) -> np.ndarray:
    """Values below 2**63 modulo the prime."""
    x = _fold(_fold(x))
    return np.minimum(x, x - P31)  # below the prime the difference wraps to a large value


def _accumulate(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo the prime, by doubling."""
    found = np.ones(1, dtype=np.uint64)
    while len(found) < n:
        found = np.concatenate([found, _mod(found * np.uint64(pow(base, len(found), int(P31))))])
    return found[:n]


def _forward(k: int, n: int) -> np.ndarray:
    if k not in _powers or len(_powers[k]) < n:
        _powers[k] = _accumulate(_BASES[k], max(n, SLICE_BYTES + 100_000)).astype(np.uint32)
    return _powers[k][:n]


def _backward(k: int, at: np.ndarray) -> np.ndarray:
    """The inverse powers for the given exponents: those of a slice from a table made once, higher ones from two small tables."""
    inverse = pow(_BASES[k], -1, int(P31))
    if k not in _inverse:
        _inverse[k] = _accumulate(inverse, SLICE_BYTES + 100_000).astype(np.uint32)
    if not len(at) or int(at.max()) < len(_inverse[k]):
        return _inverse[k][at].astype(np.uint64)
    low = _accumulate(inverse, 1024)
    high = _accumulate(pow(inverse, 1024, int(P31)), (int(at.max()) >> 10) + 1)
    return _mod(low[at & 1023] * high[at >> 10])


def run_sums(values: np.ndarray) -> list[np.ndarray]:
    """Prefix sums of ``values`` (62 bits of each count) times powers, for ``run_hash``."""
    found = []
    for k in range(2):
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        part = (values if k == 0 else values >> _WIDTH) & P31
        part *= _forward(k, len(values))
        np.cumsum(_fold(part), out=total[1:])  # wraps without harm: only differences below 2**63 are used
        found.append(total)
    return found


def run_hash(sums: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run [start, end) of the summed values; its place doesn't matter, its length does.

    Polynomials modulo 2**64 collide on Thue-Morse strings for every odd base; modulo a prime they don't.
    """
    one, two = (_mod(_mod(total[ends] - total[starts]) * _backward(k, starts)) for k, total in enumerate(sums))
    return mix((one | (two << _WIDTH)) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[start:end], whose place does not matter."""
    return run_hash(run_sums(values), starts, ends)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive slices of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if len(wide) == 0:
        return
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    held = wide.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(wide):
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(max(high, low + 1), len(wide))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


class Words:
    """The words of the texts data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, inside: np.ndarray | None = None):
        """``inside`` tells which of the 256 bytes belong to words, where these aren't all but white space."""
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        solid = ~_SPACE[data] if inside is None else inside[self.data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = False
            before[1:] = solid[:-1]
        after = np.empty(len(data), dtype=bool)
        if len(data):
            after[-1] = False
            after[:-1] = solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        # words first[i] to first[i + 1] are those of text i
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def hashes(self) -> np.ndarray:
        return spans_hash(_BYTE[self.data], self.starts, self.ends)

    @cached_property
    def _sums(self) -> list[np.ndarray]:
        return run_sums(self.hashes)

    def runs(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run of ``length`` words."""
        return run_hash(self._sums, starts, starts + length)

    def run_starts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``length`` words inside one text, and their number per text."""
        n = np.maximum(self.counts - length + 1, 0)
        return ranges(self.first[:-1], n), n

    def text_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blank_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    return _SPACE[data]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each start and length, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
