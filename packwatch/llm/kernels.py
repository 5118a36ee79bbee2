"""Vectorised word and window hashing over Arrow text columns.

A batch of texts is one byte buffer with offsets.  Words are runs of bytes that
a 256-entry table calls word bytes; a word never crosses a text.  Hashes are
polynomials modulo 2**64 over a random byte table, taken from prefix sums, so
one pass gives the hash of every word and of every run of ``n`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time; a longer single text is hashed alone.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_MASK = (1 << 64) - 1
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

#: Lower-cases A-Z only.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Everything but ASCII white space: [^\x20\x09-\x0D].
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Letters, digits and all beyond ASCII, once A-Z are lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_ALNUM_BYTES = bytes(LOWER[b] if ALNUM[LOWER[b]] else 32 for b in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return text.translate(_ALNUM_BYTES).split()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class _Powers:
    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                have = getattr(self, name)
                while len(have) < size:
                    have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
                setattr(self, name, have)
        return self.up[:n], self.down[:n]


_POWERS = {_P: _Powers(_P), _Q: _Powers(_Q)}


class Prefixes:
    """Prefix sums over values, from which the hash of any run of them follows."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = _POWERS[base].upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.multiply(values, up[:-1], out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair, independent of where it stands."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def rolling(self, n: int) -> np.ndarray:
        """Hash of every n values in a row."""
        return (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]


def _runs(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return Prefixes(values, base).runs(start, end)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
        yield i, j
        i = j


class Words:
    """Words of a run of texts: byte range, text number and hash of each, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = False, hashed: bool = True):
        n = len(offsets) - 1
        table = kind[LOWER] if lower else kind
        inside = table[data]
        if len(data):
            before = np.empty_like(inside)
            before[0], before[1:] = False, inside[:-1]
            first = offsets[:-1]
            before[first[first < len(data)]] = False
            self.start = np.flatnonzero(inside & ~before)
            after = np.empty_like(inside)
            after[-1], after[:-1] = False, inside[1:]
            after[offsets[1:] - 1] = False
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)
        self.text = np.repeat(np.arange(n), self.count)
        if hashed:
            values = (_BYTES[LOWER] if lower else _BYTES)[data]
            self.hash = mix(_runs(values, self.start, self.end, _P))

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first word and hash of each run of n words of one text; lanes are independent."""
        if len(self) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.text[: len(self) - n + 1] == self.text[n - 1 :])
        values = mix(self.hash + U64(lane)) if lane else self.hash
        return at, mix(_runs(values, at, at + n, _Q))


def hashed_words(column: pa.Array, **kind) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """For bounded runs of texts: range of texts, their bytes, offsets and words."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, j, part, own, Words(part, own, **kind)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values stand in a sorted array."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def covered(size: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Marks the places within n of a start."""
    marks = np.zeros(size + 1, dtype=np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + n, -1)
    return np.cumsum(marks[:-1]) > 0
