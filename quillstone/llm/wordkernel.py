"""Vectorised word handling on Arrow string columns, for use inside tasks.

A column of texts is one byte buffer; words, their 64-bit hashes and rolling
hashes of word n-grams are computed over the whole buffer with numpy, never
word by word. Byte classes suffice because every pattern the operators use
treats all code points above 0x7F alike (each is a word character), and all
bytes of such a code point are above 0x7F as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view

U64 = np.uint64
GRAM = U64(0xD1342543DE82EF95)
SEGMENT = 1 << 20
SLICE_BYTES = 4 << 20
#: For work that holds many arrays of a slice at once; workers keep what they once took.
SMALL_SLICE_BYTES = 1 << 20

#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


@dataclass
class Words:
    """The words of some documents, in order.

    ``data`` is the byte buffer, ``offsets`` the byte range of each document in
    it, ``start``/``end`` the byte range of each word, ``bounds`` the word range
    of each document and ``hash`` a 64-bit hash of each word.
    """

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word, as a position in the column."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, and which of them stay inside their document. Other salts give independent hashes."""
        n = len(self.hash)
        room = np.repeat(self.bounds[1:], self.counts) - np.arange(n)
        if n < k:
            return np.zeros(n, dtype=U64), np.zeros(n, dtype=bool)
        own = mix(self.hash ^ U64(salt)) if salt else self.hash
        g = own[: n - k + 1].copy()
        for j in range(1, k):
            g *= GRAM
            g += own[j : n - k + 1 + j]
        g = mix(g + U64(k))
        return np.concatenate([g, np.zeros(k - 1, dtype=U64)]), room >= k

    def text(self, i: int) -> list[bytes]:
        """The words of document i."""
        a, b = self.bounds[i], self.bounds[i + 1]
        raw = self.data
        return [raw[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b])]


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offs - offs[0]


#: Values of the bytes at the first places of a word; those further on are worked out.
_NEAR = 64
_VALUES = mix(np.arange(1, _NEAR * 256 + 1, dtype=U64) * GRAM)


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A sum of mixed (byte, place) values for each word, over segments that begin at a word.

    Each byte is mixed with its place before it is added, so unlike a polynomial no
    pattern of swapped bytes cancels out by its form.
    """
    out = np.empty(len(start), dtype=U64)
    a = 0
    while a < len(start):
        lo = start[a]
        b = max(a + 1, int(np.searchsorted(end, lo + SEGMENT, side="right")))
        hi = end[b - 1]
        for from_ in range(lo, hi, SEGMENT) if b == a + 1 else (lo,):  # a longer word comes in parts
            to = min(hi, from_ + SEGMENT) if b == a + 1 else hi
            n = to - from_
            first = np.zeros(n, dtype=np.int64)
            if b > a + 1:
                first[start[a:b] - lo] = start[a:b] - lo
                np.maximum.accumulate(first, out=first)
                place = np.arange(n) - first
            else:
                place = np.arange(from_ - lo, to - lo)
            code = (place << 8) | data[from_:to]
            near = place < _NEAR
            value = _VALUES[np.where(near, code, 0)]
            if not near.all():
                far = ~near
                value[far] = mix((code[far] + 1).astype(U64) * GRAM)
            if b == a + 1:
                out[a : a + 1] = (out[a : a + 1] if from_ > lo else 0) + value.sum(dtype=U64, keepdims=True)
            else:
                sums = np.zeros(n + 1, dtype=U64)
                np.cumsum(value, out=sums[1:])
                out[a:b] = sums[end[a:b] - lo] - sums[start[a:b] - lo]
        a = b
    return mix(out + (end - start).astype(U64) * GRAM)


def words_of(col: pa.Array, inside: np.ndarray, lower: bool = False) -> Words:
    """Split every text of a column; ``inside`` tells the bytes that words are made of."""
    data, offsets = string_buffer(col)
    if lower:
        data = LOWER[data]
    is_in = inside[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = is_in[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    start = np.flatnonzero(is_in & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = is_in[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(is_in & ~after) + 1
    bounds = np.searchsorted(start, offsets)
    return Words(data, offsets, start, end, bounds, _hash_words(data, start, end))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``most`` bytes of text; one longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_buffer(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def winnow(grams: np.ndarray, room: np.ndarray, window: int) -> np.ndarray:
    """For each gram that begins a window of ``window`` grams inside its document, the place of the least one.

    ``room`` tells which places begin such a window. Equal hashes: the first.
    The choice depends on the window's words alone, so equal spans of words
    choose equal places. Returns one place for each place where ``room`` holds.
    """
    at = np.flatnonzero(room)
    if not len(at):
        return at
    least = sliding_window_view(grams, window).argmin(axis=1)
    return at + least[at]


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over the range of each document."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def covered(n: int, first: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a run of ``length`` from one of the places ``first``."""
    steps = np.zeros(n + length + 1, dtype=np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + length, -1)
    return np.cumsum(steps)[:n] > 0
