"""Vectorised tokens: words and their 64-bit hashes straight from Arrow's UTF-8 buffers.

A word's hash takes its folded bytes eight at a time through a bijective finaliser, for all words of a
batch at once: words of equal length up to eight bytes never share a hash, longer ones only by chance.
Words beyond LONG bytes are rare and are digested one by one. Texts of any length go in pieces of about
PIECE bytes that are cut between words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
SLICE_BYTES = 4 << 20

#: Bytes of a word beyond which it is digested by itself.
LONG = 64
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and what each is folded to."""

    word: np.ndarray
    fold: np.ndarray


def _alphabet(separators: list[tuple[int, int]]) -> Alphabet:
    word = np.ones(256, bool)
    for low, high in separators:
        word[low : high + 1] = False
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return Alphabet(word, fold)


#: Words are runs of anything but ASCII white space; A-Z count as a-z.
SPACED = _alphabet([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of digits, letters and everything beyond ASCII; A-Z count as a-z.
ALNUM = _alphabet([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: As SPACED, without folding.
RAW = Alphabet(SPACED.word, np.arange(256, dtype=np.uint8))


@dataclass
class Tokens:
    """Words of a slice of rows: hashes, byte spans in ``data``, and each row's range in them."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    data: np.ndarray
    row: np.ndarray

    def of(self, i: int) -> slice:
        return slice(int(self.ptr[i]), int(self.ptr[i + 1]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words at ``start`` to ``end`` in folded bytes that eight zeros follow."""
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(1))
    eight = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))  # the eight bytes from each place on
    live, at, left = slice(None), start, size
    while len(at):
        chunk = eight[at] & _KEEP[np.minimum(left, 8)]
        out[live] = mix(mix(out[live] ^ chunk) + np.uint64(1))
        more = np.flatnonzero((left > 8) & (left + at - start[live] <= LONG))
        live, at, left = (more if isinstance(live, slice) else live[more]), at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return flat, at - at[0]


def tokenize(column: pa.Array, kind: Alphabet) -> Tokens:
    data, row = buffers(column)
    n = len(data)
    hashes, starts, ends = [], [], []
    inside = kind.word[data]
    first = np.zeros(n + 1, bool)
    first[row] = True
    a = 0
    while a < n:
        b = min(n, a + PIECE)
        if b < n:
            while b < n and inside[b] and inside[b - 1] and not first[b]:
                stop = np.flatnonzero(~inside[b : b + PIECE] | first[b : min(n, b + PIECE)])
                b = min(n, b + PIECE) if not len(stop) else b + int(stop[0])
        mask, cut = inside[a:b], first[a : b + 1]
        begins = mask.copy()
        begins[1:] &= ~mask[:-1] | cut[1:-1]
        finishes = mask.copy()
        finishes[:-1] &= ~mask[1:] | cut[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        folded = np.concatenate([kind.fold[data[a:b]], np.zeros(8, np.uint8)])
        hashes.append(_hashed(folded, s, e))
        starts.append(s + a)
        ends.append(e + a)
        a = b
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    start = join(starts, np.int64)
    return Tokens(join(hashes, np.uint64), start, join(ends, np.int64), np.searchsorted(start, row), data, row)


_Q = np.uint64(0xD1342543DE82EF95)
_Q_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of each ``k`` consecutive words; empty where there are fewer."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    if k == 2:
        return mix(hashes[:-1] * _Q + hashes[1:])
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * _powers(_Q, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(_Q_INV, n - k + 1))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct ``k``-word shingles, sorted; a shorter sequence is one shingle, none is none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(windows(hashes, min(k, len(hashes))))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about SLICE_BYTES of text, or one row."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def strings(values: list, kind: pa.DataType = pa.string()) -> pa.Array:
    return pa.array(values, kind)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed number, which is what Spark's long holds."""
    return np.ascontiguousarray(x).view(np.int64)
