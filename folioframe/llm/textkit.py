"""Vectorised word splitting and hashing over Arrow batches, shared by the operators on words.

Texts are handled in slices of a megabyte (a longer single text is a slice of its own), so a worker's memory is
bounded by the slice or by its longest text, whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20

#: The bytes between words.
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
        if size > 8 * SLICE_BYTES:  # one giant text: don't keep its table
            _powers.pop(base)
    return have[:n]


@dataclass
class Words:
    """Words of a slice in order: row within the slice, byte span within the slice, 64-bit hash; first word of each row."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more entry than rows


def scan(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """data: the rows' UTF-8 bytes one after another; offsets: where each row begins, and the end."""
    n = len(data)
    word = ~_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, z.astype(np.uint64), np.zeros(len(offsets), np.int64))
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((_LOWER if lower else _BYTE)[data] * _power(_BASE, n), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _power(_BASE_INV, n)[start]
    h = mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(row, start, end, h, first)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and the index of each run's first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    h = w.hash[at]
    for i in range(1, k):
        h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + w.hash[at + i])
    return h, at


def runs(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each index on, of word hashes h, in time that n doesn't change."""
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_BASE, len(h)), out=prefix[1:])
    return mix((prefix[at + n] - prefix[at]) * _power(_BASE_INV, len(h))[at])


def whole(w: Words, row: int) -> int:
    """A hash of a row's whole word sequence."""
    h = np.uint64(0x51)
    for x in w.hash[w.first[row] : w.first[row + 1]]:
        h = mix(np.atleast_1d(h) * np.uint64(0xFF51AFD7ED558CCD) + x)[0]
    return int(h)


def column_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column without copying; a null has no bytes."""
    if pa.types.is_large_string(text.type):
        kind = np.int64
    else:
        text, kind = text.cast(pa.string()), np.int32
    _, off, data = text.buffers()
    o = np.frombuffer(off, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into slices of at most so many bytes of text, a row at least: the rows, their bytes, their offsets."""
    for b in batches:
        if not b.num_rows:
            continue
        data, off = column_bytes(b.column(text))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            yield b.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same with the texts as Python strings; null becomes empty."""
    for b, _, _ in slices(batches, text, most):
        yield b, [t or "" for t in b.column(text).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def replace_texts(b: pa.RecordBatch, text_col: str, length_col: str | None, new: list[str | None]) -> pa.RecordBatch:
    """The batch with new texts; where one has changed, length_col (if it is a column) is its length from then on."""
    old = b.column(text_col).to_pylist()
    columns = {text_col: new}
    if length_col in b.schema.names:
        columns[length_col] = [n if t is None or t == o else len(t) for n, t, o in zip(b.column(length_col).to_pylist(), new, old)]
    for name, values in columns.items():
        at = b.schema.get_field_index(name)
        b = b.set_column(at, b.schema.field(at), pa.array(values, b.schema.field(at).type))
    return b
