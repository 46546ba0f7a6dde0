"""Byte-level BPE encoding and decoding by the ranks of a given vocabulary.

A text is split by the tokenizer's pattern. The distinct pieces that a worker hasn't met lately are encoded together:
pieces of about the same length become the rows of a padded matrix of ids, and in each round every row merges its
leftmost pair of minimum rank, found in a hash table of pairs; rows without a mergeable pair leave the matrix. Pieces
longer than LONG bytes, where rounds over a matrix would cost the square of the length, take the same merges through a
heap. A bounded cache keeps the ids of pieces.

Defined results: a null text encodes as the empty text (no ids); a lone surrogate can't occur, as Spark strings are
UTF-8; repeated rows are encoded each for itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioframe.llm.textkit import text_slices

LONG = 192
#: Bytes of pieces, with their ids, that a worker remembers; longer pieces than LONG are never remembered.
CACHE = 64 << 20
_NONE = np.int32(2**31 - 1)


class Pairs:
    """A hash table from a pair of ids to the id of the merged pair, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1)))) + 2)
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.key = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.value = np.full(1 << self.bits, _NONE)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):  # of those that want a free slot, one gets it; the others try the next
            free = self.key[slot[todo]] == np.uint64(2**64 - 1)
            _, one = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][one]
            self.key[slot[won]], self.value[slot[won]] = key[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_NONE where a pair doesn't merge, or one of it is padding (negative)."""
        key = ((left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(2**32 - 1))).ravel()
        out = np.full(len(key), _NONE)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        slot = self._slot(key[todo])
        while len(todo):
            at = self.key[slot]
            hit = at == key[todo]
            out[todo[hit]] = self.value[slot[hit]]
            on = ~hit & (at != np.uint64(2**64 - 1))
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Codec:
    """ranks: the file's bytes, a line of base64 and rank for each token. pattern splits a text into pieces."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.bytes = {v: k for k, v in self.ids.items()}
        self.split = regex.compile(pattern).findall
        self.one = np.full(256, -1, np.int32)
        found = []
        for token, rank in self.ids.items():
            if len(token) == 1:
                self.one[token[0]] = rank
            for i in range(1, len(token)):
                a, b = self.ids.get(token[:i]), self.ids.get(token[i:])
                if a is not None and b is not None:
                    found.append((a, b, rank))
        if (self.one < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.merge = {(a, b): r for a, b, r in found}
        table = np.array(found, np.int64).reshape(-1, 3)
        self.pairs = Pairs(table[:, 0], table[:, 1], table[:, 2].astype(np.int32))
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def _bucket(self, rows: list[bytes]) -> list[bytes]:
        """Ids of rows of about the same length, packed as little-endian unsigned 32-bit integers."""
        width = max(map(len, rows))
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = self.one[np.frombuffer(b"".join(rows), np.uint8)]
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < lens[:, None]] = flat
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        out: list[bytes] = [b""] * len(rows)
        who = np.arange(len(rows))
        while len(who):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(who), np.int64)
            best = rank[np.arange(len(who)), at] if rank.shape[1] else np.full(len(who), _NONE)
            done = best == _NONE
            if done.any():
                for i, row in zip(who[done], ids[done]):
                    out[i] = row[row >= 0].astype("<u4").tobytes()
                who, ids, rank, at, best = who[~done], ids[~done], rank[~done], at[~done], best[~done]
                if not len(who):
                    break
            n, width = ids.shape
            every = np.arange(n)
            ids[every, at] = best
            cols = np.arange(width - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            if width == 2:
                rank = np.zeros((n, 0), np.int32)
                continue
            cols = np.arange(width - 2)
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), 1)
            right = at < width - 2
            rank[every[right], at[right]] = self.pairs.find(ids[every[right], at[right]], ids[every[right], at[right] + 1])
            left = at > 0
            rank[every[left], at[left] - 1] = self.pairs.find(ids[every[left], at[left] - 1], ids[every[left], at[left]])
        return out

    def _long(self, piece: bytes) -> bytes:
        ids = self.one[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.merge.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := self.merge.get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := self.merge.get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        kept = np.array(ids, np.int64)
        return kept[kept >= 0].astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(raw):
            if len(p) > LONG:
                out[i] = self._long(p)
            else:
                buckets.setdefault(len(p) if len(p) < 8 else (len(p) + 3) // 4 * 4, []).append(i)
        for rows in buckets.values():
            for lo in range(0, len(rows), 65536):
                part = rows[lo : lo + 65536]
                for i, x in zip(part, self._bucket([raw[i] for i in part])):
                    out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.split(t) for t in texts]
        distinct = set().union(*split) if split else set()
        new = distinct - self.cache.keys()
        if self.cached > CACHE:
            self.cache.clear()
            self.cached, new = 0, distinct
        fresh = sorted(new)
        self.cache.update(zip(fresh, self.encode_pieces(fresh)))
        get = self.cache.__getitem__
        out = [b"".join(map(get, s)) for s in split]
        for p in fresh:
            if len(p) > LONG:
                del self.cache[p]
            else:
                self.cached += 4 * len(p) + len(self.cache[p])
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver: it is a vocabulary of fixed size, so it may travel to every executor."""
    with open(path, "rb") as f:
        return f.read()


def _per_text(docs: DataFrame, ranks: bytes, pattern: str, id_col: str, text_col: str, fields: str, row) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for b, texts in text_slices(batches):
            cols = list(zip(*(row(codec, packed) for packed in codec.encode(texts))))
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, cols)], names=["id", *(f.split()[0] for f in fields.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of every text."""
    return _per_text(docs, ranks, pattern, id_col, text_col, "ids array<int>", lambda codec, packed: (np.frombuffer(packed, "<i4"),))


def digest(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every text: how many ids it has, and digests of the ids and of what they decode to."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _per_text(docs, ranks, pattern, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda codec, packed: (len(packed) // 4, sha(packed), sha(codec.decode(packed))))


def decode(encoded: DataFrame, ranks: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; null ids give the empty text, bytes that aren't UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {int(b): base64.b64decode(a) for a, b in (x.split() for x in shared.value.splitlines() if x)}
        for b in batches:
            texts = [b"".join(table[i] for i in ids or ()).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
