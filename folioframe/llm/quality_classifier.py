"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and character n-grams, which share a table by hash (a word
that repeats the one before it adds one more feature); a softmax layer tells the classes apart. Table and layer are trained by stochastic gradient descent in numpy, on the driver, on
at most MAX_TRAIN labelled documents of MAX_BYTES of text together (taken by the order of a hash of their ids, so the
sample is the same whenever the rows are). Scoring needs only each feature's share in the difference of the two logits, one number for each bucket, so
what travels to the executors has a fixed size whatever the corpus.

Defined results: a null text counts as empty; a text without features gets the prior of the layer's bias; without any
usable label every score is 0.5; labels other than 0 and 1 are not used; of an id's conflicting labels 1 counts, and of
its texts the one of the least hash is learned from; repeated rows are scored each for itself. Ids may be of any type.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.textkit import mix, text_slices
from folioframe.operators.tables import stored

BITS = 18
DIM = 16
NGRAMS = (3, 4)
MAX_TRAIN = 8000
MAX_BYTES = 64 << 20
EPOCHS = 12
RATE = 4.0
SEED = 7

_MULT = np.random.Generator(np.random.PCG64(SEED)).integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Hashed like a word: that a word repeats the one before it, which no bag of single features shows.
_AGAIN = np.uint64(0xA6A1)


def features(texts: list[str], bits: int = BITS, ngrams: tuple[int, ...] = NGRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all features of the texts, and the text each comes from, one kind of feature at a time."""
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    word = ~((code == 32) | ((code >= 9) & (code <= 13)))
    value = mix(code.astype(np.uint64) + np.uint64(1))
    value[~word] = 0
    shift = np.uint64(64 - bits)

    def owner(at: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, bounds)))

    # words: the sum of their code points' values, each times a power of a constant, by differences of a running sum
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(start):
        power = np.full(len(code), _MULT[0])
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        back = np.full(len(code), np.uint64(pow(int(_MULT[0]), -1, 2**64)))
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power)])
        h, row = mix((running[end] - running[start]) * back[start]), owner(start)
        yield (h >> shift).astype(np.int64), row
        again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
        yield np.full(len(again), int(mix(np.array([_AGAIN]))[0] >> shift)), row[again]
    for n in ngrams:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        inner = word[1 : m + 1].copy()  # the first and the last place may lie beside the word
        for i in range(2, n - 1):
            inner &= word[i : i + m]
        at = np.flatnonzero(inner)
        h = np.full(len(at), np.uint64(n))
        for i in range(n):
            h += value[at + i] * _MULT[i + 1]
        yield (mix(h) >> shift).astype(np.int64), owner(at)


@dataclass
class Model:
    """weight: of each bucket, its part of logit 1 minus logit 0; bias: the layer's."""

    weight: np.ndarray
    bias: float
    bits: int = BITS
    ngrams: tuple[int, ...] = NGRAMS

    def score(self, texts: list[str]) -> np.ndarray:
        total, many = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, row in features(texts, self.bits, self.ngrams):
            total += np.bincount(row, self.weight[bucket], len(texts))
            many += np.bincount(row, minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(many, 1) + self.bias)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, dim: int = DIM, ngrams: tuple[int, ...] = NGRAMS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """rows: buckets, their counts and the label of each document."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    if not rows:
        return Model(np.zeros(1 << bits), 0.0, bits, ngrams)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, count, label = rows[i]
            share = count.astype(np.float32)
            share /= max(share.sum(), 1)
            now = rate * (1 - done / steps)
            done += 1
            own = table[bucket]
            hidden = share @ own
            logit = hidden @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= np.float32(0.05 * now) * np.outer(hidden, p)
            bias -= np.float32(0.005 * now) * p
            table[bucket] = own - np.float32(now) * share[:, None] * back
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]), bits, ngrams)


def pack(bucket: np.ndarray, count: np.ndarray) -> bytes:
    """Rising buckets and their counts in some 2 bytes each, as the driver holds all documents' at once."""
    steps = np.diff(bucket, prepend=0)
    planes = [np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T for x in (steps, count)]
    return zlib.compress(np.concatenate(planes).tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (int32) and counts, these in one byte each if they fit."""
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    steps, count = (np.ascontiguousarray(x.T).view("<u4")[:, 0] for x in (planes[:4], planes[4:]))
    return np.cumsum(steps, dtype=np.int32), count.astype(np.uint8 if not len(count) or count.max() < 256 else np.uint32)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES, bits: int = BITS, ngrams: tuple[int, ...] = NGRAMS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Feature counts of at most max_train labelled documents, of max_bytes of text together."""
    usable = labels.where(labels[label_col].isin(0, 1)).groupBy(labels[id_col].alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(max_train)  # bounded, so it may be broadcast
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id")
    rows = stored(rows.groupBy("id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")
    sizes = rows.select(F.xxhash64("id").alias("h"), "id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("h", "id").toArrow()  # max_train rows at most
    fits = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), max_bytes, "right")) if sizes.num_rows else 0
    if fits < sizes.num_rows:
        last = sizes.slice(fits, 1).to_pylist()[0]
        rows = rows.where((F.xxhash64("id") < last["h"]) | ((F.xxhash64("id") == last["h"]) & (F.col("id") < F.lit(last["id"]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches):
            found = list(features(texts, bits, ngrams))
            if not found:
                continue
            key = np.concatenate([row.astype(np.int64) << bits | bucket for bucket, row in found])
            key, count = np.unique(key, return_counts=True)
            row, cut = key >> bits, np.searchsorted(key >> bits, np.arange(len(texts) + 1))
            bucket = (key & ((1 << bits) - 1)).astype(np.int32)
            data = pa.array([pack(bucket[x:y], count[x:y]) for x, y in zip(cut, cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([data, b.column("label").cast(pa.int32()), b.column("id")], names=["data", "label", "id"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(run, f"data binary, label int, id {kind}").toArrow().sort_by("id")
    return [(*unpack(data.as_py()), label) for data, label in zip(got["data"], got["label"].to_pylist())]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(shared.value.score(texts))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % folds
