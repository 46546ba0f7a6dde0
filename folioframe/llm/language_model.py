"""Scores of texts by a log-bilinear language model trained with noise-contrastive estimation.

Tokens are lower-cased words and an end of text. The WORDS most frequent words are units of their own, and each of the
TOP most frequent is a class of its own; every other word belongs to the class of its ending (its last three bytes), in
which the words that aren't units share one more unit, the class's tail. The model predicts a token's class from the two
units before it, then its unit among those of the class: the two contexts' vectors, added, times the vector of the class
or unit, plus a bias. Batched matrix products give both normalisers, so every text has a probability; within a tail a
word's share is its smoothed count, words never seen included.

Training is one pass over the training texts in ROUNDS rounds. A round's texts are dealt to parts by a hash of id and
text, as many parts as their tokens need, whatever files they come from; each part starts from the last round's
parameters and goes through its tokens in the hash's order, in batches of a fixed size, with Adagrad, against noise
classes and, within the class, noise units. The parts' changes are then averaged, each entry's by how much its part had
to say about it. So the same rows give the same model however they are partitioned, up to rounding.

Counts of all training words stay distributed. Only words frequent enough for a table of at most FREQUENT entries
travel to the executors; the counts of the others are joined by word.

Defined results: a null text counts as empty, whose only token is its end; rows whose fold can't be told (null id) are
scored and not learned from; repeated rows are scored, and learned from, each for itself; without any training text
every token's base is log10(0.1 / 0.1) = 0. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.textkit import Words, mix, scan, signed, slices
from folioframe.operators.tables import stored

WORDS = 8192
TOP = 31
ENDINGS = 96
DIM = 16
NOISE, UNIT_NOISE = 32, 1
BATCH = 2048
RATE = 0.2
ROUNDS = 4
#: Training tokens of a part in one round, and how many of them are put in random order at once.
PART_TOKENS = 1 << 20
SHUFFLED = 1 << 17
FREQUENT = 1 << 19
SMOOTH = 0.1
END = 0  # the class of the end of a text
BLOCK = 1 << 16


def endings(data: np.ndarray, w: Words, words: np.ndarray, n: int) -> np.ndarray:
    """Which of n kinds of ending each of the words (given by index) has."""
    start, end = w.start[words], w.end[words]
    key = np.zeros(len(end), np.uint64)
    for i in range(1, 4):
        byte = data[np.maximum(end - i, 0)]
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        key = key << np.uint64(8) | np.where(end - i >= start, byte, 0).astype(np.uint64)
    return (mix(key) % np.uint64(n)).astype(np.int64)


@dataclass
class Vocabulary:
    """Sorted hashes of the frequent words with their counts, units (-1: in a tail) and classes; units by class; totals."""

    hash: np.ndarray
    count: np.ndarray
    unit: np.ndarray
    word_class: np.ndarray
    words: int  # units that are words; the tails of the classes follow, then the start of a text (a context only)
    top: int
    endings: int
    unit_class: np.ndarray
    unit_count: np.ndarray
    tail_tokens: np.ndarray  # by class
    tail_distinct: np.ndarray
    tokens: int  # N
    distinct: int  # V
    ends: int

    @property
    def classes(self) -> int:
        return len(self.tail_tokens)

    @property
    def start(self) -> int:
        return self.words + self.classes

    def look(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts (-1: not in the table), units and classes of words."""
        u, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        count, unit, word_class = np.full(len(u), -1, np.int64), np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        at = np.searchsorted(self.hash, u)
        hit = np.flatnonzero(at < len(self.hash))
        hit = hit[self.hash[at[hit]] == u[hit]]
        count[hit], unit[hit], word_class[hit] = self.count[at[hit]], self.unit[at[hit]], self.word_class[at[hit]]
        others = np.flatnonzero(count < 0)
        word_class[others] = 1 + self.top + endings(data, w, first[others], self.endings)
        return count[inverse], np.where(unit < 0, self.words + word_class, unit)[inverse], word_class[inverse]

    def tail_share(self) -> np.ndarray:
        """log10 of what the smoothed counts of a class's tail add up to."""
        return np.log10(self.tail_tokens + SMOOTH * (self.tail_distinct + 1))


def word_counts(rows: DataFrame, kinds: int = ENDINGS) -> DataFrame:
    """h, k (kind of ending) and c of every word of the training rows; the row of null h counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(b.filter(b.column("train")) for b in batches):
            w = scan(data, offsets, lower=True)
            h, first, c = np.unique(w.hash, return_index=True, return_counts=True)
            k = endings(data, w, first, kinds)
            cols = [pa.concat_arrays([pa.array(signed(h)), pa.nulls(1, pa.int64())]), pa.array(np.append(k, -1).astype(np.int32)), pa.array(np.append(c, b.num_rows).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "k", "c"])

    return rows.mapInArrow(run, "h bigint, k int, c bigint").groupBy("h").agg(F.max("k").alias("k"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, words: int = WORDS, top: int = TOP, kinds: int = ENDINGS, frequent: int = FREQUENT) -> tuple[Vocabulary, int]:
    """The table of frequent words, and the least count that it holds completely."""
    of_words = counts.where("h is not null")
    ends = (counts.where("h is null").agg(F.sum("c")).first()[0]) or 0
    # how many words have each count: the distinct counts are few (m of them need m*m/2 tokens), and only the first matter
    levels = of_words.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(frequent).toArrow()
    upto = np.cumsum(levels["n"].to_numpy())
    fits = int(np.searchsorted(upto, frequent, "right"))
    least = int(levels["c"][fits - 1].as_py()) if fits else (int(levels["c"][0].as_py()) + 1 if len(levels) else 1)
    got = of_words.where(F.col("c") >= least).toArrow()  # at most `frequent` rows
    order = np.argsort(got["h"].to_numpy().view(np.uint64))
    h, c, k = (got[x].to_numpy()[order] for x in ("h", "c", "k"))
    h, c, k = h.view(np.uint64), c.astype(np.int64), k.astype(np.int64)
    best = np.lexsort((h, -c))[:words]
    words, top = len(best), min(top, len(best))
    unit = np.full(len(h), -1, np.int64)
    unit[best] = np.arange(words)
    word_class = 1 + top + k
    word_class[best[:top]] = 1 + np.arange(top)
    classes = 1 + top + kinds
    tail_tokens, tail_distinct = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in of_words.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # a row for each kind of ending
        tail_tokens[1 + top + r["k"]], tail_distinct[1 + top + r["k"]] = r["c"], r["n"]
    total, distinct = int(tail_tokens.sum()), int(tail_distinct.sum())
    np.subtract.at(tail_tokens, 1 + top + k[best], c[best])
    np.subtract.at(tail_distinct, 1 + top + k[best], 1)
    unit_class = np.concatenate([word_class[best], np.arange(classes)])
    tails = tail_tokens + SMOOTH
    tails[: 1 + top] = 0  # the classes of single words have no tail, and the end of a text stands in its class's
    tails[END] = ends + SMOOTH
    v = Vocabulary(h, c, unit, word_class, words, top, kinds, unit_class, np.concatenate([c[best], tails]), tail_tokens, tail_distinct, total + ends, distinct + (ends > 0), ends)
    return v, least


@dataclass
class Parameters:
    context: np.ndarray  # vectors of the unit just before, then of the one before that
    target: np.ndarray  # vectors of the classes, their biases in the last column
    unit: np.ndarray  # the same of the units as members of their class

    @staticmethod
    def begin(v: Vocabulary, dim: int = DIM, seed: int = 5) -> Parameters:
        draw = lambda n: np.random.default_rng(seed + n).normal(0, 0.1, (n, dim))
        by_class = np.bincount(v.unit_class, v.unit_count, v.classes)
        share = np.log(np.maximum(v.unit_count, 1e-9) / np.maximum(by_class[v.unit_class], 1e-9))
        target = np.column_stack([draw(v.classes), np.log(by_class / by_class.sum())])
        return Parameters(*(np.array(x, np.float32) for x in (draw(2 * (v.start + 1)), target, np.column_stack([np.zeros((v.start, dim)), share]))))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.unit]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def like(self, flat: np.ndarray) -> Parameters:
        out, at = [], 0
        for x in self.arrays():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Parameters(*out)

    def of(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """Vectors of contexts, with a 1 for the bias."""
        out = np.ones((len(c1), self.context.shape[1] + 1), np.float32)
        np.add(self.context[c1], self.context[c2 + len(self.context) // 2], out=out[:, :-1])
        return out


class Layout:
    """What the units of each class are, for drawing noise and for normalising."""

    def __init__(self, v: Vocabulary):
        self.start, self.unit_class, self.classes = v.start, v.unit_class, v.classes
        count = v.unit_count
        self.by_class = np.bincount(v.unit_class, count, v.classes)
        self.noise = self.by_class / self.by_class.sum()
        self.members = [np.flatnonzero((v.unit_class == k) & (count > 0)) for k in range(v.classes)]
        self.place = np.zeros(v.start, np.int64)
        for own in self.members:
            self.place[own] = np.arange(len(own))
        self.single = np.array([len(own) < 2 for own in self.members])
        self.order = np.argsort(v.unit_class, kind="stable")
        self.upto = np.cumsum(count[self.order])
        self.upto_class = np.cumsum(self.noise)
        self.upto_class[-1] = 1.0
        self.begins = np.concatenate([[0.0], np.cumsum(self.by_class)[:-1]])
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)
        self.log_unit = np.log(UNIT_NOISE * np.maximum(count, 1e-9) / self.by_class[v.unit_class]).astype(np.float32)

    def drawn_units(self, word_class: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """UNIT_NOISE units of each class given, by their counts."""
        z = self.begins[word_class][:, None] + rng.random((len(word_class), UNIT_NOISE)) * self.by_class[word_class][:, None]
        unit = self.order[np.minimum(np.searchsorted(self.upto, z.ravel(), "right"), len(self.order) - 1)]
        return unit.reshape(-1, UNIT_NOISE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive estimation with Adagrad, from parameters and squared gradients that stay as they are."""

    def __init__(self, p: Parameters, squares: Parameters, layout: Layout, seed: tuple[int, ...]):
        self.p, self.squares = p.like(p.flat()), squares.like(squares.flat())
        self.layout, self.rng = layout, np.random.default_rng(seed)

    def _step(self, x: np.ndarray, squares: np.ndarray, at: np.ndarray, gradient: np.ndarray) -> None:
        """Adds up the gradients of each row of x and takes a step along them."""
        order = np.argsort(at.astype(np.uint16) if len(x) < 1 << 16 else at, kind="stable")
        sorted_at = at[order]
        begin = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
        rows, g = sorted_at[begin], np.add.reduceat(gradient[order], begin, axis=0)
        total = squares[rows] + g * g
        squares[rows] = total
        x[rows] += np.float32(RATE) * g / np.sqrt(total)

    def batch(self, c1: np.ndarray, c2: np.ndarray, unit: np.ndarray) -> None:
        p, s, of = self.p, self.squares, self.layout
        k = of.unit_class[unit]
        r = p.of(c1, c2)
        drawn = np.searchsorted(of.upto_class, self.rng.random(NOISE) * of.upto_class[-1], "right")
        target, noise = p.target[k], p.target[drawn]
        up = 1 - _sigmoid(np.einsum("nd,nd->n", r, target) - of.log_noise[k])
        down = -_sigmoid(r @ noise.T - of.log_noise[drawn])
        dr = up[:, None] * target + down @ noise
        classes = np.concatenate([k, drawn]), np.concatenate([up[:, None] * r, down.T @ r])
        several = np.flatnonzero(~of.single[k])
        if len(several):
            rs, u = r[several], unit[several]
            others = of.drawn_units(k[several], self.rng)
            own, other = p.unit[u], p.unit[others]
            up2 = 1 - _sigmoid(np.einsum("nd,nd->n", rs, own) - of.log_unit[u])
            down2 = -_sigmoid(np.einsum("nd,nkd->nk", rs, other) - of.log_unit[others])
            dr[several] += up2[:, None] * own + np.einsum("nk,nkd->nd", down2, other)
            away = (down2[:, :, None] * rs[:, None, :]).reshape(-1, rs.shape[1])
            self._step(p.unit, s.unit, np.concatenate([u, others.ravel()]), np.concatenate([up2[:, None] * rs, away]))
        self._step(p.target, s.target, *classes)
        dr = dr[:, :-1]
        self._step(p.context, s.context, np.concatenate([c1, c2 + of.start + 1]), np.concatenate([dr, dr]))

    def fit(self, c1: np.ndarray, c2: np.ndarray, unit: np.ndarray) -> None:
        order = self.rng.permutation(len(unit))
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            self.batch(c1[at], c2[at], unit[at])


def log10_of(p: Parameters, layout: Layout, c1: np.ndarray, c2: np.ndarray, unit: np.ndarray, most: int = 1024) -> np.ndarray:
    """Normalised log10-probabilities of units after their contexts."""

    def normalised(s: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(s) and (top := s.max()) > 60:  # exp of a float would overflow
            s -= s.max(1)[:, None] if top > 80 else top / 2
        own = s[np.arange(len(s)), at]
        return own - np.log(np.exp(s, out=s).sum(1))

    k, out, r = layout.unit_class[unit], np.zeros(len(unit)), p.of(c1, c2)
    target = np.ascontiguousarray(p.target.T)
    for lo in range(0, len(unit), most):
        at = slice(lo, lo + most)
        out[at] = normalised(r[at] @ target, k[at])
    order = np.argsort(k.astype(np.uint16) if layout.classes < 1 << 16 else k, kind="stable")
    cut = np.searchsorted(k[order], np.arange(layout.classes + 1))
    for i in np.flatnonzero(~layout.single & (np.diff(cut) > 0)):
        members = np.ascontiguousarray(p.unit[layout.members[i]].T)
        for lo in range(cut[i], cut[i + 1], most):
            at = order[lo : min(lo + most, cut[i + 1])]
            out[at] += normalised(r[at] @ members, layout.place[unit[at]])
    return out / math.log(10)


def contexts(first: np.ndarray, units: np.ndarray, row: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit before, unit before that, unit and row of every token, the ends included, in order; and where the words are."""
    rows = len(first) - 1
    at = first + np.arange(rows + 1)  # where each row begins among the tokens
    token, place = np.full(at[-1], v.words + END, np.int64), np.arange(len(units)) + row
    token[place] = units
    c1, c2 = np.full(len(token), v.start, np.int64), np.full(len(token), v.start, np.int64)
    c1[1:], c2[2:] = token[:-1], token[:-2]
    c1[at[:-1]] = v.start
    c2[at[:-1]] = v.start
    second = at[:-1] + 1
    c2[second[second < at[1:]]] = v.start
    return c1, c2, token, np.repeat(np.arange(rows), np.diff(at)), place


def encoded(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """round, part, key (a hash of id and text) and units (array) of every training text."""
    parts = max(1, -(-v.tokens // (ROUNDS * PART_TOKENS)))
    shared = rows.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b, data, offsets in slices(b.filter(b.column("train")) for b in batches):
            w = scan(data, offsets, lower=True)
            _, unit, _ = v.look(data, w)
            key = b.column("key")
            h = mix(key.to_numpy().view(np.uint64))
            place = [pa.array((x % np.uint64(n)).astype(np.int32)) for x, n in ((h >> np.uint64(32), ROUNDS), (h & np.uint64(2**32 - 1), parts))]
            lists = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(unit.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*place, key, lists], names=["round", "part", "key", "units"])

    return rows.withColumn("key", F.xxhash64("id", "text")).mapInArrow(run, "round int, part int, key bigint, units array<int>")


def _parts(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[tuple[int, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Of rows sorted by part, each part with its tokens in pieces of SHUFFLED, the last one shorter."""
    pending: list[pa.RecordBatch] = []

    def more() -> pa.RecordBatch | None:
        while not pending:
            b = next(batches, None)
            if b is None:
                return None
            part = b.column("part").to_numpy()
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            pending.extend(b.slice(x, y - x) for x, y in zip(cut, cut[1:]) if y > x)
        return pending[0]

    def pieces(part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        while (b := more()) is not None and b.column("part")[0].as_py() == part:
            lists = pending.pop(0).column("units")
            first = lists.offsets.to_numpy().astype(np.int64)
            units = lists.values.to_numpy()[first[0] : first[-1]].astype(np.int64)
            first -= first[0]
            held.append(contexts(first, units, np.repeat(np.arange(len(first) - 1), np.diff(first)), v)[:3])
            n += len(held[-1][0])
            if n >= SHUFFLED:
                whole = [np.concatenate(x) for x in zip(*held)]
                for lo in range(0, n - SHUFFLED + 1, SHUFFLED):
                    yield tuple(x[lo : lo + SHUFFLED] for x in whole)
                held = [tuple(x[n - n % SHUFFLED :] for x in whole)]
                n %= SHUFFLED
        if n:
            yield tuple(np.concatenate(x) for x in zip(*held))

    while (b := more()) is not None:
        part = b.column("part")[0].as_py()
        yield part, pieces(part)


def train(rows: DataFrame, v: Vocabulary, dim: int = DIM, rounds: int = ROUNDS) -> Parameters:
    """The parameters after all rounds. What the driver sees of a round is one sum for each parameter."""
    p = Parameters.begin(v, dim)
    if not v.tokens:
        return p
    squares = p.like(np.full_like(p.flat(), 0.1))
    context, texts = rows.sparkSession.sparkContext, stored(encoded(rows, v), "units", by=["round"])
    for r in range(rounds):
        shared = context.broadcast((v, p, squares))

        def fit(batches: Iterator[pa.RecordBatch], r: int = r, shared=shared) -> Iterator[pa.RecordBatch]:
            v, p, squares = shared.value
            layout, old, was = Layout(v), p.flat(), squares.flat()
            for part, pieces in _parts(batches, v):
                trainer = Trainer(p, squares, layout, (11, r, part))
                for piece in pieces:
                    trainer.fit(*piece)
                weight = trainer.squares.flat() - was
                change = (trainer.p.flat() - old) * weight
                blocks = range(0, len(old), BLOCK)
                columns = [pa.array([x[lo : lo + BLOCK].tobytes() for lo in blocks], pa.binary()) for x in (change, weight)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([part] * len(blocks), pa.int32()), *columns], names=["block", "part", "change", "weight"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[np.ndarray]] = {}
            for b in batches:
                for block, *columns in zip(*(b.column(c).to_pylist() for c in ("block", "change", "weight"))):
                    new = [np.frombuffer(x, np.float32).astype(np.float64) for x in columns]
                    sums[block] = [x + y for x, y in zip(sums[block], new)] if block in sums else new
            for block, (change, weight) in sums.items():  # a task has few blocks: all of them together are the parameters
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([change.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary())], names=["block", "change", "weight"])

        own = texts.where(F.col("round") == r).select("part", "key", "units").repartition("part").sortWithinPartitions("part", "key")
        parts = stored(own.mapInArrow(fit, "block int, part int, change binary, weight binary"), "changes")
        got = parts.repartition("block").sortWithinPartitions("block", "part").mapInArrow(add, "block int, change binary, weight binary").orderBy("block").toArrow()
        if got.num_rows:
            change, weight = (np.concatenate([np.frombuffer(x, np.float64) for x in got[c].to_pylist()]) for c in ("change", "weight"))
            p, squares = p.like(p.flat() + change / np.maximum(weight, 1e-20)), squares.like(squares.flat() + weight)
    return p


def score_texts(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, frequent: int = FREQUENT) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of every text; the model learns from the rows that
    train_on picks."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"))
    counts = stored(word_counts(rows), "counts")
    v, least = vocabulary(counts, words, frequent=frequent)
    shared = rows.sparkSession.sparkContext.broadcast((v, train(rows, v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value
        layout, share = Layout(v), v.tail_share()
        uid = TaskContext.get().partitionId() << 40
        names = ["uid", "id", "h", "n", "known", "base", "model"]
        end = math.log10(v.ends + SMOOTH)
        for b, data, offsets in slices(batches):
            w = scan(data, offsets, lower=True)
            count, unit, word_class = v.look(data, w)
            rows = b.num_rows
            n = np.diff(w.first) + 1
            c1, c2, token, row, _ = contexts(w.first, unit, w.row, v)
            model = np.bincount(row, log10_of(p, layout, c1, c2, token), rows)
            there = count >= 0
            logs = np.log10(np.where(there, count, 0) + SMOOTH)
            base = np.bincount(w.row[there], logs[there], rows) + end
            rare = unit >= v.words
            model -= np.bincount(w.row[rare], share[word_class[rare]], rows)
            rare &= there
            model += np.bincount(w.row[rare], logs[rare], rows)
            known = np.bincount(w.row[there], minlength=rows) + (v.ends > 0)
            ids = uid + np.arange(rows)
            some = pa.nulls(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), b.column("id"), some, pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model)], names=names)
            at = np.flatnonzero(~there)  # words that aren't in the table: to be looked up by a join
            order = at[np.lexsort((w.hash[at], w.row[at]))]
            h, r = w.hash[order], w.row[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(h)))
            zero, void = pa.array(np.zeros(len(new), np.int64)), pa.nulls(len(new), b.column("id").type)
            nothing = pa.array(np.zeros(len(new)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[r[new]]), void, pa.array(signed(h[new])), pa.array(times.astype(np.int64)), zero, nothing, nothing], names=names)
            uid += rows

    parts = stored(rows.mapInArrow(run, f"uid bigint, id {kind}, h bigint, n bigint, known bigint, base double, model double"), "scores")
    others = counts.where(F.col("h").isNotNull() & (F.col("c") < least))
    looked = parts.where("h is not null").select("uid", "h", F.col("n").alias("times")).join(others, "h", "left")
    more = looked.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    per_token = math.log10(v.tokens + SMOOTH * (v.distinct + 1))
    extra = F.coalesce("more", F.lit(0.0))
    return parts.where("h is null").join(more, "uid", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n") * per_token).alias("base_score"),
        (F.col("model") + extra).alias("score"),
    )
