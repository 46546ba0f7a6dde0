"""Pairs of documents that may share an edited passage: whoever holds its words, however many hold its parts.

A stretch of L words of which at most a fraction 1 - similar is edited keeps at least L - (k - 1) - k * edits of its runs
of k words, so a document can have such a passage only where `min_words` words hold that many runs that other documents
have, and so can its source. Only the runs at such places are compared. A run that at most RARE documents have is matched
with every earlier holder. Of more frequent ones, pairs that lie APART words or more from one another are, also with every
earlier holder: so a line that thousands share makes no match for each pair of them, and a passage of such lines does.

Most of such pairs share a line and, by chance, a run beside it. So around the places where a pair meets, the words of both
are read, and it stays only if `min_words` of them hold as many runs of FINE words on near diagonals as the edits of a
passage leave. Windows of words go to the anchors' words, never whole documents for each pair. A run that stands over
PLACES times in either document tells no place: such a pair stays without that.

The runs go through three exchanges as packed arrays: by run to count their holders, by document to find the places, and
by run again to meet. A packed row holds what one slice of texts has for one part; the number of parts follows the bytes of
text, so a part's size doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.textkit import grams, mix, scan, slices
from folioframe.operators.tables import stored

K = 4
RARE = 32
APART = 28
#: Text whose runs make one part.
PART_BYTES = 8 << 20
#: Words of the runs that edited passages are chained from.
FINE = 2
#: Of a run that both documents have, so many places in each are looked at.
PLACES = 4
#: Places of a pair less than so many words and diagonals apart are looked at as one.
_WORDS, _DIAGONALS = 16, 8
#: A pair that meets at more such places stays without a look at any.
_MOST_PLACES = 32
#: Pairs that may meet in one row of their anchor, were it the anchor of all.
_PAIRS_ROW = 1 << 18
_PACKED = "part int, data binary"
#: In place of a run's place where it has more than PLACES.
_ANYWHERE = 2**32 - 1


def _pack(part: np.ndarray, parts: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """The columns' values as one row for each part, column after column."""
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    there = np.flatnonzero(np.diff(edge))
    data = [b"".join(c[edge[x] : edge[x + 1]].tobytes() for c in columns) for x in there]
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(data, pa.binary())], names=["part", "data"])


def _unpack(batches: Iterator[pa.RecordBatch], kinds: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each part with its columns; the rows come sorted by part."""
    size = sum(np.dtype(t).itemsize for t in kinds)
    held: list[list[np.ndarray]] = []
    now = -1
    for b in batches:
        for part, data in zip(b.column("part").to_pylist(), b.column("data")):
            if part != now and held:
                yield now, [np.concatenate(c) for c in zip(*held)]
                held = []
            now, raw, at, cols = part, data.as_buffer(), 0, []
            n = raw.size // size
            for t in kinds:
                cols.append(np.frombuffer(raw, t, n, at).copy())
                at += n * np.dtype(t).itemsize
            held.append(cols)
    if held:
        yield now, [np.concatenate(c) for c in zip(*held)]


def _exchanged(packed: DataFrame, parts: int) -> DataFrame:
    return packed.repartition(parts, "part").sortWithinPartitions("part")


def places(pos: np.ndarray, row: np.ndarray, min_words: int, least: int, k: int) -> np.ndarray:
    """Which of the runs, sorted by row and place, lie in a stretch of min_words that holds `least` of them."""
    n, at = len(pos), row * (1 << 32) + pos
    keep = np.zeros(n + 1, np.int64)
    if n >= least:
        first = np.arange(n - least + 1)
        good = first[at[first + least - 1] - at[first] <= min_words - k]
        np.add.at(keep, good, 1)
        last = np.searchsorted(at, at[good] + min_words - k, "right")
        np.add.at(keep, last, -1)
    return np.cumsum(keep)[:n] > 0


def inside(row: np.ndarray, pos: np.ndarray, ids: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs, sorted by row and place, lie whole in the spans of their document; ids are the rows'."""
    r = np.searchsorted(ids, of)
    there = r < len(ids)
    there[there] = ids[r[there]] == of[there]
    order = np.lexsort((lo[there], r[there]))
    r, lo, hi = r[there][order], lo[there][order] + (r[there][order] << 32), hi[there][order] + (r[there][order] << 32)
    if not len(r):
        return np.zeros(len(pos), bool)
    far = np.maximum.accumulate(hi)  # of spans that overlap or touch, where they end
    apart = np.concatenate([[True], lo[1:] > far[:-1]])
    begin, end = lo[apart], far[np.append(np.flatnonzero(apart)[1:] - 1, len(far) - 1)]
    at = (row << 32) + pos
    x = np.searchsorted(begin, at, "right") - 1
    return (x >= 0) & (at + k <= end[x])


def near_runs(min_words: int, similar: float, k: int = K) -> int:
    """How many runs of k words a stretch of min_words keeps at least, if no more of its words are edited than may be."""
    return max(2, min_words - (k - 1) - k * int((1 - similar) * min_words + 1e-9))


def edits_of(min_words: int, similar: float) -> int:
    """How many words of min_words may be edited."""
    return int((1 - similar) * min_words + 1e-9)


def fine_runs(min_words: int, similar: float) -> int:
    """How many runs of FINE words a stretch of min_words keeps at least: an edit takes two of them, a word left out one."""
    return max(2, min_words - 1 - 3 * edits_of(min_words, similar))


def band_of(min_words: int, similar: float) -> int:
    """How many diagonals apart the parts of a stretch of min_words may lie."""
    return 2 * edits_of(min_words, similar) + 4


def cells(d: np.ndarray, a: np.ndarray, pos: np.ndarray, apos: np.ndarray) -> np.ndarray:
    """Of the matches, sorted by d and a, those that stand for all within _WORDS and _DIAGONALS of them."""
    x, y = pos.astype(np.int64) // _WORDS, (apos.astype(np.int64) - pos + (1 << 40)) // _DIAGONALS
    order = np.lexsort((y, x, a, d))
    d, a, x, y = d[order], a[order], x[order], y[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return np.sort(order[new])


def near_enough(own: np.ndarray, other: np.ndarray, min_words: int, least: int, band: int) -> np.ndarray:
    """For each row of windows, whether min_words of own have `least` runs of FINE words that stand in other, at most `band`
    words from the same place. other is wider than own by band on either side. Places outside of a text are below 0, with
    different values in own and other."""
    rows, n = own.shape
    found = np.zeros((rows, n - FINE + 1), bool)
    for shift in range(2 * band + 1):
        equal = own == other[:, shift : shift + n]
        both = equal[:, : n - FINE + 1].copy()
        for i in range(1, FINE):
            both &= equal[:, i : n - FINE + 1 + i]
        found |= both
    count = np.zeros((rows, found.shape[1] + 1), np.int32)
    np.cumsum(found, axis=1, out=count[:, 1:])
    width = min(min_words - FINE + 1, found.shape[1])
    return (count[:, width:] - count[:, : count.shape[1] - width]).max(axis=1) >= least


def cut_out(words: np.ndarray, at: np.ndarray, before: int, size: int, outside: int) -> np.ndarray:
    """Windows of so many words from `before` words before each place."""
    x = at[:, None] - before + np.arange(size)
    there = (x >= 0) & (x < len(words))
    return np.where(there, words[np.where(there, x, 0)] & 0x7FFF, outside).astype(np.int16)


def near_pairs(rows: DataFrame, spans: DataFrame, min_words: int, similar: float, k: int = K, rare: int = RARE, apart: int = APART) -> DataFrame:
    """id and anchor: documents (id, text) with an earlier one that may hold a passage of theirs; whether that is certain
    enough without a look at their words (sure); and the places where they meet, if not: the word's place in the
    document shifted left by 32, plus that in the anchor. What lies in the spans (id, start and end in words) is known
    already and looks for nothing."""
    least = near_runs(min_words, similar, k)
    apart = min(apart, max(k, min_words - 2 * k))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    by_document = lambda ids: (mix(ids.view(np.uint64)) >> np.uint64(20)).astype(np.int64) % parts

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lo, hi = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "start", "end"))
            if len(ids):
                yield _pack(by_document(ids), parts, [lo, ids, hi.astype(np.uint32), np.full(len(ids), 2, np.uint8)])

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches):
            w = scan(data, offsets, lower=True)
            h, at = grams(w, k)
            if not len(h):
                continue
            row = w.row[at]
            ids = b.column("id").to_numpy(zero_copy_only=False)[row]
            place = (at - w.first[row]).astype(np.uint32)
            part = (h & np.uint64(0xFFFFFF)).astype(np.int64) % parts
            high = h >> np.uint64(24)
            yield _pack(part, parts, [high.astype(np.uint32), (high >> np.uint64(32)).astype(np.uint8), ids, place])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (low, high, ids, place) in _unpack(batches, ["u4", "u1", "i8", "u4"]):
            h = low.astype(np.int64) | (high.astype(np.int64) << 32)
            order = np.argsort(h, kind="stable")
            h = h[order]
            many = np.zeros(len(h), bool)  # runs that stand once go before anything else is sorted
            many[1:] = h[1:] == h[:-1]
            many[:-1] |= many[1:]
            order, h = order[many], h[many]
            ids, place = ids[order], place[order]
            order = np.lexsort((place, ids, h))
            h, ids, place = h[order], ids[order], place[order]
            if not len(h):
                continue
            new = np.concatenate([[True], h[1:] != h[:-1]])
            other = new | np.concatenate([[True], ids[1:] != ids[:-1]])
            group = np.cumsum(new) - 1
            holders = np.bincount(group[other], minlength=group[-1] + 1)[group]
            keep = holders > 1
            h, ids, place, holders = h[keep] << 23 | part, ids[keep], place[keep], holders[keep]
            yield _pack(by_document(ids), parts, [h, ids, place, (holders > rare).astype(np.uint8)])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (h, ids, place, hot) in _unpack(batches, ["i8", "i8", "u4", "u1"]):
            span = hot == 2
            lo, hi, of = h[span], place[span].astype(np.int64), ids[span]
            order = np.lexsort((place[~span], ids[~span]))
            h, ids, pos, hot = h[~span][order], ids[~span][order], place[~span][order].astype(np.int64), hot[~span][order] > 0
            if not len(h):
                continue
            row = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]))
            new = ~inside(row, pos, ids[np.concatenate([[True], ids[1:] != ids[:-1]])], of, lo, hi, k)
            keep = places(pos, row, min_words, least, k)
            h, ids, pos, new, hot, row = h[keep], ids[keep], pos[keep], new[keep], hot[keep], row[keep]
            order = np.lexsort((h, row))
            again = np.zeros(len(h), bool)
            again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
            silent, at = np.concatenate([[0], np.cumsum(hot | again | ~new)]), (row << 32) + pos  # runs that won't be counted below
            silent = silent[np.searchsorted(at, at + min_words - k, "right")] - silent[np.searchsorted(at, at - min_words + k)]
            need = np.where(new, np.maximum(least - silent, 1), 0)
            key, who, role, place = [h[~hot].view(np.uint64)], [ids[~hot]], [need[~hot]], [pos[~hot]]
            h, ids, pos, new, row = h[hot].view(np.uint64), ids[hot], pos[hot], new[hot], row[hot]
            for i in range(1, min_words):  # the i-th frequent run after each
                if i >= len(h):
                    break
                gap = pos[i:] - pos[:-i]
                at = np.flatnonzero((row[i:] == row[:-i]) & (gap >= apart) & (gap <= min_words - k))
                key.append(mix(mix(h[at]) + h[at + i]))
                who.append(ids[at])
                role.append((new[at] | new[at + i]).astype(np.int64))
                place.append(pos[at])
            key, who, role, place = map(np.concatenate, (key, who, role, place))
            order = np.lexsort((place, key, who))
            key, who, role, place = key[order], who[order], role[order], place[order]
            one = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1]) | (place[1:] != place[:-1])])[: len(key)]
            role = np.maximum.reduceat(role, np.flatnonzero(one)) if len(one) else role  # of hot pairs that begin at one place
            key, who, place = key[one], who[one], place[one]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])])[: len(key)])
            n = np.diff(np.append(first, len(key)))
            many = n > PLACES
            keep = ~np.repeat(many, n)
            least_role = np.minimum.reduceat(np.where(role > 0, role, 1 << 40), first) if len(first) else role
            role[first[many]] = np.where(least_role[many] < 1 << 40, least_role[many], 0)
            place[first[many]] = _ANYWHERE
            keep[first[many]] = True
            key, who, role, place = key[keep], who[keep], role[keep], place[keep]
            yield _pack((mix(key) >> np.uint64(20)).astype(np.int64) % parts, parts, [key, who, role.astype(np.uint16), place.astype(np.uint32)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 1 << 20
        for _, (key, who, role, place) in _unpack(batches, ["u8", "i8", "u2", "u4"]):
            order = np.lexsort((place, who, key))
            key, who, role, place = key[order], who[order], role[order], place[order]
            one = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            first = np.flatnonzero(one)
            begin = np.repeat(first, np.diff(np.append(first, len(key))))
            own = np.flatnonzero(one | np.concatenate([[True], who[1:] != who[:-1]])[: len(key)])
            own = np.repeat(own, np.diff(np.append(own, len(key))))  # where the places of the same run and document begin
            seek = np.flatnonzero((role > 0) & (own > begin))
            n = own[seek] - begin[seek]
            total = np.concatenate([[0], np.cumsum(n)])
            lo = 0
            while lo < len(seek):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
                mine = np.repeat(seek[lo:hi], n[lo:hi])
                theirs = np.repeat(begin[seek[lo:hi]] - total[lo:hi] + total[lo], n[lo:hi]) + np.arange(len(mine))
                order = np.lexsort((key[mine], who[theirs], who[mine]))
                mine, theirs = mine[order], theirs[order]
                d, a, need = who[mine], who[theirs], role[mine].astype(np.int32)
                fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1])])
                one = np.flatnonzero(fresh)
                # a run counts once for a pair, however many places it has; lo to hi may part the places of one, which counts it twice
                counts = np.add.reduceat((fresh | np.concatenate([[True], key[mine[1:]] != key[mine[:-1]]])).astype(np.int32), one).astype(np.int32)
                anywhere = np.logical_or.reduceat((place[mine] == _ANYWHERE) | (place[theirs] == _ANYWHERE), one)
                at = cells(d, a, place[mine].astype(np.int64), place[theirs].astype(np.int64))
                group = (np.cumsum(fresh) - 1)[at]
                anywhere |= np.bincount(group, minlength=len(one)) > _MOST_PLACES
                at, group = at[~anywhere[group]], group[~anywhere[group]]
                values = place[mine[at]].astype(np.int64) << 32 | place[theirs[at]]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(len(one) + 1)).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(d[one]), pa.array(a[one]), pa.array(counts), pa.array(np.minimum.reduceat(need, one)), pa.array(anywhere), lists], names=["id", "anchor", "n", "need", "sure", "places"])
                lo = hi

    runs = rows.where("id is not null").mapInArrow(runs_of, _PACKED)
    counted = _exchanged(runs, parts).mapInArrow(shared, _PACKED).union(spans.mapInArrow(bounds, _PACKED))
    keyed = _exchanged(counted, parts).mapInArrow(keys, _PACKED)
    met = _exchanged(keyed, parts).mapInArrow(meet, "id bigint, anchor bigint, n int, need int, sure boolean, places array<bigint>")
    met = met.groupBy("id", "anchor").agg(F.sum("n").alias("n"), F.min("need").alias("need"), F.bool_or("sure").alias("sure"), F.flatten(F.collect_list("places")).alias("places"))
    sure = F.col("sure") | (F.size("places") > 4 * _MOST_PLACES)
    return met.where("n >= need").select("id", "anchor", sure.alias("sure"), F.when(~sure, F.col("places")).alias("places"))


def looked_at(pairs: DataFrame, words: DataFrame, min_words: int, similar: float) -> DataFrame:
    """id and anchor of the pairs that are sure or whose words (id, words), around a place where they meet, are like a
    passage's. Each document's words are read once for all of its pairs, and once for those that it is the anchor of."""
    least, band = fine_runs(min_words, similar), band_of(min_words, similar) + _DIAGONALS
    before = min_words + _WORDS
    size = 2 * before
    chunks = 1 + pairs.count() // _PAIRS_ROW

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, theirs in zip(b.column("id").to_pylist(), b.column("words"), b.column("pairs")):
                w, anchors, lists = w.values.to_numpy(zero_copy_only=False), theirs.values.field("anchor"), theirs.values.field("places")
                for lo in range(0, len(anchors), 1024):
                    anchor, places = anchors[lo : lo + 1024], lists[lo : lo + 1024]
                    edge = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))])
                    at = places.flatten().to_numpy(zero_copy_only=False)
                    x = cells(np.repeat(np.arange(len(anchor)), np.diff(edge)), np.zeros(len(at), np.int64), at >> 32, at & 0xFFFFFFFF)
                    edge, at = np.searchsorted(x, edge), at[x]
                    data = cut_out(w, at >> 32, before, size, -1).tobytes()
                    windows = [data[y * 2 * size : z * 2 * size] for y, z in zip(edge.tolist(), edge[1:].tolist())]
                    lists_ = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array((at & 0xFFFFFFFF).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([anchor, pa.array(np.full(len(anchor), i)), lists_, pa.array(windows, pa.binary())], names=["anchor", "id", "at", "windows"])

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, theirs in zip(b.column("anchor").to_pylist(), b.column("words"), b.column("pairs")):
                w, ids, lists, windows = w.values.to_numpy(zero_copy_only=False), theirs.values.field("id"), theirs.values.field("at"), theirs.values.field("windows")
                for lo in range(0, len(ids), 256):
                    id_, at = ids[lo : lo + 256], lists[lo : lo + 256]
                    pair = np.repeat(np.arange(len(id_)), at.value_lengths().to_numpy(zero_copy_only=False))
                    mine = np.frombuffer(b"".join(windows[lo : lo + 256].to_pylist()), np.int16).reshape(-1, size)
                    good = near_enough(mine, cut_out(w, at.flatten().to_numpy(zero_copy_only=False), before + band, size + 2 * band, -2), min_words, least, band)
                    good = np.bincount(pair[good], minlength=len(id_)) > 0
                    yield pa.RecordBatch.from_arrays([id_.filter(pa.array(good)), pa.array(np.full(int(good.sum()), i))], names=["id", "anchor"])

    open_ = pairs.where("not sure").groupBy("id", F.pmod(F.xxhash64("anchor"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("anchor", "places")).alias("pairs"))
    open_ = open_.join(words, "id").select("id", "words", "pairs").mapInArrow(own, "anchor bigint, id bigint, at array<int>, windows binary")
    open_ = open_.groupBy("anchor", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("id", "at", "windows")).alias("pairs"))
    open_ = open_.join(words.withColumnRenamed("id", "anchor"), "anchor").select("anchor", "words", "pairs").mapInArrow(other, "id bigint, anchor bigint")
    return stored(pairs.where("sure").select("id", "anchor").union(open_), "looked_at")
