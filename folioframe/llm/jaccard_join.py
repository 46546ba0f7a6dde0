"""N-gram Jaccard join: groups of documents whose sets of word n-grams overlap enough.

The join is a product of the sparse matrix of documents by n-grams with its own transpose, in blocks of columns: each
n-gram's documents meet in one block, the products of all blocks add up to the overlap of a pair, and pairs that can't
reach the overlap their sizes ask for are dropped. Three things keep the product small without losing a link:

* Documents of equal sets are one row of the matrix.
* A row keeps only the columns it needs: of a set of n, those but the ceil(t n) - 1 most frequent (two sets of Jaccard
  t or more share one of these). What counts as frequent is told by a table of counts of fixed size over all documents;
  collisions in it can change the order of columns, never the result. A pair of overlap o among the kept columns
  overlaps by o + max(rest of x, rest of y) at most; below ceil(t (x + y) / (1 + t)) it is dropped, else the whole sets
  are compared.
* Links inside a group of many similar documents don't need all its pairs. First each document is compared with the
  documents that stand first in its columns, one for each column; what those links join is one group from then on.
  Then the product is taken over columns that hold documents of several groups, for pairs of different groups only.
  Every pair left out lies within one group, so no component is missed.

Defined results: A-Z are lower-cased; a null text, or one without words, has an empty set, is linked with nothing and
is its own component; a text of fewer words than n has one n-gram, its whole sequence; copies are one class; an empty
table gives no rows; a null id is a row with a null component, and links nothing, whatever its text; the rows of one id
are one document, whose text is the one of the least hash, and each of them gets that document's row. N-grams are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.components import components
from folioframe.llm.textkit import grams, mix, scan, signed, slices, whole
from folioframe.llm.wanted import of_wanted, one_text_each
from folioframe.operators.tables import stored

#: Counters for the columns' frequencies.
SKETCH_BITS = 19


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of p / q at least, in whole numbers."""

    p: int
    q: int

    @property
    def signature_words(self) -> int:
        """64-bit words of the bitmaps: enough to tell unlike sets of some hundred n-grams apart."""
        return 4 if 10 * self.p >= 9 * self.q else 8

    def kept(self, n: int) -> int:
        return n - -(-self.p * n // self.q) + 1

    def kept_column(self, n: Column) -> Column:
        return n - F.ceil(n * self.p / F.lit(self.q)) + 1

    def may_reach(self, overlap: Column, x: Column, y: Column) -> Column:
        most = overlap + F.greatest(x - self.kept_column(x), y - self.kept_column(y))
        return most * (self.p + self.q) >= (x + y) * self.p

    def signatures_fit(self, x: Column, y: Column, words: int, nx: Column, ny: Column) -> Column:
        """Sets that differ in d n-grams have parity bitmaps that differ in d bits at most."""
        differ = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(words)), F.lit(0))
        return differ * (self.p + self.q) <= (nx + ny) * (self.q - self.p)

    def sizes_fit(self, x: Column, y: Column) -> Column:
        return F.least(x, y) * self.q >= F.greatest(x, y) * self.p

    def reached(self, overlap: Column, x: Column, y: Column) -> Column:
        return overlap * self.q >= (x + y - overlap) * self.p


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's n-grams."""
    w = scan(data, offsets, lower=True)
    h, at = grams(w, k)
    cut = np.searchsorted(w.row[at], np.arange(len(offsets)))
    out = []
    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if a == b:
            out.append(np.array([whole(w, i)], np.uint64) if w.first[i] < w.first[i + 1] else np.zeros(0, np.uint64))
            continue
        s = np.sort(h[a:b])
        keep = np.ones(len(s), bool)
        keep[1:] = s[1:] != s[:-1]
        out.append(s[keep])
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))


def profile(rows: DataFrame, k: int, bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """Of each document its set's size and signature; and how often each of the counters was hit by all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hits = ["id", "n", "s1", "s2", "counter"], np.zeros(1 << bits, np.int64)
        for b, data, offsets in slices(batches):
            n, s1, s2, own = [], [], [], sets(data, offsets, k)
            hits += np.bincount((np.concatenate(own) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            for s in own:
                n.append(len(s)), s1.append(mix(s).sum(dtype=np.uint64)), s2.append(np.bitwise_xor.reduce(mix(s * np.uint64(0x9E3779B97F4A7C15))) if len(s) else np.uint64(0))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(signed(np.array(s1, np.uint64))), pa.array(signed(np.array(s2, np.uint64))), pa.array([False] * len(n))], names=names)
        at = np.flatnonzero(hits)
        for lo in range(0, len(at), 1 << 16):
            x = at[lo : lo + (1 << 16)]
            zero = pa.array(np.zeros(len(x), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(hits[x]), zero, zero, pa.array([True] * len(x))], names=names)

    both = stored(rows.mapInArrow(run, "id bigint, n bigint, s1 bigint, s2 bigint, counter boolean"), "profile")
    return both.where(~F.col("counter")).drop("counter"), both.where("counter").groupBy("id").agg(F.sum("n").alias("n"))


def parity(s: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of a set: each n-gram turns one bit over."""
    bits = np.bincount((mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def columns(rows: DataFrame, counters: np.ndarray, k: int, t: Threshold) -> DataFrame:
    """id, n, the kept columns of every document (its rarest first), how common these are, and its set's bitmap."""
    shift = np.uint64(64 - int(len(counters)).bit_length() + 1)
    shared, words = rows.sparkSession.sparkContext.broadcast(counters), t.signature_words  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches):
            kept, n, common, signature = [], [], [], []
            for s in sets(data, offsets, k):
                count = shared.value[(s >> shift).astype(np.int64)]
                order = np.argsort(count, kind="stable")[: t.kept(len(s)) if len(s) else 0]
                kept.append(signed(s[order])), n.append(len(s)), signature.append(parity(s, words))
                common.append(float(np.log(np.maximum(count[order], 1)).mean()) if len(s) else 0.0)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (kept, signature)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), lists[0], pa.array(common), lists[1]], names=["id", "n", "kept", "common", "signature"])

    return rows.mapInArrow(run, "id bigint, n bigint, kept array<bigint>, common double, signature array<bigint>")


def wanted_sets(rows: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and set of the documents in ids, and of a few others."""

    def of_slice(b: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array([signed(s) for s in sets(data, offsets, k)], pa.list_(pa.int64()))], names=["id", "set"])

    return of_wanted(rows, ids, of_slice, "id bigint, set array<bigint>")


def verified(pairs: DataFrame, rows: DataFrame, k: int, t: Threshold) -> DataFrame:
    """The pairs (a, b) that are links, after comparing their whole sets."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    found = stored(wanted_sets(rows, ids, k).join(ids, "id", "left_semi").dropDuplicates(["id"]), "sets")
    of = lambda c: found.select(F.col("id").alias(c), F.col("set").alias(f"{c}_set"))
    overlap = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(of("b"), "b").join(of("a"), "a").where(t.reached(overlap, F.size("a_set"), F.size("b_set"))).select("a", "b")


def first_pairs(kept: DataFrame, t: Threshold) -> DataFrame:
    """Each document with the one that it shares most columns with, among those that stand first in its columns. First
    stands the document whose columns are the most common: in a group of edited copies, the one with the least edits."""
    rank = F.col("common") + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 40)  # ties could only lose a guess
    post = kept.select(F.explode("kept").alias("c"), "id", "n", rank.alias("rank"))
    first = post.groupBy("c").agg(F.max_by("id", "rank").alias("b"), F.max_by("n", "rank").alias("bn"), F.count("*").alias("m")).where("m > 1").drop("m")
    first = stored(first, "first")  # a table of its own, so that adaptive execution can split a hot column in the join
    product = post.join(first, "c").where((F.col("id") != F.col("b")) & t.sizes_fit(F.col("n"), F.col("bn"))).groupBy("id", "n", "b", "bn").agg(F.count("*").alias("o"))
    best = product.where(t.may_reach(F.col("o"), F.col("n"), F.col("bn"))).groupBy("id").agg(F.max(F.struct("o", "b")).alias("x"))
    return best.select(F.col("id").alias("a"), F.col("x.b").alias("b"))


def cross_pairs(kept: DataFrame, labels: DataFrame, t: Threshold) -> DataFrame:
    """All pairs of different groups that may be links."""
    post = kept.join(labels, "id", "left").select("id", "n", F.coalesce("component", "id").alias("g"), F.explode("kept").alias("c"))
    mixed = post.groupBy("c").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("c")
    mixed = stored(mixed, "mixed-columns")
    post = stored(post.join(mixed, "c").join(kept.select("id", "signature"), "id"), "mixed")
    side = lambda s, c: post.select(F.col("c").alias(c), *(F.col(n).alias(f"{s}{n}") for n in ("id", "n", "g", "signature")))
    x, y = side("x", "c"), side("y", "yc")
    may = t.sizes_fit(F.col("xn"), F.col("yn")) & t.signatures_fit(F.col("xsignature"), F.col("ysignature"), t.signature_words, F.col("xn"), F.col("yn"))
    product = x.join(y, (F.col("c") == F.col("yc")) & (F.col("xg") < F.col("yg")) & may).groupBy("xid", "xn", "yid", "yn").agg(F.count("*").alias("o"))
    return product.where(t.may_reach(F.col("o"), F.col("xn"), F.col("yn"))).select(F.col("xid").alias("a"), F.col("yid").alias("b"))


def jaccard_groups(docs: DataFrame, k: int = 5, threshold: Threshold = Threshold(4, 5), id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """id, n_shingles (the set's size) and component_id (the smallest id that links reach) of every document. More
    sketch_bits (up to 24 or so: eight bytes for each counter are broadcast) tell frequent columns apart in a larger
    corpus; the result is the same."""
    t, every = threshold, _texts(docs, id_col, text_col)
    rows, repeated = one_text_each(every)
    of_doc, hits = profile(rows, k, sketch_bits)
    got = hits.toArrow()  # 2**sketch_bits rows at most
    counters = np.zeros(1 << sketch_bits, np.int64)
    counters[got["id"].to_numpy()] = got["n"].to_numpy()
    classes = stored(of_doc.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")), "classes")
    kept = stored(columns(rows, counters, k, t).join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "columns")
    links = stored(verified(stored(first_pairs(kept, t), "pairs"), rows, k, t), "links")
    labels = components(links)
    more = stored(verified(stored(cross_pairs(kept, labels, t), "pairs"), rows, k, t), "links")
    if more.limit(1).count():
        labels = components(links.union(more))
    group = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = of_doc.join(group, ["n", "s1", "s2"], "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    if repeated:
        out = every.select("id").where("id is not null").join(out.dropDuplicates(["id"]), "id").union(out.where("id is null"))
    return out.withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, k: int = 5, threshold: Threshold = Threshold(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the first of their group, with the columns they came with; of repeated ids the row whose
    text's hash is least. Rows with a null id belong to no group and stay."""
    groups = jaccard_groups(docs, k, threshold, id_col, text_col)
    # the ids to drop are the fewer; as a table their size is known, so a small one is broadcast and no text is shuffled
    gone = stored(groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct(), "gone")
    kept = docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
    if not one_text_each(_texts(docs, id_col, text_col))[1]:
        return kept
    named = kept.where(kept[id_col].isNotNull())
    one = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    named = named.withColumn("__row", F.row_number().over(one)).where("__row = 1").drop("__row")
    return named.unionByName(kept.where(kept[id_col].isNull()))
