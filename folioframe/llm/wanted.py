"""Work on the texts of some documents only, without shuffling any text; and one text for each id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.textkit import slices
from folioframe.operators.tables import stored

#: Bits of the bitmap that tells which documents are wanted.
FILTER_BITS = 22


def of_wanted(rows: DataFrame, ids: DataFrame, of_slice: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What of_slice makes of the rows (id, text) whose id is in ids, and of a few others that share a bit with one.

    A bitmap of fixed size over hashes of the ids goes to every executor, so neither ids nor texts are shuffled. When
    there are too many ids for the bitmap it lets more rows pass; an exact join on the result drops them.
    """
    bucket = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    bits = ids.select(bucket.alias("x")).groupBy(F.shiftright("x", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 31 as int)))").alias("bits"))
    got = bits.toArrow()  # 2**(FILTER_BITS - 5) rows at most
    table = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def picked() -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("x").to_numpy(zero_copy_only=False)
                yield b.filter(pa.array((shared.value[x >> 5] >> (x & 31)) & 1 == 1))

        for b, data, offsets in slices(picked()):
            yield of_slice(b, data, offsets)

    return rows.where("id is not null").withColumn("x", bucket).mapInArrow(run, schema)


def one_text_each(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The rows (id, text) with one text for each id, the one of the least hash; and whether any id was repeated. Rows of
    equal id and text all stay, and so do those without an id. Without repeated ids nothing but ids is shuffled."""
    many = stored(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if not many.limit(1).count():
        return rows, False
    own = rows.withColumn("h", F.xxhash64("text"))
    least = stored(own.join(many, "id", "left_semi").groupBy("id").agg(F.min("h").alias("least")), "chosen")
    return own.join(least, "id", "left").where("least is null or h = least").select("id", "text"), True
