"""Quality rules: a threshold table compiled into one projection of built-in SQL functions.

Every ratio is an expression over one text, so the whole operator is a map: no shuffle, no Python on the
executors, and a document of any length is judged from its whole text.

Defined results: a null text counts as the empty text (no word, so the length floor rejects it); repeated rows are
judged each for itself; other columns of the input may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and the characters that count as symbols.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it was on with as be by at this are or an from "
    "le la les de des du et en un une que qui dans pour est sur par pas au avec ce "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch "
    "el los las un una y en que del se por con para su al lo como o más"
).split()


@dataclass(frozen=True)
class Rule:
    """A metric of the text must lie within [low, high]; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production thresholds. The metrics are the columns of ``metrics``.
RULES = (
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", None, 0.10),
    Rule("stop_word_ratio", "n_stop_words / greatest(n_words, 1)", 0.06, None),
    Rule("duplicate_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.50),
    Rule("words_per_line", "n_words / greatest(n_lines, 1)", 3.0, None),
)


def let(value: Column, body) -> Column:
    """Evaluates value once and binds it in body: an array passed into a lambda by name would be built for each element."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1))


def _repeated_words(w: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more.

    Windows are first sorted as longs of 33 hash bits over 31 position bits. Equal neighbours are candidates only:
    their words are then compared themselves, so a hash collision costs time and never changes the count.
    """

    def packed(w: Column) -> Column:
        at = lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), 31).bitwiseOR(i.cast("long"))
        return F.sort_array(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), at))

    same = lambda s, x, j: F.coalesce(F.shiftright(F.get(s, j), 31) == F.shiftright(x, 31), F.lit(False))
    twins = lambda s: F.filter(s, lambda x, i: same(s, x, i + 1) | same(s, x, i - 1))

    def exact(w: Column, c: Column) -> Column:
        pos = lambda x: x.bitwiseAND(F.lit(2**31 - 1)).cast("int")
        rows = F.sort_array(F.transform(c, lambda x: F.struct(F.get(w, pos(x)).alias("a"), F.get(w, pos(x) + 1).alias("b"), F.get(w, pos(x) + 2).alias("c"), pos(x).alias("p"))))
        eq = lambda r, x, j: F.coalesce((F.get(r, j)["a"] == x["a"]) & (F.get(r, j)["b"] == x["b"]) & (F.get(r, j)["c"] == x["c"]), F.lit(False))
        return let(rows, lambda r: F.sort_array(F.transform(F.filter(r, lambda x, i: eq(r, x, i + 1) | eq(r, x, i - 1)), lambda x: x["p"])))

    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    return let(let(packed(w), twins), lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(let(exact(w, c), covered)))


def metrics(text: Column) -> dict[str, Column]:
    """Every count the rules use, as columns over the whole text; all are long."""
    t = F.coalesce(text, F.lit(""))
    stops = [x for w in STOP_WORDS for x in (w, w.capitalize())]
    by_word = let(
        _words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(*stops))).cast("long").alias("n_stop_words"),
        ),
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "by_word": by_word,
        "by_line": by_line,
        "word_chars": F.length(F.translate(t, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
    }


def compile_rules(rules: Sequence[Rule]) -> dict[str, Column]:
    """One boolean column for each rule: whether the text breaks it."""
    out = {}
    for r in rules:
        x = F.expr(f"CAST({r.metric} AS DOUBLE)")
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (x < F.lit(float(r.low)))
        if r.high is not None:
            broken = broken | (x > F.lit(float(r.high)))
        out[r.name] = broken
    return out


def _judged(docs: DataFrame, text_col: str, rules: Sequence[Rule], min_words: int, max_repeat: float) -> DataFrame:
    """The input's row as a struct, so that no name of it can clash, and beside it counts, broken rules and verdict."""
    m = metrics(docs[text_col])
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row")
    # out of a generator the counts come once; a filter on the verdict would else count anew for each use of a count
    counted = docs.select(row, F.explode(F.array(F.struct(*(c.alias(n) for n, c in m.items())))).alias("m"))
    flat = counted.select("_row", "m.by_word.n_words", "m.word_chars", "m.n_symbols", "m.by_line.n_dup_lines", "m.by_word.n_repeat_words", "m.by_word.n_stop_words", "m.by_line.n_lines")
    broken = compile_rules(rules)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    listed = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in broken.items())), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")
    return flat.select("*", failed.alias("base_failed"), listed.alias("broken_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """id, counts, verdict and the names of the broken rules of every document."""
    judged = _judged(docs, text_col, rules, min_words, max_repeat)
    return judged.select(F.col(f"_row.`{id_col}`").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "broken_rules")


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """The documents the rules keep, with the columns they came with."""
    return _judged(docs, text_col, rules, min_words, max_repeat).where("kept").select("_row.*")
