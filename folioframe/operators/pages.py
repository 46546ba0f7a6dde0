"""Texts of pages and transcripts: what may be trusted, what repeats, what a placeholder is."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text
from folioframe.functions.kinds import kind
from folioframe.operators.markdown import is_separator, lines_of, table_cells

_LETTER, _ALNUM = r"\p{IsAlphabetic}", r"\p{IsAlphabetic}\p{N}"
_BAD = r"\x{FFFD}\p{Cc}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}"
#: Letters that make a word sound, without their tones.
VOWELS = "aeiouy"


def _count(x: Column, pattern: str) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, f"[{pattern}]", ""))


def is_trustworthy(x: Column) -> Column:
    """Whether a page's own text reads like text: enough letters, few broken signs, no glyph codes, real words."""
    solid = F.regexp_replace(x, r"\s", "")
    n, letters, bad = F.length(solid), _count(solid, _ALNUM), _count(solid, _BAD)
    words = F.size(F.filter(text.words(x), lambda w: _count(w, _LETTER) >= 2))
    codes = F.lower(x).rlike(r"\(cid:|/gid|<gid|uni\+")
    return (n >= 80) & (letters >= 40) & (bad * 200 <= n) & ~codes & (words >= 8) & (letters * 100 >= n * 20)


def is_high_confidence(x: Column) -> Column:
    """A stricter gate for pages that were reported garbled: most words have vowels, few runs of one letter."""
    words = F.filter(text.words(x), lambda w: _count(w, _LETTER) >= 2)
    sound = F.filter(words, lambda w: text.accent_fold(w).rlike(f"[{VOWELS}]"))
    runs = F.regexp_count(F.lower(x), F.lit(rf"([{_ALNUM}])\1{{3,}}"))
    return is_trustworthy(x) & (_count(x, _LETTER) >= 250) & (F.size(words) >= 40) & (F.size(sound) * 100 >= F.size(words) * 70) & (runs <= 3)


def covers(native: Column, markdown: Column, share: float = 0.9) -> Column:
    """Whether a page's own text has most of the words of its Markdown, each counted twice at most."""

    def twice(x: Column) -> Column:
        """The words, the second of equal ones told apart from the first, and no further ones."""
        words = F.array_sort(F.filter(F.split(F.lower(x), f"[^{_ALNUM}]+"), lambda t: t != ""))
        named = lambda s: F.transform(s, lambda w, i: F.concat(w, F.when(F.get(s, i - 1) == w, "+2").otherwise("+1")))
        return F.array_distinct(F.transform(F.array(words), named)[0])

    compared = lambda p: (F.size(p["want"]) == 0) | (F.size(F.array_intersect(p["want"], p["have"])) >= share * F.size(p["want"]))
    return F.transform(F.array(F.struct(twice(native).alias("have"), twice(markdown).alias("want"))), compared)[0]


def has_malformed_table(md: str) -> bool:
    """A separator whose header is too narrow, of another width or with gaps, or rows of another width after it."""
    lines = lines_of(md)
    for i in range(len(lines) - 1):
        head, sep = table_cells(lines[i]), table_cells(lines[i + 1])
        if head is None or sep is None or not is_separator(sep):
            continue
        gaps, joined = sum(not c for c in head), " ".join(head).lower()
        if len(head) < 2 or len(head) != len(sep) or gaps >= 2 or (gaps and any(k in joined for k in ("mã hiệu", "lần ban hành", "ngày hiệu lực"))):
            return True
        for line in lines[i + 2 :]:
            if not line.strip().startswith("|"):
                break
            if len(table_cells(line) or []) != len(head):
                return True
    return False


def margin_line(x: Column) -> Column:
    """A line as margins compare it: heading marks stay, emphasis goes, 8 to 400 signs; null if it can't be one."""
    t = F.trim(x)
    mark = F.regexp_extract(t, r"^(#{1,6})(?:\s|$)", 1)
    body = F.lower(F.array_join(text.words(F.regexp_replace(F.when(mark != "", F.regexp_replace(t, r"^#{1,6}\s*", "")).otherwise(t), "[*_`]", "")), " "))
    table = t.startswith("|") | t.startswith("```")
    return F.when(~table & F.length(body).between(8, 400), F.when(mark != "", F.concat_ws(" ", mark, body)).otherwise(body))


def without_margins(pages: DataFrame, document: str, page: str, body: str) -> DataFrame:
    """Pages without the lines at their top (five) and bottom (three) that most pages of the document share: at least
    three, and three fifths of four pages or more."""
    lines = pages.select(document, page, F.posexplode(F.split(body, r"\r?\n")).alias("at", "line")).where("trim(line) <> ''")
    spots = lines.groupBy(document, page).agg(F.array_sort(F.collect_list("at")).alias("ats"))  # a page's own lines
    edge = F.array_union(F.slice("ats", 1, 5), F.slice("ats", F.greatest(F.size("ats") - 2, F.lit(1)), F.lit(3)))
    marked = lines.join(spots.select(document, page, F.explode(edge).alias("at")), [document, page, "at"]).withColumn("key", margin_line(F.col("line"))).where("key is not null")
    n = pages.groupBy(document).agg(F.count("*").alias("pages")).where("pages >= 4")
    often = marked.groupBy(document, "key").agg(F.countDistinct(page).alias("on")).join(n, document).where(F.col("on") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 3 / 5)))
    gone = marked.join(often.select(document, "key"), [document, "key"]).groupBy(document, page).agg(F.collect_set("at").alias("gone"))
    joined = pages.join(gone, [document, page], "left")
    kept = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x, i: F.when(~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i), x)), lambda x: x.isNotNull())
    return joined.withColumn(body, F.array_join(kept, "\n")).select(*pages.columns)


#: Transcripts that mean there was no speech.
NO_SPEECH = ("music", "silence", "no speech", "applause", "background music", "nhạc", "im lặng")


def is_speech(x: Column, no_speech: Column, threshold: float) -> Column:
    """Whether a segment of a transcript is speech."""
    t = F.trim(x)
    enclosed = t.rlike(r"^(\[[\s\S]*\]|\([\s\S]*\))$") & (F.length(t) <= 120)
    marker = F.lower(F.regexp_replace(t, r"^[\[\]()♪ ]+|[\[\]()♪ ]+$", ""))
    return (t != "") & (no_speech < threshold) & ~enclosed & ~marker.isin(*NO_SPEECH)


def pending_artifacts(x: Column, opening: str = "<!-- OCR_PENDING:", closing: str = " -->") -> Column:
    """Names in the placeholders for pages still to be read, each once."""
    found = F.regexp_extract_all(x, F.lit(f"{re.escape(opening)}([A-Za-z0-9._-]+){re.escape(closing)}"), F.lit(1))
    return F.array_distinct(found)


def without_fence(x: Column) -> Column:
    """What a fence around the whole text holds, or the text."""
    t = F.trim(x)
    inner = F.regexp_extract(t, r"^```[^\n]*\n([\s\S]*)```\s*$", 1)
    return F.when(t.rlike(r"^```[^\n]*\n[\s\S]*```\s*$"), F.trim(F.regexp_replace(inner, r"^\s+|\s+$", ""))).otherwise(t)


def answer_pieces(answer: str, most: int = 48) -> list[str]:
    """Words of an answer in pieces of at most so many bytes; a longer word is a piece of its own."""
    out, now, size = [], [], 0
    for w in answer.split():
        n = len(w.encode())
        if now and size + n + 1 > most:
            out.append(" ".join(now))
            now, size = [], 0
        size += n + bool(now)
        now.append(w)
    return [*out, " ".join(now)] if now or not out else out


@F.pandas_udf(kind("array<string>"))
def pieces(x: pd.Series) -> pd.Series:
    return x.map(lambda t: answer_pieces(t or ""))


def source_anchor(format_: Column, heading: Column) -> Column:
    """The slide or sheet that a heading names."""
    slide = F.regexp_extract(text.accent_fold(heading), r"^[\s\S]*?slide (\d+)(?:\s|$)", 1)
    sheet = F.element_at(F.split(heading, " > "), -1)
    return F.struct(F.when(slide != "", slide.cast("int")).alias("slide"), F.when((format_ == "xlsx") & (sheet != ""), sheet).alias("sheet"))


def verified_quote(markdown: str, chunk: str, chunk_start: int, local: tuple[int, int], source: tuple[int, int], quote: str) -> bool:
    """Whether a quote stands in its chunk, and there in its document too, where a line may end in CR LF; places count
    characters."""
    a, b = local
    if not 0 <= a < b <= len(chunk) or chunk[a:b] != quote:
        return False
    at = []  # for each character of the chunk, its place in the document
    i = chunk_start
    for c in chunk:
        if c == "\n" and markdown.startswith("\r\n", i):
            at.append(i)
            i += 2
        elif i < len(markdown) and markdown[i] == c:
            at.append(i)
            i += 1
        else:
            return False
    return (at[a], at[b] if b < len(at) else i) == tuple(source)


def corpus_issues(family: Column, size: Column, markdown: Column) -> Column:
    """What a conversion's result shows, by family: codes with their severity."""
    n, low = F.length(markdown), F.lower(markdown)
    checks = [
        (F.contains(markdown, F.lit("\ufffd")), "error:replacement"),
        ((family == "pdf") & (n < 500), "error:short"),
        ((family == "docx") & (size > 20000) & (n == 0), "warning:no_text"),
        ((family == "pptx") & (n == 0), "info:no_text"),
        ((family == "spreadsheet") & (n == 0), "warning:no_cells"),
        ((family == "csv") & (n > 0) & ~F.contains(markdown, F.lit("|")), "error:no_table"),
        ((family == "html") & low.rlike("<script|<style"), "error:script"),
        ((family == "html") & (n > size * 8), "warning:expanded"),
        ((family == "image") & (n == 0), "info:no_text"),
        ((family == "audio") & (n > 500), "warning:hallucination"),
        ((family == "audio") & n.between(1, 500), "info:transcript"),
        ((family == "text") & ~(n / F.greatest(size, F.lit(1))).between(0.85, 1.2), "warning:size"),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in checks)), lambda x: x.isNotNull())


def word_error_rate(reference: str, other: str) -> float:
    """Edits of words for each of the reference's."""
    a, b = ([w for w in x.split(" ") if w] for x in (reference, other))
    if not a:
        return float(bool(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] / len(a)


@F.pandas_udf(kind("double"))
def wer(reference: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([word_error_rate(a or "", b or "") for a, b in zip(reference, other)])
