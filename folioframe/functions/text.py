"""Text functions as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = "\u0300-\u036f"


def _fold_table() -> tuple[str, str]:
    """Every character that folds to one other: its canonical decomposition without the marks U+0300 to U+036F."""
    source, target = ["đ", "Đ"], ["d", "D"]
    for code in range(0xC0, 0x10000):
        c = chr(code)
        if "\u0300" <= c <= "\u036f" or 0xD800 <= code < 0xE000:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f").translate({0x111: "d", 0x110: "D"})
        if len(plain) == 1 and plain != c and c not in "đĐ":
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target)


_SOURCE, _TARGET = _fold_table()


def accent_fold(x: Column) -> Column:
    """Without accents, đ as d, in lower case. Hangul syllables stay composed."""
    return F.lower(F.translate(F.regexp_replace(x, f"[{MARKS}]", ""), _SOURCE, _TARGET))


def tokens(x: Column, least: int = 2) -> Column:
    """Folded words of two characters or more."""
    return F.filter(F.split(accent_fold(x), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.length(t) >= least)


def content_terms(x: Column, stop_words: tuple[str, ...]) -> Column:
    """Tokens of a question without its stop words, or all of them when nothing else is in it."""
    return _unless_empty(tokens(x), lambda all_: F.filter(all_, lambda t: ~t.isin(*stop_words)))


def _unless_empty(value: Column, body) -> Column:
    return F.transform(F.array(value), lambda v: F.when(F.size(body(v)) > 0, body(v)).otherwise(v))[0]


def prefix_query(x: Column) -> Column:
    """The folded tokens as a disjunction of prefixes."""
    return F.array_join(F.transform(tokens(x), lambda t: F.concat(F.lit('"'), t, F.lit('"*'))), " OR ")


def words(x: Column) -> Column:
    """Words between white space, none of them empty."""
    return F.filter(F.split(x, r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"), lambda w: w != "")


def snippet(x: Column, n: int = 58) -> Column:
    """The first words."""
    return F.array_join(F.slice(words(x), 1, n), " ")


def snippet_window(x: Column, query_tokens: Column, before: int = 12, n: int = 56) -> Column:
    """Words around the first that contains a token of the query."""
    at = lambda w: F.array_position(F.transform(w, lambda y: F.exists(query_tokens, lambda t: F.contains(accent_fold(y), t))), True)
    return F.transform(F.array(words(x)), lambda w: F.array_join(F.slice(w, F.greatest(at(w) - before, F.lit(1)).cast("int"), F.lit(n)), " "))[0]


def snippet_chars(x: Column, query_tokens: Column, before: int = 40, n: int = 240) -> Column:
    """At most n characters from a little before the first hit. Unlike a byte offset into the folded text, the position
    counts characters of the text without marks, which is where the hit stands."""
    first = F.array_min(F.filter(F.transform(query_tokens, lambda t: F.instr(accent_fold(x), t)), lambda p: p > 0))
    return F.substring(x, F.greatest(F.coalesce(first, F.lit(1)) - before, F.lit(1)), F.lit(n))


def title(markdown: Column, stem: Column, most: int = 240) -> Column:
    """The first heading of level 1 to 6, or else the file's stem."""
    heading = F.trim(F.regexp_extract(markdown, r"(?m)^[ \t]*#{1,6} +([^\n]*\S)[ \t]*\r?$", 1))
    return F.when(heading != "", F.left(heading, F.lit(most))).otherwise(stem)


def truncated(x: Column, most: int, trailer: str = "\n\n<!-- truncated -->") -> Column:
    """The first characters, and a comment if any are missing."""
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit(trailer))).otherwise(x)


def lf(x: Column) -> Column:
    """CR LF as LF; a lone CR stays."""
    return F.replace(x, F.lit("\r\n"), F.lit("\n"))


def repeated_run(x: Column, n: int = 5) -> Column:
    """Whether a letter or digit stands n times or more in a row."""
    return x.rlike(rf"([\p{{IsAlphabetic}}\p{{N}}])\1{{{n - 1}}}")


def slug(x: Column) -> Column:
    """ASCII letters and digits in lower case, everything else one dash."""
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"[^A-Za-z0-9]+", "-")), r"^-+|-+$", "")


def folded_slug(x: Column) -> Column:
    """The slug of a title without its accents."""
    return slug(accent_fold(x))


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def table_cell(x: Column) -> Column:
    """A cell of a Markdown table."""
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, table_cell), "|"), F.lit("|\n"))


def markdown_table(rows: Column) -> Column:
    """A Markdown table of rows of cells, the first its header; as wide as the header."""
    width = F.size(F.get(rows, F.lit(0)))
    fit = lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(r, i), F.lit("")))
    body = F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: table_row(fit(r))), "")
    made = F.concat(table_row(fit(F.get(rows, F.lit(0)))), F.lit("|"), F.repeat(F.lit("---|"), width), F.lit("\n"), body)
    return F.when((F.size(rows) > 0) & (width > 0), made).otherwise("")


def csv_guard(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(cell.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def glob_matches(name: Column, pattern: str) -> Column:
    """Whether a file name fits a pattern of * and ?, letters in either case."""
    out = "".join(".*" if c == "*" else "." if c == "?" else "".join(f"\\{x}" if not x.isalnum() else x for x in c) for c in pattern)
    return name.rlike(f"(?is)^{out}$")


def hidden_or_temporary(name: Column) -> Column:
    """Names of hidden files and of office lock, swap and part files."""
    return name.rlike(r"(?i)^(\.|~\$)|(\.tmp|\.temp|\.part|\.crdownload|\.swp|~)$")


def marker_only(x: Column) -> Column:
    """Whether a chunk holds page comments only."""
    return F.forall(F.split(x, "\n"), lambda y: F.trim(y).rlike(r"^$|^<!-- Trang .* \(OCR\) -->$|^<!-- Page .* -->$"))


def untrusted(x: Column) -> Column:
    """Text that may stand inside a prompt's data block: it can't close the block or open another."""
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def normalised_content(x: Column) -> Column:
    """Content as error rates compare it: no separator lines of tables, no bars, no words of # or - alone, single
    blanks; case and accents stay."""
    kept = F.filter(F.split(x, r"\r?\n"), lambda line: ~F.trim(line).rlike(r"^[|\-: ]+$"))
    plain = words(F.replace(F.array_join(kept, " "), F.lit("|"), F.lit(" ")))
    return F.array_join(F.filter(plain, lambda w: ~w.rlike("^[#-]+$")), " ")


def char_error_rate(reference: Column, other: Column) -> Column:
    """Edits of characters for each of the reference's; an empty reference is right only with an empty other."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(other) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(reference, other) / n)
