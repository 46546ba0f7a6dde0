"""Secret scans: three fixed patterns, and a guess-cost estimate for the values that stand in a credential's context.

The estimate is the cheapest way to guess a value piece by piece: dynamic programming over its characters picks the
segmentation into known words, dates, repeats, keyboard walks and brute force whose guesses multiply to the least; each
further segment doubles them. Words cost their rank in a list that the caller gives (see ranked_words). A value in a
credential's context that takes 10**MIN_COST guesses or more is a span of its own, unless it overlaps a span of the
fixed patterns. A context is a credential's name in one of four languages with a sign behind it (colon, equals sign,
arrow); with a space or "is" only, text may just go on, so there it is none for a value that can be read as words.

Defined results: a null text counts as empty and has no spans; every text is scanned whole; values of any length cost
time in proportion to their length. Of a walk or repeat, segments are all stretches of at most SUBRUN characters, and
longer ones that begin or end with it. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.textkit import replace_texts, slices

#: The base kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: The added kind: names that announce a credential, what stands between name and value, and the value.
NAMES = (
    r"pwd|pass(?:word|wd|phrase|code|wort)?|secret|token|api[_-]?key|auth(?:orization)?|bearer|credentials?|private[_-]?key|access[_-]?key|login"
    r"|kennwort|zugangscode|geheimcode|mot\x20de\x20passe|mdp|jeton|code\x20secret|cl[e\u00e9]\x20(?:api|secr[e\u00e8]te)|contrase[n\u00f1\u00d1]a|clave"
)
CONTEXT = re.compile(rf"""(?<![A-Za-z0-9])(?i:{NAMES})["']?(?:\x20?([:=]|=>|->)\x20?|\x20(?:is\x20)?)["']?([^\s"'<>,;]{{6,}})""", re.A)
CONTEXT_WORDS = ("pwd", "pass", "secret", "token", "key", "auth", "bearer", "credential", "login", "kennwort", "zugangscode", "geheimcode", "mdp", "jeton", "cl\u00e9", "cle", "contrase", "clave")
#: No context is longer, with what stands between it and its value.
CONTEXT_MOST = 24
MIN_COST = 8.0

#: What words are made of and joined by.
JOINED = re.compile(r"[-/'’._:&()\[\]{}*`|?!=…–—]+")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]{6}", re.I)
VOWEL = re.compile(r"[aeiouy]", re.I)

#: Frequent passwords and words of passwords, most frequent first.
COMMON = (
    "password 123456 qwerty abc123 letmein monkey dragon iloveyou admin welcome login master hello freedom whatever "
    "trustno1 secret shadow sunshine princess football baseball superman batman michael jordan hunter ranger buster "
    "soccer hockey killer george charlie andrew thomas summer winter spring autumn love money test user guest root pass "
    "default changeme example token key house computer internet security private public service server data base the and "
    "for you with this that from have not are was your home work school happy blue green black white red orange yellow"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LEET = str.maketrans("@4301!57$", "aaeoiists")
KEYS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz")
NEXT = {(a, b) for row in KEYS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}
DATE = re.compile(r"(?:19|20)\d\d([-./_]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-./_]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
#: Longest word looked up, and longest stretch of a walk or repeat that neither begins nor ends with it.
LONGEST_WORD = 24
SUBRUN = 64
PERIODS = 4
_SEGMENT = math.log10(2)  # each further segment doubles the ways to cut


def ranked_words(word_vocabulary: str, byte_ranks: Sequence[str] = (), least: int = 3) -> list[str]:
    """The whole words of public vocabularies, most frequent first, behind COMMON: of a word-end BPE's JSON file, and of
    byte-level rank files, whose words begin with a space. Read on the driver; a vocabulary is of fixed size."""
    rank: dict[str, int] = {}
    with open(word_vocabulary, encoding="utf-8") as f:
        found = [(t.removesuffix("</w>"), i) for t, i in json.load(f)["model"]["vocab"].items() if t.endswith("</w>")]
    for path in byte_ranks:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        tokens = [(base64.b64decode(t).decode("utf-8", "replace"), int(i)) for t, i in pairs]
        found += [(t[1:].lower(), i) for t, i in tokens if t.startswith(" ")]
    for word, i in found:
        if len(word) >= least and word.isalpha():
            rank[word] = min(i, rank.get(word, i))
    return [*COMMON, *(w for w in sorted(rank, key=lambda w: (rank[w], w)) if w not in RANK)]


def ranks_of(words: Sequence[str]) -> dict[str, int]:
    return {w: i + 1 for i, w in reversed(list(enumerate(words)))}


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def _fixed_segments(value: str, low: str, rank: Mapping[str, int]) -> dict[int, list[tuple[int, float]]]:
    """Words and dates in value, by their end: where they begin and what they cost."""
    n, plain = len(value), low.translate(LEET)
    out: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            r, changed = rank.get(low[i:j]), 0.0
            if r is None and (r := rank.get(plain[i:j])) is not None:
                changed = math.log10(2) * sum(a != b for a, b in zip(low[i:j], plain[i:j]))
            if r is not None:
                upper = sum(c.isupper() for c in value[i:j])
                changed += 0 if not upper else math.log10(2) if upper in (1, j - i) else math.log10(2) * min(upper, j - i - upper)
                out.setdefault(j, []).append((i, math.log10(r + 1) + changed))
        if value[i].isdigit() and (m := DATE.match(value, i)):
            out.setdefault(m.end(), []).append((i, math.log10(120 if m.end() - i == 4 else 365 * 120)))
    return out


def guess_cost(value: str, rank: Mapping[str, int] = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    if not n:
        return 0.0
    fixed = _fixed_segments(value, low, rank)
    each = [_brute(c) for c in value]
    upto = [0.0]
    for x in each:
        upto.append(upto[-1] + x)
    other, forced = [0.0] * (n + 1), [math.inf] * (n + 1)  # the cheapest ways that end in a known segment, and in brute force
    best = [0.0] * (n + 1)
    walk, repeat = 0, [0] * (PERIODS + 1)  # where those that reach the place begin
    for j in range(1, n + 1):
        forced[j] = each[j - 1] + min(forced[j - 1], other[j - 1] + (_SEGMENT if j > 1 else 0.0))
        cheapest = math.inf
        for i, cost in fixed.get(j, ()):
            cheapest = min(cheapest, best[i] + cost + (_SEGMENT if i else 0.0))
        if j > 1 and (low[j - 2], low[j - 1]) not in NEXT:
            walk = j - 1
        if j - walk >= 3:
            ends = j == n or (low[j - 1], low[j]) not in NEXT
            for i in {walk, *range(walk if ends else max(walk, j - SUBRUN), j - 2)}:
                cheapest = min(cheapest, best[i] + math.log10(40 * (j - i)) + (_SEGMENT if i else 0.0))
        for p in range(1, PERIODS + 1):
            if j > p and value[j - 1] != value[j - 1 - p]:
                repeat[p] = j - p
            begin, most = repeat[p], j - max(3, 2 * p)
            if begin <= most:
                ends = j == n or value[j] != value[j - p]
                for i in {begin, *range(begin if ends else max(begin, j - SUBRUN), most + 1)}:
                    cheapest = min(cheapest, best[i] + upto[i + p] - upto[i] + math.log10((j - i) / p + 1) + (_SEGMENT if i else 0.0))
        other[j] = cheapest
        best[j] = min(cheapest, forced[j])
    return best[n]


def plain_words(value: str) -> int:
    """How many words value can be read as, if it is nothing else; otherwise 0. What can be spoken is a word."""
    n = 0
    for part in JOINED.split(value):
        if not part.isascii() and part.isalpha():
            n += 1
            continue
        words = CAMEL.findall(part)
        if "".join(words) != part or (len(words) > 1 and min(map(len, words)) < 3):
            return 0
        if any(len(w) > 2 and (CONSONANTS.search(w) or not VOWEL.search(w)) for w in words):
            return 0
        n += len(words)
    return n


def scan_text(text: str, may_hex: bool = True, min_cost: float = MIN_COST, rank: Mapping[str, int] = RANK) -> list[tuple[str, int, int, float | None]]:
    """All spans by start, then kind: (kind, start, end, cost). may_hex: whether the text can hold a hex secret at all."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if may_hex:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    base = sorted(found)
    spans = [(KINDS[k], a, b, None) for a, k, b in base]
    if any(w in low for w in CONTEXT_WORDS):
        taken, at = base, 0
        ends = np.maximum.accumulate([b for _, _, b in taken]) if taken else []
        starts = [a for a, _, _ in taken]
        pos = 0
        while m := CONTEXT.search(text, pos):
            a, b = m.span(2)
            pos = a  # a value that is none can be the context of the next
            while b > a and text[b - 1] in ".!?)]}":  # closes the sentence, not the value
                b -= 1
            at = int(np.searchsorted(starts, b, "left")) if starts else 0
            if at and ends[at - 1] > a:
                pos = max(a, int(ends[at - 1]) - CONTEXT_MOST)  # before that, no context has its value behind the span
                continue
            if b - a < 6:
                continue
            if m[1] is None and plain_words(text[a:b]):
                continue
            if (cost := guess_cost(text[a:b], rank)) >= min_cost:
                spans.append(("guess", a, b, cost))
                pos = b
        spans.sort(key=lambda s: (s[1], (*KINDS, "guess").index(s[0])))
    return spans


def _hex_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold a run of hex digits long enough."""
    digit = np.zeros(256, bool)
    digit[[*range(48, 58), *range(97, 103)]] = True
    stop = np.concatenate([[-1], np.flatnonzero(~digit[data]), [len(data)]])
    runs = stop[:-1][np.diff(stop) > HEX_LEAST] + 1
    out = np.zeros(len(offsets) - 1, bool)
    if len(runs):
        last = stop[1:][np.diff(stop) > HEX_LEAST]
        for a, b in zip(np.searchsorted(offsets, runs, "right") - 1, np.searchsorted(offsets, last, "left")):
            out[a:b] = True
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = MIN_COST, words: Sequence[str] = COMMON) -> DataFrame:
    """id and spans: array of (kind, start, end, cost), by start, then kind. words: known ones, most frequent first."""
    shared = docs.sparkSession.sparkContext.broadcast(list(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks_of(shared.value)
        for b, data, offsets in slices(batches):
            texts = b.column("text").to_pylist()
            spans = [[dict(zip(("kind", "start", "end", "cost"), s)) for s in scan_text(t or "", h, min_cost, rank)] for t, h in zip(texts, _hex_rows(data, offsets))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, _SPANS)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,cost:double>>").withColumnRenamed("id", id_col)


def redact_text(text: str, spans: list[tuple[str, int, int, float | None]], mark: str) -> str:
    """Every stretch that spans cover becomes one mark."""
    out, at = [], 0
    for _, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]", min_cost: float = MIN_COST, words: Sequence[str] = COMMON) -> DataFrame:
    """The rows as they came, with the secrets in their texts replaced; a null text stays null; length_col, if it is a
    column, is the new text's length."""
    shared = docs.sparkSession.sparkContext.broadcast(list(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks_of(shared.value)
        for b, data, offsets in slices(batches, text_col):
            texts = b.column(text_col).to_pylist()
            new = [t and redact_text(t, scan_text(t, h, min_cost, rank), mark) for t, h in zip(texts, _hex_rows(data, offsets))]
            yield replace_texts(b, text_col, length_col, new)

    return docs.mapInArrow(run, docs.schema)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts and checksums of what find_secrets has found."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    rest = [c for c in found.columns if c != "spans"]
    return found.select(*rest, *map(count, KINDS), F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
