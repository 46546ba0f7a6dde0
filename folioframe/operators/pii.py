"""Personal data: e-mail addresses, Vietnamese phone numbers, bank accounts and national ids."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions.kinds import kind
from folioframe.functions.vectors import fold
from folioframe.operators.markdown import parse_tables, table_cells

_LOCAL, _DOMAIN = r"[A-Za-z0-9!#$%&'*+/=?^_`{}~.-]", r"[A-Za-z0-9.-]"
_CANDIDATE = re.compile(f"({_LOCAL}+)@({_DOMAIN}+)")
_ADDRESS = re.compile(r"(?!\.)(?:[A-Za-z0-9!#$%&'*+/=?^_`{}~-]+\.)*[A-Za-z0-9!#$%&'*+/=?^_`{}~-]+@(?:(?!-)(?=[0-9-]*[A-Za-z])[A-Za-z0-9-]+(?<!-)\.)+[A-Za-z]{2,}")
_EDGE = re.compile(r"[\s()<>\[\]:;,.\"'|{}/\\!?]")
_WRAPPERS = ("***", "**", "~~", "__", "`", "*", "_")


def _peeled(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The address inside pairs of Markdown marks around it; None if no pair closes around an address."""
    while end < len(text) and text[end] in "*_~`":
        end += 1
    peeled = False
    while mark := next((m for m in _WRAPPERS if end - start > 2 * len(m) + 2 and text.startswith(m, start) and text.endswith(m, start, end)), None):
        start, end, peeled = start + len(mark), end - len(mark), True
    return (start, end) if peeled and _ADDRESS.fullmatch(text, start, end) else None


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of addresses whose both sides are delimiters, without their Markdown wrappers."""
    out: list[tuple[int, int]] = []
    if "@" not in text:
        return out
    at = 0
    while m := _CANDIDATE.search(text, at):
        start, end = m.span()
        at = m.start(2)
        while text[end - 1] == ".":
            end -= 1
        if end <= at or not _ADDRESS.fullmatch(text, start, end):
            continue
        found = _peeled(text, start, end)
        if found is None and (start == 0 or _EDGE.match(text[start - 1])) and (end == len(text) or _EDGE.match(text[end])):
            found = start, end
        if found:
            out.append(found)
            at = found[1]
    return out


#: Prefixes of mobile numbers, and area codes with eight and with seven digits after them.
MOBILE = (
    "032 033 034 035 036 037 038 039 052 055 056 058 059 070 076 077 078 079 081 082 083 084 085 086 087 088 089 "
    "090 091 092 093 094 096 097 098 099"
).split()
AREA_TWO = "24 28".split()
AREA_THREE = (
    "203 204 205 206 207 208 209 210 211 212 213 214 215 216 218 219 220 221 222 225 226 227 228 229 232 233 234 235 236 237 238 239 "
    "251 252 254 255 256 257 258 259 260 261 262 263 269 270 271 272 273 274 275 276 277 290 291 292 293 294 296 297 299"
).split()
_NATIONAL = re.compile(f"(?:{'|'.join(MOBILE)})[0-9]{{7}}|0(?:{'|'.join(AREA_TWO)})[0-9]{{8}}|0(?:{'|'.join(AREA_THREE)})[0-9]{{7}}")
_GROUP = re.compile(r"[+(]?[0-9(][0-9 \t().-]*")


def is_phone(digits: str) -> bool:
    """Digits of a number in national form, or with the country's code, with or without the trunk's zero."""
    if digits.startswith("840") and len(digits) >= 12:
        digits = digits[2:]
    elif digits.startswith("84") and len(digits) >= 11:
        digits = "0" + digits[2:]
    return bool(_NATIONAL.fullmatch(digits))


def _phone_at(text: str, start: int) -> int | None:
    """The end of a phone number that begins here: the shortest run of digits that is one."""
    plus, digits, ends = text[start] == "+", "", []
    for i in range(start + plus, len(text)):
        c = text[i]
        if c.isascii() and c.isdigit():
            digits += c
            ends.append(i + 1)
            if len(digits) > 13:
                break
        elif c not in " \t-.()":
            break
    if plus and not digits.startswith("84"):
        return None
    n = next((n for n in range(10, min(len(digits), 13) + 1) if is_phone(digits[:n])), None)
    if n is None or (start and text[start - 1].isalnum()) or (ends[n - 1] < len(text) and text[ends[n - 1]].isalnum()):
        return None
    return ends[n - 1]


def phones(text: str) -> list[tuple[int, int]]:
    """Spans of phone numbers; neighbours stay apart, and a number with a foreign code is passed over as a whole."""
    out, at = [], 0
    while m := _GROUP.search(text, at):
        i, limit = m.start(), m.end()
        while i < limit:
            c = text[i]
            if (c in "+(" or c.isdigit()) and not (i and text[i - 1].isalnum()):
                if (end := _phone_at(text, i)) is not None:
                    out.append((i, end))
                    i = max(end, i + 1)
                    continue
                if c == "+":
                    i = _after_foreign(text, i)
                    continue
            i += 1
        at = max(limit, i, at + 1)
    return out


def _after_foreign(text: str, start: int) -> int:
    """Where the number ends whose + led nowhere: at white space, unless it could still be of this country and what
    follows is no number by itself."""
    i, digits, last = start + 1, "", start + 1
    while i < len(text) and len(digits) < 13:
        c = text[i]
        if c.isascii() and c.isdigit():
            digits, last = digits + c, i + 1
        elif c in " \t":
            rest = re.match(r"[ \t]*(\d)", text[i:])
            if not digits.startswith("84") or (rest and _phone_at(text, i + rest.start(1)) is not None):
                break
        elif c not in "-.()":
            break
        i += 1
    return last if digits else min(start + 1, len(text))


_DIGITS = re.compile(r"(?<![^\W_])[0-9](?:[ \t-]*[0-9])*(?![^\W_])")


def digit_groups(text: str) -> list[tuple[int, int, str]]:
    """Runs of 8 to 19 digits, with blanks or dashes inside."""
    found = ((m.start(), m.end(), re.sub(r"\D", "", m[0])) for m in _DIGITS.finditer(text))
    return [(a, b, d) for a, b, d in found if 8 <= len(d) <= 19]


#: Folded labels of each kind, and keys that break the tie between a label and a value.
LABELS = {
    "Phone": ("so dien thoai", "dien thoai", "hotline", "mobile", "phone", "sdt", "tel"),
    "BankAccount": ("so tai khoan ngan hang", "tai khoan ngan hang", "so tk ngan hang", "stk ngan hang", "so tai khoan", "tai khoan", "so tk", "stk"),
    "NationalId": ("can cuoc cong dan so", "can cuoc cong dan", "cccd so", "cmnd so", "can cuoc so", "can cuoc", "cccd", "cmnd"),
}
COMPETING = ("ma giao dich", "ma gd", "so tham chieu", "ma tham chieu", "so dien thoai", "dien thoai", "hotline", "mobile", "phone", "sdt", "tel", "cccd", "cmnd", "stk", "so tk")
_WORD = r"(?<![^\W_]){}(?![^\W_])"
_LABEL = [(kind, re.compile(_WORD.format(re.escape(p)))) for kind, names in LABELS.items() for p in names]
_RIVAL = re.compile(_WORD.format(f"(?:{'|'.join(map(re.escape, COMPETING))})"))
_SCOPE = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029|.!?;,，、…。！？]")


def _folded(text: str) -> tuple[str, list[int]]:
    """The folded text with single blanks, and for each of its characters where it comes from."""
    out, at = [], []
    for i, c in enumerate(text):
        piece = " " if c.isspace() else fold(c)
        if piece == " " and out and out[-1] == " ":
            continue
        out += piece
        at += [i] * len(piece)
    return "".join(out), [*at, len(text)]


def _linked(between: str) -> bool:
    """Whether what lies between a label and a value ties them: next to nothing, or a short qualifier and a colon."""
    if len(between) > 64:
        return False
    inner = between.strip()
    if not inner:
        return len(between) <= 3
    if inner[-1] not in ":=：":
        return False
    before = inner[:-1].strip()
    return len(before) <= 48 and not _RIVAL.search(_folded(before)[0])


def label_before(text: str, start: int) -> str | None:
    """The nearest label that is tied to a value, in the same clause, line and cell."""
    cut = max((m.end() for m in _SCOPE.finditer(text, max(0, start - 400), start)), default=max(0, start - 400))
    prefix = text[cut:start]
    low, at = _folded(prefix)
    best: tuple[int, int, str] | None = None
    for kind, pattern in _LABEL:
        for m in pattern.finditer(low):
            if _linked(prefix[at[m.end()] :]) and (best is None or (m.end(), len(m[0])) > best[:2]):
                best = m.end(), len(m[0]), kind
    return best and best[2]


def _header_kind(header: str) -> str | None:
    """The kind of a column by the label that ends last in its header."""
    low = _folded(header)[0]
    found = [(m.end(), m.start(), kind) for kind, p in _LABEL for m in p.finditer(low)]
    return max(found, key=lambda x: (x[0], -x[1]))[2] if found else None


def table_label(text: str, tables: list[dict], start: int) -> str | None:
    """The kind of the column that a value in a table's body stands in."""
    t = next((t for t in tables if t["start"] <= start < t["end"] and len(t["rows"]) > 1), None)
    if t is None:
        return None
    line = text.rfind("\n", 0, start) + 1
    if text.count("\n", t["start"], start) < 2:
        return None
    column = len(table_cells(text[line:start] + "x") or [""]) - 1
    return _header_kind(t["rows"][0][column]) if column < len(t["rows"][0]) else None


def scan(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, confidence) of everything found, by place. Addresses come first, then phone numbers, then
    other numbers that a label names; what is found first owns its span."""
    found = [("Email", a, b, 0.98) for a, b in emails(text)]
    taken = [(a, b) for _, a, b, _ in found]
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    if not re.search(r"\d{3}|\d[ \t().-]+\d", text):
        return found
    tables = parse_tables(text) if "|" in text else []
    label = lambda a: table_label(text, tables, a) or label_before(text, a)
    for a, b in phones(text):
        if free(a, b):
            own = label(a)
            found.append(("BankAccount", a, b, 0.8) if own == "BankAccount" else ("Phone", a, b, 0.92 if own == "Phone" else 0.9))
            taken.append((a, b))
    for a, b, digits in digit_groups(text):
        if free(a, b):
            own = label(a)
            if own == "BankAccount" or (own == "NationalId" and len(digits) in (9, 12)):
                found.append((own, a, b, 0.8 if own == "BankAccount" else 0.95))
                taken.append((a, b))
    return sorted(found, key=lambda x: (x[1], x[2]))


def redact(text: str, findings: list[dict]) -> str:
    """Findings that still stand where they were found give way to a mark of their kind; overlapping ones become one,
    of the kind that begins first."""
    spans = sorted(((f["start"], f["end"], f["kind"]) for f in findings if f["start"] < f["end"] and text[f["start"] : f["end"]] == f["text"]), key=lambda s: (s[0], -s[1]))
    merged: list[list] = []
    for a, b, kind in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    out, at = [], 0
    for a, b, kind in merged:
        out += [text[at:a], f"[REDACTED_{kind}]"]
        at = b
    return "".join(out) + text[at:]


def _findings(text: str) -> list[dict]:
    return [{"kind": k, "text": text[a:b], "start": a, "end": b, "byte_start": len(text[:a].encode()), "byte_end": len(text[:b].encode()), "confidence": c} for k, a, b, c in scan(text)]


@F.pandas_udf(kind("array<struct<kind:string,text:string,start:int,end:int,byte_start:bigint,byte_end:bigint,confidence:double>>"))
def _scanned(x: pd.Series) -> pd.Series:
    return x.map(lambda t: _findings(t or ""))


def detect(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """A row for each finding. Only texts with an at sign or a run of digits reach the scanners."""
    may = docs.where(docs[text_col].rlike(r"@|\d[\d \t().-]{6,}\d"))
    return may.select(id_col, F.explode(_scanned(may[text_col])).alias("f")).select(id_col, "f.*")


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count("*").alias("n"))


@F.pandas_udf(kind("string"))
def redacted(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else redact(t, _findings(t)))


