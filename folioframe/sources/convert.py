"""Files to Markdown. Office formats are read with the standard library; PDF, images and sound go to a converter that
the caller registers, as they need software that isn't Python's."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text
from folioframe.functions.kinds import kind
from folioframe.sources import formats, legacy

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def cell(x: str) -> str:
    return x.replace("|", "\\|").replace("\r\n", "\n").replace("\n", "<br>").strip()


def table(rows: list[list[str]]) -> str:
    """A Markdown table as wide as its widest row; the first row is the header."""
    width = max(map(len, rows), default=0)
    line = lambda r: "|" + "".join(f" {r[i] if i < len(r) else ''} |" for i in range(width)) + "\n"
    return line(rows[0]) + "|" + " --- |" * width + "\n" + "".join(map(line, rows[1:])) if width else ""


def html_table(rows: list[list[tuple[str, int, int]]]) -> str:
    """An HTML table of cells (text, rows and columns spanned)."""
    import html

    tag = lambda t, n, m: "<td" + (f' rowspan="{n}"' if n > 1 else "") + (f' colspan="{m}"' if m > 1 else "") + ">" + html.escape(t).replace("\n", "<br>") + "</td>"
    return "<table>\n" + "".join("<tr>" + "".join(tag(*c) for c in r) + "</tr>\n" for r in rows) + "</table>\n"


def csv_markdown(data: bytes, path: str = "") -> str:
    """A CSV file as a table. The separator is the most frequent one of , ; tab | in the first line that isn't blank,
    the later of equals; rows may be of any length."""
    content = legacy.decode_text(data)
    first = next((x for x in content.splitlines() if x.strip()), "")
    separator = max(enumerate(",;\t|"), key=lambda s: (first.count(s[1]), s[0] if s[1] in first else -1))[1] if any(c in first for c in ",;\t|") else ","
    return table([[cell(c) for c in r] for r in csv.reader(io.StringIO(content, newline=""), delimiter=separator) if r])


class _Html(HTMLParser):
    SKIP = {"script", "style", "noscript", "template", "head"}
    BLOCK = {"p", "div", "section", "article", "header", "footer", "main", "nav", "ul", "ol", "table", "blockquote", "pre", "figure", "aside", "form", "dl"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.link, self.row, self.rows, self.title = 0, [], None, None, ""
        self.lists: list[int] = []
        self.in_title = False

    def _break(self, mark: str = "\n\n") -> None:
        self.out.append(mark)

    def _close_cell(self) -> None:
        if self.row and isinstance(self.row[-1], int):
            at = self.row[-1]
            self.row[-1] = cell(re.sub(r"\s+", " ", "".join(self.out[at:])))
            del self.out[at:]

    def _close_row(self) -> None:
        self._close_cell()
        if self.rows is not None and self.row:
            self.rows.append(self.row)
        self.row = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "title":
            self.in_title = True
        if tag in self.SKIP:
            self.skip += 1
        elif self.skip:
            return
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._break()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "br":
            self._break("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a":
            self.link.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "img":
            d = dict(attrs)
            self.out.append(f"![{d.get('alt') or ''}]({d.get('src') or ''})")
        elif tag == "li":
            number = self.lists[-1] if self.lists else 0
            self.out.append("\n" + "  " * max(len(self.lists) - 1, 0) + (f"{number}. " if number else "- "))
            if number:
                self.lists[-1] += 1
        elif tag == "table":
            self._break()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self._close_row()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self._close_cell()
            self.row.append(len(self.out))
        elif tag in self.BLOCK:
            self._break()
        if tag in ("ul", "ol") and not self.skip:
            self.lists.append(1 if tag == "ol" else 0)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a" and self.link:
            self.out.append(f"]({self.link.pop()})")
        elif tag in ("td", "th"):
            self._close_cell()
        elif tag == "tr":
            self._close_row()
        elif tag == "table" and self.rows is not None:
            self._close_row()
            self.out.append(table([r for r in self.rows if r]))
            self.rows = None
            self._break()
        elif tag in self.BLOCK or re.fullmatch("h[1-6]", tag):
            self._break()
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_markdown(data: bytes | str, path: str = "") -> str:
    """An HTML page as Markdown, without its scripts and styles."""
    parser = _Html()
    parser.feed(data if isinstance(data, str) else decode_html(data))
    parser.close()
    out = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"(?<!\n)[ \t]+(?!\n)", " ", "".join(parser.out)))
    return re.sub(r"\n{3,}", "\n\n", out).strip() + "\n" if out.strip() else ""


def decode_html(data: bytes) -> str:
    """By mark of byte order, then by the charset the page names, then as any text."""
    if data[:3] == b"\xef\xbb\xbf" or data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return legacy.decode_text(data)
    m = re.search(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", data[:1024], re.I)
    if m:
        name = m[1].decode("ascii").lower()
        try:
            return data.decode("utf-8" if name.startswith("utf-16") else {"iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252"}.get(name, name))
        except (LookupError, UnicodeDecodeError):
            pass
    return legacy.decode_text(data)


def text_markdown(data: bytes, path: str = "") -> str:
    return legacy.decode_text(data)


def _wrapped(x: str, mark: str) -> str:
    """Emphasis around a run, its outer blanks outside."""
    inner = x.strip()
    return x if not inner else x[: len(x) - len(x.lstrip())] + mark + inner + mark + x[len(x.rstrip()) :]


def _runs(p: ElementTree.Element) -> str:
    out = []
    for r in p.iter(f"{W}r"):
        t = "".join(x.text or "" if x.tag == f"{W}t" else "\t" if x.tag == f"{W}tab" else "\n" if x.tag in (f"{W}br", f"{W}cr") else "" for x in r)
        props = r.find(f"{W}rPr")
        on = lambda name: props is not None and (e := props.find(W + name)) is not None and e.get(f"{W}val") not in ("0", "false")
        out.append(_wrapped(t, "***" if on("b") and on("i") else "**" if on("b") else "*") if on("b") or on("i") else t)
    return "".join(out)


def docx_markdown(data: bytes, path: str = "") -> str:
    """Paragraphs by style: headings, lists, emphasis; tables, merged cells as HTML."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                names[s.get(f"{W}styleId")] = (name.get(f"{W}val") or "").lower() if name is not None else ""
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            content, props = _runs(e), e.find(f"{W}pPr")
            if not content.strip():
                continue
            style = props.find(f"{W}pStyle") if props is not None else None
            name = names.get(style.get(f"{W}val"), (style.get(f"{W}val") or "").lower()) if style is not None else ""
            level = re.search(r"heading\s*([1-6])", name)
            listed = props is not None and props.find(f"{W}numPr") is not None
            prefix = "#" * int(level[1]) + " " if level else "# " if name == "title" else "- " if listed else ""
            out.append(prefix + (content.replace("**", "").strip() if level else content))
        elif e.tag == f"{W}tbl":
            rows, merged = [], False
            for tr in e.iter(f"{W}tr"):
                row = []
                for tc in tr.findall(f"{W}tc"):
                    props = tc.find(f"{W}tcPr")
                    span = props.find(f"{W}gridSpan") if props is not None else None
                    down = props.find(f"{W}vMerge") if props is not None else None
                    n = int(span.get(f"{W}val") or 1) if span is not None else 1
                    goes_on = down is not None and down.get(f"{W}val") != "restart"
                    merged |= n > 1 or down is not None
                    row.append(("" if goes_on else "\n".join(filter(None, map(_runs, tc.iter(f"{W}p")))), goes_on, n))
                rows.append(row)
            out.append(_merged_table(rows) if merged else table([[cell(t) for t, _, _ in r] for r in rows]))
    return "\n\n".join(x.rstrip("\n") for x in out) + "\n" if out else ""


def _merged_table(rows: list[list[tuple[str, bool, int]]]) -> str:
    """Rows of (text, goes on from above, columns) as an HTML table."""
    grid: list[list[tuple[str, int, int]]] = []
    open_: dict[int, tuple[int, int]] = {}
    for row in rows:
        made, column = [], 0
        for t, goes_on, n in row:
            if goes_on and column in open_:
                i, j = open_[column]
                x = grid[i][j]
                grid[i][j] = (x[0], x[1] + 1, x[2])
            else:
                open_[column] = (len(grid), len(made))
                made.append((t, 1, n))
            column += n
        grid.append(made)
    return html_table(grid)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> Iterator[tuple[str, list[list[str]], bool]]:
    """Name, rows and whether cells are merged, of each sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
            target = rels.get(sheet.get(f"{R}id"), "")
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            if part not in names:
                continue
            root, rows = ElementTree.fromstring(z.read(part)), []
            for tr in root.iter(f"{S}row"):
                row: list[str] = []
                for c in tr.findall(f"{S}c"):
                    v, at = c.find(f"{S}v"), _column(c.get("r") or "") if c.get("r") else len(row)
                    t = c.get("t")
                    value = "".join(x.text or "" for x in c.iter(f"{S}t")) if t == "inlineStr" else "" if v is None else shared[int(v.text)] if t == "s" else {"0": "FALSE", "1": "TRUE"}.get(v.text, v.text) if t == "b" else v.text or ""
                    row += [""] * (at - len(row)) + [value]
                rows.append(row)
            yield sheet.get("name") or "", rows, root.find(f"{S}mergeCells") is not None


def xlsx_markdown(data: bytes, path: str = "", only: str | None = None) -> str:
    """A section for each sheet; cells that are merged or have several lines make an HTML table."""
    out = []
    for name, rows, merged in sheets(data):
        if only is not None and name.lower() != only.lower():
            continue
        filled = [r for r in rows if any(r)]
        plain = not merged and not any("\n" in c for r in filled for c in r)
        body = table([[cell(c) for c in r] for r in filled]) if plain else html_table([[(c, 1, 1) for c in r] for r in filled])
        out.append(f"## {name}\n\n{body}" if filled else f"## {name}\n")
    return "\n".join(out)


def pptx_slides(data: bytes) -> list[list[str]]:
    """The paragraphs of each slide, in the order of the slides' numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        return [[t for p in ElementTree.fromstring(z.read(n)).iter(f"{A}p") if (t := "".join(x.text or "" for x in p.iter(f"{A}t")).strip())] for _, n in parts]


def pptx_markdown(data: bytes, path: str = "") -> str:
    """A section for each slide that has text."""
    return "\n".join(f"## Slide {i}\n\n" + "\n\n".join(s) + "\n" for i, s in enumerate(pptx_slides(data), 1) if s)


def pptx_shapes(data: bytes) -> list[list[dict]]:
    """Of each slide its shapes: name, text and place in EMU."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = []
        for _, n in parts:
            shapes = []
            for sp in ElementTree.fromstring(z.read(n)).iter():
                if sp.tag not in (f"{P}sp", f"{P}pic"):
                    continue
                name, off, ext = sp.find(f".//{P}cNvPr"), sp.find(f".//{A}off"), sp.find(f".//{A}ext[@cx]")
                number = lambda e, k: int(e.get(k)) if e is not None and e.get(k) else 0
                shapes.append({"kind": "image" if sp.tag.endswith("pic") else "shape", "name": name.get("name") if name is not None else "", "text": "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in sp.iter(f"{A}p")), "x": number(off, "x"), "y": number(off, "y"), "cx": number(ext, "cx"), "cy": number(ext, "cy")})
            out.append(shapes)
        return out


def tables_json(data: bytes, format_: str, only: str | None = None) -> list[dict]:
    """Name and rows of each table of a CSV file or workbook; two sheets of one name (after composition) are an error."""
    if format_ == "csv":
        content = legacy.decode_text(data)
        separator = max(",;\t|", key=(next((x for x in content.splitlines() if x.strip()), "")).count)
        found = [("", list(csv.reader(io.StringIO(content, newline=""), delimiter=separator)))]
    else:
        found = [(unicodedata.normalize("NFC", n), r) for n, r, _ in sheets(data) if only is None or n.lower() == only.lower()]
    if len({n for n, _ in found}) < len(found):
        raise ValueError("two sheets have the same name")
    return [{"name": n, "rows": r} for n, r in found]


Converter = Callable[[bytes, str], str]
CONVERTERS: dict[str, Converter] = {"csv": csv_markdown, "html": html_markdown, "text": text_markdown, "docx": docx_markdown, "xlsx": xlsx_markdown, "pptx": pptx_markdown}


def convert(data: bytes, path: str, format_: str | None, converters: dict[str, Converter] = CONVERTERS) -> tuple[str | None, str | None]:
    """Markdown in composed form, or why there is none."""
    if format_ not in converters:
        return None, "unsupported" if format_ is None else f"no converter for {format_}"
    try:
        return unicodedata.normalize("NFC", converters[format_](data, path)), None
    except Exception as e:  # one broken file is a row with its error, not a failed job
        return None, f"{type(e).__name__}: {e}"


def convert_files(spark: SparkSession, path: str, glob: str | None = None, max_chars: int | None = None, converters: dict[str, Converter] | None = None) -> DataFrame:
    """A row for each file below a path: path, bytes, format, title, markdown and error. The files come through Spark's
    reader, so from any store it reads."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    chosen = {**CONVERTERS, **(converters or {})}

    @F.pandas_udf(kind("struct<markdown:string,error:string>"))
    def run(content: pd.Series, name: pd.Series, format_: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([convert(bytes(c), n, f, chosen) for c, n, f in zip(content, name, format_)], columns=["markdown", "error"])

    rows = files.select("path", F.col("length").alias("bytes"), formats.format_of(F.col("path")).alias("format"), "content")
    done = rows.withColumn("r", run("content", "path", "format")).select("path", "bytes", "format", "r.*")
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    titled = done.withColumn("title", text.title(F.col("markdown"), stem))
    return titled.withColumn("markdown", text.truncated(F.col("markdown"), max_chars)) if max_chars else titled


@F.pandas_udf(kind("string"))
def html_to_markdown(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else html_markdown(t))
