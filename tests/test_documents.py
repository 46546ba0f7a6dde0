"""Markdown, personal data, claims, routing, and conversion of files."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.operators import claims, markdown, pii
from folioframe.sources import convert, formats, legacy


def test_chunks():
    md = "intro\n# A\r\nx\r\n\r\ny\n### C\n## B\nz\n# only heading\n```\n# in code\ncode\n```\n"
    assert markdown.chunk_markdown(md) == [("", "intro"), ("A", "x\n\ny"), ("A > B", "z"), ("only heading", "```"), ("in code", "code\n```")]
    long = "# H\n" + "\n\n".join(["p" * 150, "q" * 150, "r" * 450])
    assert [len(t) for _, t in markdown.chunk_markdown(long, 200)] == [150, 150, 200, 200, 50]
    assert [len(t) for _, t in markdown.chunk_markdown("a" * 500, 10)] == [200, 200, 100]
    assert markdown.chunk_markdown("# A\n### B\nx\n## C\ny")[1] == ("A > C", "y")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n\r#", max_size=300))
def test_chunk_spans_round_trip(md):
    for c in markdown.corpus_chunks(md, 200):
        found = md[c["start"] : c["end"]]
        assert found.replace("\r\n", "\n") == c["text"] or c["start"] == c["end"]
        assert md.encode()[c["byte_start"] : c["byte_end"]].decode() == found


def test_pages_and_corpus(spark):
    md = "<!-- Page 1 -->\n\n# T\nalpha\n<!-- Trang 2 (OCR) -->\n## U\nbeta\n"
    rows = markdown.build_corpus(spark.createDataFrame([("d", md), ("e", None)], "source_rel string, markdown string")).orderBy("ordinal").collect()
    assert [(r.heading, r.page) for r in rows] == [("T", 1), ("T > U", 2)] and len({r.chunk_id for r in rows}) == 2


def test_tables(spark):
    md = "x\n| a | b\\|c |\n|---|:---:|\n| 1 | |\n| 2 | 3 |\n|short|\nend\n|no|\n|-|\n"
    (t,) = markdown.parse_tables(md)
    assert t["rows"] == [["a", "b|c"], ["1", ""], ["2", "3"]] and md[t["start"] : t["end"]].count("\n") == 4
    new = markdown.replace_table(md, t, [["k"], ["v|w"]])
    assert "|k|\n|---|\n|v\\|w|\n" in new and new.startswith("x\n") and "|short|" in new
    with pytest.raises(ValueError):
        markdown.replace_table(new, t, [["k"]])
    rows = markdown.infer_schema(spark.createDataFrame([("d", md + "Ngày ký: 01/02/2024\n- b|c: x\nab: y\n")], "source_rel string, markdown string")).orderBy("position").collect()
    assert [(r.name, r.type) for r in rows] == [("a", "Number"), ("b|c", "Number"), ("|---|", "String"), ("Ngày ký", "Date")]


def test_diff_and_merge(spark):
    assert markdown.diff("a\nb\nc", "a\nx\nc") == {"kind": "Modified", "line": 1, "old_text": "b", "new_text": "x"}
    assert markdown.diff("a", "a\nb")["kind"] == "Added" and markdown.diff("a\nb", "b")["kind"] == "Removed" and markdown.diff("a", "a")["kind"] == "Unchanged"
    df = spark.createDataFrame([("b", "b", "t"), ("b", "o", "b"), ("b", "s", "s"), ("b", "o", "t")], "b string, o string, t string")
    got = [r.m for r in df.select(markdown.three_way_merge(F.col("b"), F.col("o"), F.col("t")).alias("m")).collect()]
    assert [m.markdown for m in got[:3]] == ["t", "o", "s"] and [m.conflict for m in got] == [False, False, False, True] and got[3].markdown.startswith("<<<<<<<")
    assert "".join(markdown.blocks("# a\nx\n## b\ny")) == "# a\nx\n## b\ny" and len(markdown.blocks("p\n\nq\n\n\nr")) == 3
    assert markdown.align_blocks(["a", "b", "c"], ["a", "c", "d"]) == [(0, 0), (1, None), (2, 1), (None, 2)]


def test_quality_issues(spark):
    rows = [(1, "x" * 100), (2, "short"), (3, "�" + "y z " * 40), (4, "<!-- Trang 1 (OCR) -->" + "ab " * 40), (5, "|---\n" + "cd " * 40)]
    got = {r.k: r for r in markdown.quality_report(spark.createDataFrame(rows, "k int, markdown string"), "k").collect()}
    assert [got[k].issues for k in range(1, 6)] == [["REPEATED_RUN"], ["SHORT_CONTENT"], ["REPLACEMENT_CHARACTER"], ["OCR_CONTENT"], ["MALFORMED_TABLE"]]
    assert [round(got[k].score, 2) for k in range(1, 6)] == [0.88, 0.88, 0.7, 0.96, 0.88]


@pytest.mark.parametrize(
    "text, found",
    [
        ("Reach lan.ho@firma.de; copy to **team_x@haus.net**", ["lan.ho@firma.de", "team_x@haus.net"]),
        ("__~~*q7@lab.fr*~~__", ["q7@lab.fr"]),
        ("v@12.34 k..m@lab.fr .k@lab.fr k@-lab.fr k@lab-.fr k@lab", []),
        ("d'arc+news@post.lab.fr.", ["d'arc+news@post.lab.fr"]),
        ("ñu@lab.fr", []),
        ("k@lab.fr@rue.fr", []),
        ("|k9@lab.fr|", ["k9@lab.fr"]),
    ],
)
def test_emails(text, found):
    assert [text[a:b] for a, b in pii.emails(text)] == found


@pytest.mark.parametrize(
    "text, found",
    [
        ("0388120457 0776543219", ["0388120457", "0776543219"]),
        ("+84 70 811 29 46; (028) 6277-4410", ["+84 70 811 29 46", "(028) 6277-4410"]),
        ("+4915112345 0587710326", ["0587710326"]),
        ("84-0-826-410-975", ["84-0-826-410-975"]),
        ("0531870264 0118706254 k0826410975 0826410975k", []),
        ("0258 377 1946", ["0258 377 1946"]),
    ],
)
def test_phones(text, found):
    assert [text[a:b] for a, b in pii.phones(text)] == found


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Hotline: 0388120457", [("Phone", 0.92)]),
        ("ghi lại 0388120457", [("Phone", 0.9)]),
        ("STK ngân hàng: 7705 1294 3386", [("BankAccount", 0.8)]),
        ("Số TK 77051294", [("BankAccount", 0.8)]),
        ("Căn cước: 047155902746", [("NationalId", 0.95)]),
        ("CCCD số 604218773", [("NationalId", 0.95)]),
        ("CMND: 6042187735", []),
        ("Số tài khoản mã GD: 604218773512", []),
        ("CMND. 047155902746", []),
        ("|Họ|STK|\n|---|---|\n|B|0388120457|\n", [("BankAccount", 0.8)]),
        ("60421877", []),
    ],
)
def test_labels(text, kinds):
    assert [(k, c) for k, _, _, c in pii.scan(text)] == kinds


def test_redaction(spark):
    text = "k@lab.fr rồi 0388120457"
    findings = [{"kind": k, "text": text[a:b], "start": a, "end": b} for k, a, b, _ in pii.scan(text)]
    assert pii.redact(text, findings) == "[REDACTED_Email] rồi [REDACTED_Phone]"
    assert pii.redact("x" + text, findings) == "x" + text  # stale
    both = [{"kind": "A", "text": "abc", "start": 0, "end": 3}, {"kind": "B", "text": "bcd", "start": 1, "end": 4}]
    assert pii.redact("abcde", both) == "[REDACTED_A]e"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string")
    assert {(r.kind, r.byte_start) for r in pii.detect(df, "k").collect()} == {("Email", 0), ("Phone", 15)}
    assert [r.t for r in df.orderBy("k").select(pii.redacted("text").alias("t")).collect()] == ["[REDACTED_Email] rồi [REDACTED_Phone]", None, ""]


def test_claims(spark):
    md = "|Key|Subject|Predicate|Value|Unit|Type|\n|---|---|---|---|---|---|\n|k|s|p|1,5|VND||\n|k|s|p|1.000|||\n|k|s|p|yes|||\n|k|s|p|2024-01-02|||\n|k|s|p|x||number|\n||s|p|1|||\n|k|s|p|7||Money|\n"
    got = claims.claims_of(md)
    assert [(c["value_type"], c["value"]) for c in got] == [("money", "1.5"), ("text", "1.000"), ("boolean", "true"), ("date", "2024-01-02"), ("money", "7")]
    assert claims.claims_of("|a|b|\n|---|---|\n|1|2|\n") == []


def test_requirements(spark):
    text = "- Hệ thống phải tắt máy bơm ban đêm\nNgân sách bắt buộc duyệt\nngắn\nGiả định có mạng ổn định\nAi phê duyệt việc này?\nGiven a user When x Then y ok"
    rows = claims.numbered(claims.requirement_lines(spark.createDataFrame([("d", text)], "d string, text string"), "d"), ["d"], ["line"])
    assert {(r.item_id, r.line) for r in rows.collect()} == {("FR-001", 0), ("BR-001", 1), ("AS-001", 3), ("Q-001", 4), ("AC-001", 5)}
    assert claims.skeletons(rows).count() == 6
    quotes = spark.createDataFrame([("d", "hệ thống phải tắt máy bơm ban đêm khi mưa")], "d string, quote string")
    good = {r.item_id: r.grounded for r in claims.grounding(rows, quotes, "d").collect()}
    assert good["FR-001"] and not good["Q-001"]


def test_answers(spark):
    quotes = {"CITE-0001": "Vé tàu hết 5 triệu", "CITE-0002": "không áp dụng"}
    assert claims.answer_warnings("Vé tàu hết 5 triệu [CITE-0001].", quotes) == []
    assert claims.answer_warnings("x", quotes) == ["no_citation"]
    assert "unknown_citation:CITE-0009" in claims.answer_warnings("a [CITE-0009]", quotes)
    assert "value_not_in_source:7" in claims.answer_warnings("Vé tàu hết 7 triệu [CITE-0001].", quotes)
    assert "negation_differs" in claims.answer_warnings("Áp dụng [CITE-0002].", quotes)
    assert "uncited_paragraph" in claims.answer_warnings("b " * 40 + "\n\nx [CITE-0001]", quotes)


def test_routes(spark):
    turns = ["", "Xin chào!", "xin chao ban oi", "Chính sách nghỉ phép?", "chinh sach", "thời tiết hôm nay", "why is it so", "hello " + "x" * 80, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "i int, t string")
    got = [r.r for r in df.orderBy("i").select(claims.ask_route(F.col("t")).alias("r")).collect()]
    assert got == ["knowledge", "assistant", "assistant", "knowledge", "knowledge", "assistant", None, None, None]
    labels = spark.createDataFrame([("KNOWLEDGE.",), ("**assistant** x",), ("maybe",)], "t string").select(claims.router_label(F.col("t")).alias("r"))
    assert [r.r for r in labels.collect()] == ["knowledge", "assistant", None]


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = archive(**{"word__document.xml": f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Điều 1</w:t></w:r></w:p>
<w:p><w:r><w:t xml:space="preserve">a </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve"> đậm </w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>mục</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x|y</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>z</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>m</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""})  # fmt: skip
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = archive(
    **{
        "xl__workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Một" r:id="r1"/></sheets></workbook>',
        "xl___rels__workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl__sharedStrings.xml": f"<sst {S}><si><t>tên</t></si></sst>",
        "xl__worksheets__sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row/><row><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>',
    }
)
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
SLIDE = '<p:sld {0}><p:sp><p:nvSpPr><p:cNvPr name="T"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="2"/><a:ext cx="3" cy="4"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{1}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'
PPTX = archive(**{"ppt__slides__slide10.xml": SLIDE.format(A, "mười"), "ppt__slides__slide2.xml": SLIDE.format(A, "hai"), "ppt__slides__slide3.xml": SLIDE.format(A, " ")})


def test_office_formats():
    md = convert.docx_markdown(DOCX)
    assert md.startswith("## Điều 1\n\na  **đậm** \n\n- mục\n\n| x\\|y | z |") and '<td colspan="2">m</td>' in md
    assert convert.xlsx_markdown(XLSX) == "## Một\n\n| tên |  | 2.5 |\n| --- | --- | --- |\n|  | TRUE |  |\n"
    assert convert.xlsx_markdown(XLSX, only="MỘT") and convert.xlsx_markdown(XLSX, only="x") == ""
    assert convert.pptx_markdown(PPTX) == "## Slide 1\n\nhai\n\n## Slide 3\n\nmười\n"
    assert convert.pptx_shapes(PPTX)[0] == [{"kind": "shape", "name": "T", "text": "hai", "x": 1, "y": 2, "cx": 3, "cy": 4}]
    assert convert.tables_json(XLSX, "xlsx")[0]["rows"][0] == ["tên", "", "2.5"]
    assert convert.tables_json(b"a,b\n1,2\n", "csv") == [{"name": "", "rows": [["a", "b"], ["1", "2"]]}]


def test_csv_and_html():
    assert convert.csv_markdown("﻿Họ tên;Tuổi\nAn;3\n".encode()) == "| Họ tên | Tuổi |\n| --- | --- |\n| An | 3 |\n"
    assert convert.csv_markdown(b"a,b;c\n") == "| a,b | c |\n| --- | --- |\n" and convert.csv_markdown(b"") == ""
    page = "<html><head><title>t</title><style>x</style></head><body><h2>H</h2><p>a <b>b</b><br>c</p><ol><li>x<li>y</ol><table><tr><th>k<td>v|w<tr><td>1<td>2</table><script>z</script></body></html>"
    assert convert.html_markdown(page) == "## H\n\na **b**\nc\n\n1. x\n2. y\n\n| k | v\\|w |\n| --- | --- |\n| 1 | 2 |\n"
    assert convert.decode_html('<meta charset="windows-1252">caf\xe9'.encode("latin-1")).endswith("café")


def test_legacy_text():
    assert legacy.decode_text("Tiếng Việt".encode()) == "Tiếng Việt" and legacy.decode_text(b"\xef\xbb\xbfx") == "x"
    back = {c: b for b, c in legacy.TCVN3.items()}
    raw = bytes(back.get(c, ord(c)) for c in "Cộng hoà xã hội chủ nghĩa")
    assert legacy.decode_text(raw) == "Cộng hoà xã hội chủ nghĩa"
    assert legacy.decode_text("Coäng hoøa xaõ hoäi chuû nghóa Vieät Nam ñoäc laäp".encode("cp1252")) == "Cộng hòa xã hội chủ nghĩa Việt Nam độc lập"
    assert "�" in legacy.decode_text(b"abc \xff def")


def test_formats(spark):
    df = spark.createDataFrame([("a/B.PDF", b"%PDF-1.7"), ("x.docx", DOCX), ("y.pdf", b"\x89PNG\r\n\x1a\n"), ("t.txt", b"hello"), ("none", b"\x00\x01"), ("d/.hidden.csv", b"a,b"), (".log", b"x")], "path string, content binary")
    got = [(r.f, r.m, r.s) for r in df.select(formats.format_of(F.col("path")).alias("f"), formats.magic(F.col("content")).alias("m"), formats.spoofed(F.col("path"), F.col("content")).alias("s")).collect()]
    assert got == [("pdf", "pdf", False), ("docx", "zip", False), ("pdf", "png", True), ("text", "text", False), (None, None, None), ("csv", "text", False), (None, "text", True)]
    assert formats.zip_family(DOCX) == "docx" and formats.zip_family(XLSX) == "xlsx" and formats.archive_reason(DOCX) is None
    assert formats.archive_reason(archive(**{"..__x": "1"})) == "path_traversal" and formats.archive_reason(archive(**{"a.zip": "1"})) == "nested_archive" and formats.archive_reason(b"PK") == "corrupt"


def test_convert_files(spark, tmp_path):
    for name, body in (("a.csv", b"x;y\n1;2\n"), ("b.html", b"<h1>T</h1>"), ("c.docx", b"broken"), ("d.pdf", b"%PDF"), ("e.bin", b"?")):
        (tmp_path / name).write_bytes(body)
    rows = {r.path.rsplit("/", 1)[1]: r for r in convert.convert_files(spark, f"file://{tmp_path}", max_chars=1000).collect()}
    assert rows["a.csv"].markdown.startswith("| x | y |") and rows["b.html"].title == "T" and rows["a.csv"].title == "a"
    assert rows["c.docx"].error.startswith("BadZipFile") and rows["d.pdf"].error == "no converter for pdf" and rows["e.bin"].error == "unsupported"
    own = convert.convert_files(spark, f"file://{tmp_path}", glob="*.pdf", converters={"pdf": lambda data, path: "# từ pdf"}).collect()
    assert [r.title for r in own] == ["từ pdf"]
