"""Column functions, operator by operator, on small tables."""

import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.functions import identity, numbers, text, vectors
from folioframe.functions.kinds import kind


@pytest.fixture
def one(spark):
    frame = spark.range(1)
    return lambda c: frame.select(c.alias("x")).first().x


@pytest.mark.parametrize("raw, folded", [("Đường Láng", "duong lang"), ("ÀẴỆ Ü ñ Ç", "aae u n c"), ("é", "e"), ("", ""), (None, None)])
def test_accent_fold(one, raw, folded):
    assert one(text.accent_fold(F.lit(raw).cast("string"))) == folded
    if raw is not None:
        assert vectors.fold(raw) == folded


def test_tokens(one):
    assert one(text.tokens(F.lit("Thử nghiệm, a 12-ab c! Đà_Nẵng"))) == ["thu", "nghiem", "12", "ab", "da", "nang"]
    assert one(text.content_terms(F.lit("the cat"), ("the",))) == ["cat"] and one(text.content_terms(F.lit("the the"), ("the",))) == ["the", "the"]
    assert one(text.prefix_query(F.lit("Cà phê"))) == '"ca"* OR "phe"*'


def test_snippets(one):
    body = " ".join(f"w{i}" for i in range(100))
    assert one(text.snippet(F.lit(body))) == " ".join(f"w{i}" for i in range(58))
    assert one(text.snippet_window(F.lit(body), F.array(F.lit("w50")))).split()[0] == "w38"
    assert len(one(text.snippet_window(F.lit(body), F.array(F.lit("zz")))).split()) == 56
    assert one(text.snippet_chars(F.lit("x" * 100 + " hit"), F.array(F.lit("hit")))).endswith("hit")


@pytest.mark.parametrize("md, title", [("a\n## Tên  \nb", "Tên"), ("####### no\n", "stem"), ("#none", "stem"), ("# " + "x" * 300, "x" * 240)])
def test_title(one, md, title):
    assert one(text.title(F.lit(md), F.lit("stem"))) == title


def test_small_text_functions(one):
    assert one(text.truncated(F.lit("abcdef"), 3, "..")) == "abc.." and one(text.truncated(F.lit("abc"), 3)) == "abc"
    assert one(text.lf(F.lit("a\r\nb\rc"))) == "a\nb\rc"
    assert one(text.repeated_run(F.lit("aaaaa"))) and not one(text.repeated_run(F.lit("aaaa -----")))
    assert one(text.folded_slug(F.lit("  Điều 1: Phạm vi  "))) == "dieu-1-pham-vi"
    assert one(text.markdown_table(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1"))))) == "|a|b\\|c|\n|---|---|\n|1||\n"
    assert [one(text.csv_guard(F.lit(c))) for c in ("=1", " +2", "a", "-")] == ["'=1", "' +2", "a", "'-"]
    assert [one(text.glob_matches(F.lit(n), "*.P?F")) for n in ("a.pdf", "a.pxf", "a.pdfx", "pdf")] == [True, True, False, False]
    assert [one(text.hidden_or_temporary(F.lit(n))) for n in (".a", "~$b.docx", "c.tmp", "d.docx")] == [True, True, True, False]
    assert one(text.marker_only(F.lit("<!-- Page 3 -->\n"))) and not one(text.marker_only(F.lit("<!-- Page 3 -->\nx")))
    assert one(text.normalised_content(F.lit("# T\n| a | b |\n| --- | :-: |\n- x"))) == "T a b x"
    assert one(text.char_error_rate(F.lit("chào"), F.lit("chao"))) == 0.25 and one(text.char_error_rate(F.lit(""), F.lit("x"))) == 1.0


@pytest.mark.parametrize(
    "raw, value",
    [("1.000", None), ("1,5", 1.5), ("1.000.000", 1e6), ("1,000,000", 1e6), ("1.234,5", 1234.5), ("1,234.5", 1234.5), ("-7", -7), ("12 500", 12500), ("1.00.00", 100.0), ("abc", None), ("", None), ("9" * 30, None)],
)
def test_decimals(one, raw, value):
    got = one(numbers.decimal_or_null(F.lit(raw)))
    assert (got is None and value is None) or float(got) == value


def test_vectors(one):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert one(numbers.dot(v(1, 2), v(3, 4))) == 11 and one(numbers.dot(v(1), v(1, 2))) == 0 and one(numbers.dot(F.array().cast("array<double>"), F.array().cast("array<double>"))) == 0
    assert one(numbers.normalised(v(3, 4))) == [0.6, 0.8] and one(numbers.normalised(v(0, 0))) == [0, 0]
    assert one(numbers.is_unit(v(0.6, 0.8))) and not one(numbers.is_unit(v(1, 1)))
    null = F.lit(None).cast("int")
    assert one(numbers.rank_fusion(F.lit(0), null)) == 1 / 60 and one(numbers.rank_fusion(null, null)) == 0
    assert math.isclose(one(numbers.rerank(F.lit(1 / 60), F.lit(0.5), F.lit(1.0), F.lit(2.0))), 30 / 60 + 0.275 + 0.35 + 0.2)
    assert [one(numbers.backoff_seconds(F.lit(i))) for i in (0, 1, 2, 9, 50)] == [1, 1, 2, 256, 256]
    assert one(numbers.saturating_weight(F.lit(0))) == 0.5 and one(numbers.clamp01(F.lit(-1.0))) == 0
    assert one(numbers.estimated_tokens(F.lit(""))) == 1 and one(numbers.estimated_tokens(F.lit("abcde"))) == 2
    assert 0 <= one(numbers.stable_unit(F.lit("a"))) < 1


def test_identities(one):
    field = lambda b: struct.pack(">Q", len(b)) + b
    want = hashlib.sha256(b"".join(map(field, [b"ns", b"sha256-v1", b"chunk", "tài.md".encode(), b"H", struct.pack(">Q", 7)]))).hexdigest()
    assert one(identity.chunk_id(F.lit("tài.md"), F.lit("H"), F.lit(7), "ns")) == f"chunk-sha256-v1-{want}"
    want = hashlib.sha256(b"ns" + struct.pack(">H", 2) + b"".join(map(field, [b"document", b"a", b"b"]))).hexdigest()
    assert one(identity.document_identity(F.lit("a"), F.lit("b"), namespace="ns", version=2)) == want
    want = hashlib.sha256(b"ns" + struct.pack(">H", 2) + b"".join(map(field, [b"index", b"r", b"f", b"v", struct.pack(">Q", 1024), b"\x01", b"c", b"b", b"q"]))).hexdigest()
    texts = [F.lit(x) for x in "rfv"], [F.lit(x) for x in "cbq"]
    assert one(identity.index_signature(*texts[0], F.lit(1024), F.lit(True), *texts[1], namespace="ns", version=2)) == want
    assert one(identity.digest(F.encode(F.lit("ab"), "UTF-8"), F.encode(F.lit("c"), "UTF-8"))) != one(identity.digest(F.encode(F.lit("a"), "UTF-8"), F.encode(F.lit("bc"), "UTF-8")))
    assert one(identity.fingerprint(F.array(F.lit("b"), F.lit("a")))) == hashlib.sha256(b"a\0b").hexdigest()[:32]


def test_hash_embedding(spark):
    # SipHash-1-3 with zero keys of the empty string, and of one that fills a block
    assert hex(int(vectors.siphash13([b""])[0])) == "0xd1fba762150c532c"
    rows = spark.createDataFrame([("xin chào thế giới",), (None,), ("",)], "t string").select(vectors.hash_embedding(F.col("t")).alias("v")).collect()
    assert len(rows[0].v) == 256 and abs(np.linalg.norm(rows[0].v) - 1) < 1e-5 and not any(rows[1].v) and not any(rows[2].v)
    a, b, c = vectors.embed(["mức phạt hợp đồng", "muc phat hop dong", "hoàn toàn khác"])
    assert np.allclose(a, b) and a @ b > a @ c


def test_kinds(spark):
    for x in ("array<struct<a:int,b:array<string>>>", "struct<a:map<string,bigint>,b:decimal(38,18)>"):
        assert kind(x).simpleString() == x


def test_inferred_types(one):
    lits = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    for values, name in ((("1.5", "2,000"), "Number"), (("1/2/2024", "2024-01-02"), "Date"), (("Có", "không"), "Boolean"), (("a", "1"), "String"), ((), "String"), ((" ",), "String")):
        assert one(numbers.inferred_type(lits(*values), text.accent_fold)) == name
