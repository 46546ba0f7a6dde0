"""Pages, administrative operations, folders and sinks."""

import datetime as dt
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.operators import pages, service
from folioframe.sources import sinks, watch

T0 = dt.datetime(2024, 1, 1)
rows = lambda df: sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def one(spark):
    frame = spark.range(1)
    return lambda c: frame.select(c.alias("x")).first().x


def test_page_text(one):
    good = "Điều khoản này quy định trách nhiệm của các bên tham gia hợp đồng dịch vụ. " * 6
    assert one(pages.is_trustworthy(F.lit(good))) and one(pages.is_high_confidence(F.lit(good)))
    assert not one(pages.is_trustworthy(F.lit("short"))) and not one(pages.is_trustworthy(F.lit(good + "(cid:12)"))) and not one(pages.is_trustworthy(F.lit(good + "�" * 9)))
    assert not one(pages.is_high_confidence(F.lit("bcdfg hjklm npqrst vwxz " * 20)))
    assert one(pages.covers(F.lit("a b c d e f g h i j"), F.lit("A b, c d e f g h i x"))) and not one(pages.covers(F.lit("a"), F.lit("a a b"))) and one(pages.covers(F.lit("x"), F.lit("--")))


def test_malformed_tables_and_margins(spark, one):
    assert pages.has_malformed_table("|a|b|\n|---|---|\n|1|\n") and not pages.has_malformed_table("|a|b|\n|---|---|\n|1|2|\n") and pages.has_malformed_table("|a|\n|---|\n")
    assert one(pages.margin_line(F.lit("## **Công ty  ABC** "))) == "## công ty abc" and one(pages.margin_line(F.lit("|a table row|"))) is None and one(pages.margin_line(F.lit("short"))) is None
    df = spark.createDataFrame([("d", i, f"CÔNG TY CỔ PHẦN X\nbody {i}\n\nTrang {i}") for i in range(5)] + [("e", 0, "CÔNG TY CỔ PHẦN X\nz")], "d string, p int, t string")
    got = {(r.d, r.p): r.t for r in pages.without_margins(df, "d", "p", "t").collect()}
    assert got[("d", 3)] == "body 3\n\nTrang 3" and got[("e", 0)] == "CÔNG TY CỔ PHẦN X\nz"


def test_small_page_functions(one):
    zero = F.lit(0.0)
    assert one(pages.is_speech(F.lit("xin chào"), zero, 0.6)) and not any(one(pages.is_speech(F.lit(t), zero, 0.6)) for t in ("", "[noise]", "(x)", "♪ Music ♪", "im lặng")) and not one(pages.is_speech(F.lit("x"), F.lit(0.7), 0.6))
    assert one(pages.pending_artifacts(F.lit("a <!-- OCR_PENDING:p1.jpg --> <!-- OCR_PENDING:p1.jpg --> <!-- OCR_PENDING:../x -->"))) == ["p1.jpg"]
    assert one(pages.without_fence(F.lit("```markdown\n# a\n```\n"))) == "# a" and one(pages.without_fence(F.lit("```\na\n``` b"))) == "```\na\n``` b"
    assert pages.answer_pieces("a " * 30) == [" ".join("a" * 24), " ".join("a" * 6)] and pages.answer_pieces("") == [""]
    assert tuple(one(pages.source_anchor(F.lit("pptx"), F.lit("Slide 12 x")))) == (12, None) and tuple(one(pages.source_anchor(F.lit("xlsx"), F.lit("A > Bảng 1")))) == (None, "Bảng 1")
    assert pages.verified_quote("x\r\ny z", "x\ny z", 0, (2, 3), (3, 4), "y") and not pages.verified_quote("x\r\ny z", "x\ny z", 0, (2, 3), (2, 3), "y")
    assert one(pages.corpus_issues(F.lit("csv"), F.lit(10), F.lit("a,b"))) == ["error:no_table"] and one(pages.corpus_issues(F.lit("text"), F.lit(100), F.lit("x"))) == ["warning:size"]
    assert pages.word_error_rate("a b c", "a x c d") == pytest.approx(2 / 3) and pages.word_error_rate("", "") == 0


def test_access(spark):
    c = spark.createDataFrame([(1, "org", "u1"), (2, "private", "u2"), (3, "private", "u3"), (4, "private", "u3")], "collection_id int, visibility string, owner_id string")
    g = spark.createDataFrame([(3, "g1", "read"), (4, "g1", "none")], "collection_id int, principal_id string, access_level string")
    assert [r.collection_id for r in service.visible(c, g, ["g1"], "u2").orderBy("collection_id").collect()] == [1, 2, 3]
    assert [r.collection_id for r in service.visible(c, g, ["g1"], "u9", "write").collect()] == [1]
    v = spark.createDataFrame([("a", True), ("b", False)], "version_id string, is_current boolean")
    assert [service.narrowed(v, x).count() for x in (None, ["b"], [])] == [1, 1, 0]
    assert service.optional(v, version_id=None, is_current=True).count() == 1
    assert service.authorised(v.select("version_id"), v, "version_id", is_current=True).count() == 1
    with pytest.raises(PermissionError):
        service.all_in_scope(v, v.where("is_current"), "version_id")


def test_quotas(spark, one):
    limits = spark.createDataFrame([("a", 10), ("b", 5)], "org_id string, limit int")
    used = spark.createDataFrame([("a", 3), ("a", 2)], "org_id string, amount int")
    held = spark.createDataFrame([("a", 4, "reserved", T0 + dt.timedelta(1)), ("a", 9, "reserved", T0)], "org_id string, amount int, state string, expires_at timestamp")
    q = service.quota(limits, used, held, F.lit(T0))
    assert rows(q) == [("a", 10, 5, 4, 1), ("b", 5, 0, 0, 5)]
    asks = spark.createDataFrame([("a", 2), ("b", 5), ("c", 1)], "org_id string, amount int")
    assert {r.org_id: r.outcome for r in service.reserve(q, asks).collect()} == {"a": "exceeded", "b": "reserved", "c": "unconfigured"}
    assert tuple(one(service.settled(F.lit(5), F.lit(3)))) == (3, 2, 0) and tuple(one(service.settled(F.lit(5), F.lit(7)))) == (5, 0, 2)
    counters = spark.createDataFrame([("a", 1), ("b", 0)], "org_id string, value int")
    assert rows(service.counter_drift(counters, spark.createDataFrame([("a", 2), ("z", 9)], "org_id string, value int"))) == [("a", 1, 2)]


def test_reconciliation_and_jobs(spark):
    e = spark.createDataFrame([("a", "h", 1), ("b", "h", 2), ("c", None, 3)], "k string, hash string, size int")
    seen = spark.createDataFrame([("a", "h", 1), ("c", "x", 3), ("d", "h", 1)], "k string, hash string, size int")
    got = service.reconciled(e, seen, "k", ["hash", "size"])
    assert rows(got) == [("a", "ok"), ("b", "missing"), ("c", "ok"), ("d", "orphan")]
    assert [r.k for r in service.to_repair(got.where("state = 'missing'"), got.where("state = 'orphan'"), "k").collect()] == ["b", "d"]
    good = "01234567-89ab-cdef-0123-456789abcdef"
    log = spark.createDataFrame([(1, f'{{"job_id": "{good}"}}', None), (2, '{"jobId": "bad"}', None), (3, "{}", "kept")], "id int, payload string, job_id string")
    assert [r.job_id for r in service.backfilled(log, "payload", ["job_id", "jobId"], spark.createDataFrame([(good,)], "job_id string"), "job_id").orderBy("id").collect()] == [good, None, "kept"]
    s = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(9))], "sid int, until timestamp")
    left, events, gone = service.purge_expired(s, spark.createDataFrame([(1,), (2,)], "sid int"), "sid", "until", F.lit(T0), 0)
    assert (rows(left.select("sid")), rows(events), rows(gone)) == ([(2,)], [(2,)], [(1,)])
    p = spark.createDataFrame([("running", T0), ("running", T0 + dt.timedelta(seconds=50)), ("done", T0)], "state string, beat timestamp")
    assert [r.state for r in service.recovered(p, "beat", F.lit(T0 + dt.timedelta(seconds=60)), 30).collect()] == ["failed", "running", "done"]
    jobs = spark.createDataFrame([(1, 0, "pending"), (2, 0, "done"), (3, 9, "leased")], "job_id int, parent_id int, state string")
    assert {r.job_id: r.state for r in service.cancelled(jobs, spark.createDataFrame([(0,)], "job_id int")).collect()} == {1: "cancelled", 2: "done", 3: "leased"}


def test_generations_and_conflicts(spark):
    g = spark.createDataFrame([(1, "c", "active", "s1", "o"), (2, "c", "shadow", "s2", "o"), (3, "d", "active", "s1", "p")], "generation_id int, collection_id string, state string, signature string, org_id string")
    after = service.cut_over(g, F.lit("c"))
    assert {r.generation_id: r.state for r in after.collect()} == {1: "draining", 2: "active", 3: "active"}
    assert service.consistent(g, "s1") and not service.consistent(after, "s1") and service.consistent(g.limit(0), "s1")
    chunks = spark.createDataFrame([(1, "s1"), (2, "s1"), (7, None)], "generation_id int, signature string")
    assert [r.generation_id for r in service.signature_violations(chunks, g).collect()] == [2]
    c = spark.createDataFrame([(1, 10, 20, "open", T0), (2, 20, 10, "open", T0), (3, 10, 20, "closed", T0)], "conflict_id int, claim_a_id int, claim_b_id int, status string, detected_at timestamp")
    claims = spark.createDataFrame([(10, "x"), (20, "y")], "claim_id int, v string")
    assert [(r.conflict_id, r.claim_a.v, r.claim_b.v) for r in service.open_conflicts(c, claims).collect()] == [(1, "x", "y")]
    done = service.triaged(c, spark.createDataFrame([(1, "resolved"), (3, "open")], "conflict_id int, status string"))
    assert {r.conflict_id: r.status for r in done.collect()} == {1: "resolved", 2: "open", 3: "closed"}
    docs = spark.createDataFrame([("d", "v1", False, None), ("d", "v2", True, None), ("e", "v3", True, T0)], "document_id string, version_id string, is_current boolean, deleted_at timestamp")
    assert rows(service.seeded(docs, chunks.selectExpr("'v9' AS version_id"))) == [("d", "v2")]
    assert rows(service.purge_plan(chunks, g, "signature")) == [("s1",), ("s2",)]
    ops = spark.createDataFrame([(1, "open", T0), (2, "done", T0)], "operation_id int, state string, updated_at timestamp")
    assert service.stale_operations(ops, ["open"], F.lit(T0 + dt.timedelta(1)), 5).count() == 1


def test_forecast_and_tree(spark):
    q = service.queue_forecast(spark.createDataFrame([(100.0, 50.0, 60.0), (10.0, 50.0, 60.0)], "arrivals double, service double, minutes double")).collect()
    assert [(r.queue, r.oldest_minutes, r.stable) for r in q] == [(50.0, 30.0, False), (0.0, 0.0, True)]
    assert rows(service.tree_nodes(spark.createDataFrame([("a/b.md",), ("a/c/d.md",)], "p string"), "p")) == [("a", "a", 1), ("a/b.md", "b.md", 2), ("a/c", "c", 2), ("a/c/d.md", "d.md", 3)]


def test_folders(spark, tmp_path):
    for name in ("a.PDF", ".hidden.pdf", "b.txt", "~$c.pdf"):
        (tmp_path / name).write_text("x")
    assert {os.path.basename(r.path): r.format for r in watch.listing(spark, f"file://{tmp_path}").collect()}["a.PDF"] == "pdf"
    q = watch.watched(spark, f"file://{tmp_path}", "*.pdf").select("path").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [os.path.basename(r.path) for r in spark.table("seen").collect()] == ["a.PDF"]
    files = spark.createDataFrame([("a", T0), ("b", T0), ("c", T0)], "path string, modificationTime timestamp")
    seen = spark.createDataFrame([("r", "a", T0), ("r", "b", T0 - dt.timedelta(1)), ("q", "c", T0)], "rule string, path string, modificationTime timestamp")
    assert [r.path for r in watch.unseen(files, seen, "r").orderBy("path").collect()] == ["b", "c"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1), ('a"b', -2)], "c string, n int")
    sinks.write_csv(df, f"file://{tmp_path}/csv")
    back = spark.read.option("header", "true").option("escape", '"').csv(f"file://{tmp_path}/csv")
    assert rows(back) == [("'=1+1", "1"), ('a"b', "-2")]
    items = spark.createDataFrame([("FR", "FR-001", "x"), ("BR", "BR-001", "y")], "kind string, item_id string, text string")
    data = sinks.pack(sinks.handoff_artifacts(items))
    assert data == sinks.pack(sinks.handoff_artifacts(items)) and set(zipfile.ZipFile(io.BytesIO(data)).namelist()) == {"FR.md", "BR.md", "manifest.json"}
    with pytest.raises(ValueError):
        sinks.handoff_artifacts(items, limit=1)
    s = spark.createDataFrame([("m", 'a="b"', 0.5), ("m", 'a="b"', 3.0)], "name string, labels string, value double")
    assert [r.line for r in sinks.exposition(s, (1.0, 2.0)).orderBy("position").collect()] == ['m_bucket{a="b",le="1.0"} 1', 'm_bucket{a="b",le="2.0"} 1', 'm_bucket{a="b",le="+Inf"} 2', 'm_sum{a="b"} 3.5', 'm_count{a="b"} 2']
