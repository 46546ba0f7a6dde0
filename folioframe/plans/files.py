"""Queries over files and their contents: routing, watched names, margins, prompts, and what an index does with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text
from folioframe.operators import markdown, pages, service, tables
from folioframe.plans.registry import query
from folioframe.session import table
from folioframe.sources import formats, sinks, watch

#: Endings that the pages' files get in turn.
ENDINGS = (".html", ".PDF", ".docx", ".Md", ".tsv", ".xlsm", ".m4a", ".bin", "", ".html.part", ".html~")
_NAME = f"CASE WHEN page_id % 7 = 0 THEN '.' WHEN page_id % 7 = 1 THEN '~$' ELSE '' END || 'page' || page_id || [{', '.join(repr(e) for e in ENDINGS)}][page_id % {len(ENDINGS)} + 1]"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as files of a folder, some of them hidden, locked or unfinished."""
    prefix = F.when(F.col("page_id") % 7 == 0, ".").when(F.col("page_id") % 7 == 1, "~$").otherwise("")
    ending = F.get(F.array(*(F.lit(e) for e in ENDINGS)), (F.col("page_id") % len(ENDINGS)).cast("int"))
    name = F.concat(prefix, F.lit("page"), F.col("page_id").cast("string"), ending)
    return table(spark, sf_dir, "pages").select("page_id", "html", name.alias("name"), F.concat(F.lit("in/"), name).alias("path"))


@query(
    "format_routing",
    f"""WITH f AS (SELECT page_id, lower(regexp_extract({_NAME}, '[^.~$]\\.([^.]+)$', 1)) AS e FROM pages)
        SELECT page_id, CASE e WHEN 'html' THEN 'html' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'md' THEN 'text' WHEN 'tsv' THEN 'csv' WHEN 'xlsm' THEN 'xlsx' WHEN 'm4a' THEN 'audio' END AS format FROM f""",
)
def format_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each file by its name."""
    return _files(spark, sf_dir).select("page_id", formats.format_of(F.col("path")).alias("format"))


@query(
    "magic_kinds",
    f"""WITH f AS (SELECT page_id, CASE WHEN regexp_matches(lower(left(html, 500)), '^\\s*(<!doctype html|<html|<head|<body)') THEN 'html' ELSE 'text' END AS magic, lower(regexp_extract({_NAME}, '[^.~$]\\.([^.]+)$', 1)) AS e FROM pages)
        SELECT page_id, magic, CASE magic WHEN 'html' THEN e NOT IN ('html', 'htm', 'txt', 'md') ELSE e NOT IN ('txt', 'md', 'markdown', 'log', 'csv', 'tsv', 'html', 'htm') END AS spoofed FROM f""",
)
def magic_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind that each file's first bytes tell, and whether its name says another."""
    content = F.encode("html", "UTF-8")
    return _files(spark, sf_dir).select("page_id", formats.magic(content).alias("magic"), formats.spoofed(F.col("path"), content).alias("spoofed"))


@query("watched_names", f"SELECT page_id FROM (SELECT page_id, {_NAME} AS name FROM pages) WHERE lower(name) LIKE '%page__.h%' AND left(name, 1) <> '.' AND left(name, 2) <> '~$' AND right(name, 5) <> '.part' AND right(name, 1) <> '~'")
def watched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that fit a rule's pattern and are neither hidden nor unfinished."""
    name = F.col("name")
    return _files(spark, sf_dir).where(text.glob_matches(name, "*PAGE??.h*") & ~text.hidden_or_temporary(name)).select("page_id")


@query("unseen_files", "SELECT a.event_id FROM events a LEFT JOIN (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'signup' GROUP BY 1) s USING (user_id) WHERE a.event_type <> 'signup' AND (s.last IS NULL OR a.ts > s.last)")
def unseen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of files: those later than what the rule has seen of their file."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("path"), F.col("ts").alias("modificationTime"))
    seen = events.where("event_type = 'signup'").select(F.lit("r").alias("rule"), "path", "modificationTime")
    return watch.unseen(events.where("event_type <> 'signup'"), seen, "r").select("event_id")


def _chunk(k: Column) -> Column:
    return F.when(k % 3 == 0, F.concat(F.lit("<!-- Page "), k.cast("string"), F.lit(" -->\n\n<!-- Trang 2 (OCR) -->"))).when(k % 3 == 1, F.concat(F.lit("<!-- Page 1 -->\n"), F.col("text"))).otherwise(F.col("text"))


@query("marker_only_chunks", "SELECT doc_id, doc_id % 3 = 0 OR trim(replace(coalesce(text, ''), chr(10), '')) = '' AS marker FROM documents WHERE text IS NOT NULL")
def marker_only_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunks hold nothing but page comments."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", text.marker_only(_chunk(F.col("doc_id"))).alias("marker"))


@query("prompt_data", "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages")
def prompt_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as it may stand inside a prompt, by digest."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.encode(text.untrusted(F.col("html")), "UTF-8")).alias("digest"))


@query("speech_segments", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND turn % 4 <> 3 AND conv_id % 5 <> 0 AND conv_id % 5 <> 1")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments of a transcript, some of them music or in brackets: those that are speech."""
    k = F.col("conv_id") % 5
    rows = table(spark, sf_dir, "conversations").withColumn("said", F.when(k == 0, F.lit(" ♪ Music ♪")).when(k == 1, F.lit("[door closes]")).otherwise(F.col("text")))
    return rows.where(pages.is_speech(F.col("said"), F.col("turn") % 4 / 4, 0.75)).select("conv_id", "turn")


@query("margins_removed", "SELECT conv_id, turn, md5(text) AS digest FROM (SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) >= 4 THEN text ELSE 'Internal draft, do not share' || chr(10) || text END AS text FROM conversations)")
def margins_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages under one header line, without it wherever there are pages enough to tell."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Internal draft, do not share\n"), "text").alias("text"))
    return pages.without_margins(rows, "conv_id", "turn", "text").select("conv_id", "turn", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("source_anchors", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS slide, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'SLIDE ' || p_size ELSE p_brand END END AS sheet FROM part")
def source_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slide or sheet that a heading path names."""
    last = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("SLIDE "), F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))
    anchor = pages.source_anchor(F.when(F.col("p_partkey") % 3 == 0, "xlsx").otherwise("pptx"), F.concat(F.lit("Báo cáo > "), last))
    return table(spark, sf_dir, "part").select("p_partkey", anchor.alias("a")).select("p_partkey", "a.slide", "a.sheet")


@query(
    "conversion_issues",
    """SELECT page_id, array_to_string(list_filter([CASE WHEN contains(html, chr(65533)) THEN 'error:replacement' END, CASE WHEN page_id % 3 = 0 AND length(html) < 500 THEN 'error:short' END,
              CASE WHEN page_id % 3 = 1 AND NOT contains(html, '|') AND length(html) > 0 THEN 'error:no_table' END, CASE WHEN page_id % 3 = 2 AND (contains(lower(html), '<script') OR contains(lower(html), '<style')) THEN 'error:script' END], lambda x: x IS NOT NULL), ',') AS issues FROM pages""",
)
def conversion_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each page, were it the outcome of a conversion."""
    family = F.get(F.array(F.lit("pdf"), F.lit("csv"), F.lit("html")), (F.col("page_id") % 3).cast("int"))
    issues = pages.corpus_issues(family, F.octet_length("html"), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(issues, ",").alias("issues"))


@query(
    "document_diff",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Unchanged' WHEN 1 THEN 'Added' ELSE 'Modified' END AS kind, CASE doc_id % 3 WHEN 0 THEN md5(text) WHEN 1 THEN md5('one more line') ELSE md5('another first line') END AS new_text
       FROM documents WHERE text IS NOT NULL AND text <> ''""",
)
def document_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two states of a document: nothing, a line at the end, or the first line."""
    k, t = F.col("doc_id") % 3, F.col("text")
    new = F.when(k == 1, F.concat(F.regexp_replace(t, r"\n+$", ""), F.lit("\none more line"))).when(k == 2, F.concat(F.lit("another first line"), F.regexp_extract(t, r"^[^\n]*([\s\S]*)$", 1))).otherwise(t)
    old = F.when(k == 1, F.regexp_replace(t, r"\n+$", "")).otherwise(t)
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", markdown.diff_markdown(old, new).alias("d")).select("doc_id", "d.kind", F.md5(F.encode("d.new_text", "UTF-8")).alias("new_text"))


@query(
    "metrics_exposition",
    """WITH g AS (SELECT event_type, count(*) FILTER (floor(value) <= 10) AS a, count(*) FILTER (floor(value) <= 100) AS b, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS s FROM events GROUP BY 1),
       l AS (SELECT event_type, unnest(['latency_bucket{kind="' || event_type || '",le="10"} ' || a, 'latency_bucket{kind="' || event_type || '",le="100"} ' || b, 'latency_bucket{kind="' || event_type || '",le="+Inf"} ' || n,
             'latency_sum{kind="' || event_type || '"} ' || s, 'latency_count{kind="' || event_type || '"} ' || n]) AS line FROM g) SELECT line FROM l""",
)
def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of each kind of event as lines of text."""
    labels = F.concat(F.lit('kind="'), "event_type", F.lit('"'))
    samples = table(spark, sf_dir, "events").select(F.lit("latency").alias("name"), labels.alias("labels"), F.floor("value").alias("value"))
    return sinks.exposition(samples, (10, 100)).select("line")


@query("index_replace", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, 1, sum(l_quantity) FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1")
def index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after some of its groups were made anew."""
    there = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_quantity")
    new = there.where("l_orderkey % 5 = 0").groupBy("l_orderkey").agg(F.lit(1).alias("l_linenumber"), F.sum("l_quantity").alias("l_quantity"))
    return tables.replace_group(there, new, "l_orderkey")


@query("optional_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a status and of any priority, for none is asked for."""
    return service.optional(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=None).select("o_orderkey")


@query("scope_guard", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer)")
def scope_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of candidates, all of them in scope; one that isn't would refuse the whole batch."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    return service.all_in_scope(orders.join(customers, "o_custkey", "left_semi").select("o_orderkey", "o_custkey"), customers, "o_custkey")


@query(
    "open_conflicts",
    """SELECT o_orderkey AS conflict_id, a.c_name AS name_a, b.c_name AS name_b FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 10 < 9 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100) o
       JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = o_custkey + 1""",
)
def open_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest open conflicts with both sides' claims."""
    status = F.when((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 10 < 9), "open").otherwise("resolved")
    conflicts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conflict_id"), F.col("o_custkey").alias("claim_a_id"), (F.col("o_custkey") + 1).alias("claim_b_id"), F.col("o_orderdate").alias("detected_at"), status.alias("status"))
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim_id"), "c_name")
    return service.open_conflicts(conflicts, claims).select("conflict_id", F.col("claim_a.c_name").alias("name_a"), F.col("claim_b.c_name").alias("name_b"))
