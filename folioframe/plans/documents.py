"""Document queries: quality, personal data, chunks, tables, claims and conversations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import numbers, text
from folioframe.operators import claims, markdown, pii
from folioframe.plans.registry import query
from folioframe.session import table
from folioframe.sources import convert


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def as_markdown(docs: DataFrame) -> DataFrame:
    """The documents as Markdown: source and language as headings, each line a paragraph."""
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_rel"), F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("markdown"))


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten parts to a table of claims, one table to a document."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).cast("string").alias("doc"), F.struct("p_partkey", F.array(F.concat(F.lit("k"), F.col("p_partkey").cast("string")), "p_brand", F.lit("size"), F.col("p_size").cast("string"), F.lit("cm"))).alias("r"))
    body = F.transform(F.sort_array(F.collect_list("r")), lambda x: x["col2"])  # a document's own rows
    head = F.array(*(F.lit(x) for x in ("key", "subject", "predicate", "value", "unit")))
    return rows.groupBy("doc").agg(text.markdown_table(F.concat(F.array(head), body)).alias("markdown")).withColumnRenamed("doc", "source_rel")


#: A run of five of any letter or digit that occurs, one alternative for each.
_RUN = r"run AS (SELECT string_agg(c || '{{5}}', '|') AS p FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE regexp_matches(c, '^[\pL\pN]$'))".replace("{{", "{").replace("}}", "}")


@query(
    "quality_report",
    rf"""WITH {_RUN}, q AS (SELECT doc_id, length(text) AS chars, list_filter([CASE WHEN length(text) < 80 THEN 'SHORT_CONTENT' END, CASE WHEN contains(text, chr(65533)) THEN 'REPLACEMENT_CHARACTER' END,
                  CASE WHEN contains(text, '<!-- Trang') AND contains(text, '(OCR)') THEN 'OCR_CONTENT' END, CASE WHEN regexp_matches(text, p) THEN 'REPEATED_RUN' END], lambda x: x IS NOT NULL) AS i FROM documents, run)
       SELECT doc_id, chars, array_to_string(i, ',') AS issues, round(greatest(1 - list_sum(list_concat([0.0::DOUBLE], list_transform(i, lambda x: CASE x WHEN 'REPLACEMENT_CHARACTER' THEN 0.3 WHEN 'OCR_CONTENT' THEN 0.04 ELSE 0.12 END::DOUBLE))), 0), 6) AS score FROM q""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues and score of each document."""
    report = markdown.quality_report(_docs(spark, sf_dir), "doc_id", "text")
    return report.select("doc_id", "chars", F.array_join("issues", ",").alias("issues"), F.round("score", 6).alias("score"))


@query("repeated_run_flag", f"WITH {_RUN} SELECT doc_id, regexp_matches(text, p) AS repeated FROM documents, run")
def repeated_run_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a letter or digit stands five times in a row."""
    return _docs(spark, sf_dir).select("doc_id", text.repeated_run(F.col("text")).alias("repeated"))


@query("mean_quality", "SELECT lang, round(avg(greatest(1 - CASE WHEN length(text) < 80 THEN 0.12 ELSE 0 END, 0)), 9) AS mean, count(*) FILTER (length(text) < 80) AS n_short FROM documents GROUP BY 1")
def mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score and short documents by language."""
    short = F.length("text") < 80
    return _docs(spark, sf_dir).groupBy("lang").agg(F.round(F.avg(F.when(short, 0.88).otherwise(1.0)), 9).alias("mean"), F.count_if(short).alias("n_short"))


@query("email_findings", r"SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS email FROM documents")
def email_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by a plain pattern; pii_report has the strict scanner."""
    found = F.regexp_extract_all(F.col("text"), F.lit(r"([A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), F.lit(1))
    return _docs(spark, sf_dir).where(F.contains("text", F.lit("@"))).select("doc_id", F.explode(found).alias("email"))


@query("pii_report")
def pii_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of personal data."""
    return pii.detect(_docs(spark, sf_dir), "doc_id")


@query("pii_counts")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by kind."""
    return pii.counts(pii.detect(_docs(spark, sf_dir), "doc_id"))


@query("pii_redact")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their personal data."""
    return _docs(spark, sf_dir).select("doc_id", pii.redacted("text").alias("text"))


@query("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their place and identity."""
    return markdown.build_corpus(as_markdown(_docs(spark, sf_dir))).drop("text")


@query("chunk_sizes")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each document has, and how many characters they and the longest of them have."""
    chunks = markdown.build_corpus(as_markdown(_docs(spark, sf_dir)))
    return chunks.groupBy("source_rel").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


@query("table_extract", "SELECT CAST(p_partkey % 97 AS VARCHAR) AS source_rel, count(*) + 1 AS n_rows, 5 AS n_columns FROM part GROUP BY 1")
def table_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables read back out of Markdown."""
    found = markdown.extract_tables(part_tables(spark, sf_dir))
    return found.select("source_rel", F.size("rows").cast("long").alias("n_rows"), F.size(F.get("rows", F.lit(0))).alias("n_columns"))


@query("schema_infer", "SELECT DISTINCT CAST(p_partkey % 97 AS VARCHAR) AS source_rel, f.name, f.type FROM part, (VALUES ('key', 'String'), ('subject', 'String'), ('predicate', 'String'), ('value', 'Number'), ('unit', 'String')) f(name, type)")
def schema_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and types of the tables."""
    return markdown.infer_schema(part_tables(spark, sf_dir)).select("source_rel", "name", "type")


@query("typed_claims", "SELECT CAST(p_partkey % 97 AS VARCHAR) AS source_rel, 'k' || p_partkey AS claim_key, p_brand AS subject, 'number' AS value_type, CAST(p_size AS VARCHAR) AS value FROM part")
def typed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims out of the tables."""
    return claims.extract_claims(part_tables(spark, sf_dir), "source_rel").select("source_rel", "claim_key", "subject", "value_type", "value")


@query(
    "typed_values",
    """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '1.000' WHEN 1 THEN '1.000.000' WHEN 2 THEN '2,5' WHEN 3 THEN '1.234,5' ELSE CAST(o_orderkey AS VARCHAR) END AS raw FROM orders)
       SELECT o_orderkey, coalesce(CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1000000 WHEN 2 THEN 2.5 WHEN 3 THEN 1234.5 ELSE o_orderkey END, -1)::DOUBLE AS value FROM s""",
)
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in either locale; what could be read in two ways is none."""
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "1.000").when(k == 1, "1.000.000").when(k == 2, "2,5").when(k == 3, "1.234,5").otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(numbers.decimal_or_null(raw).cast("double"), F.lit(-1.0)).alias("value"))


@query("html_to_text")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown."""
    return table(spark, sf_dir, "pages").select("page_id", convert.html_to_markdown("html").alias("markdown"))


@query(
    "title_and_truncate",
    "SELECT doc_id, left(regexp_extract(text, '[^\n]*'), 240) AS title, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS text FROM documents",
)
def title_and_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines as titles, and texts cut to a length."""
    md = F.concat(F.lit("# "), F.regexp_extract("text", "[^\n]*", 0))
    return _docs(spark, sf_dir).select("doc_id", text.title(md, F.lit("")).alias("title"), text.truncated(F.col("text"), 500, "...").alias("text"))


@query("requirements")
def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement lines of the conversations, numbered."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("source_rel"), "text")
    return claims.numbered(claims.requirement_lines(turns, "source_rel"), ["source_rel"], ["line"])


_any = lambda names: "|".join(map(re.escape, claims.forms(names))).replace("'", "''")
_LOW = r"trim(regexp_replace(regexp_replace(lower(trim(text)), '[?!.,;:\u2026\u00bf\u00a1]', ' ', 'g'), '\s+', ' ', 'g'))".encode().decode("raw_unicode_escape")


@query(
    "ask_route",
    f"""SELECT conv_id, turn, CASE WHEN low = '' OR regexp_matches(low, '{_any(claims.KNOWLEDGE)}') THEN 'knowledge'
            WHEN length(low) <= 96 AND (regexp_full_match(low, '{_any(claims.GREETINGS)}') OR (length(low) <= 64 AND regexp_matches(low, '^({_any(claims.OPENINGS)})')) OR (length(low) <= 80 AND regexp_matches(low, '{_any(claims.SMALL_TALK)}'))) THEN 'assistant'
            ELSE 'none' END AS route FROM (SELECT conv_id, turn, {_LOW} AS low FROM conversations WHERE role = 'user')""",
)
def ask_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the user's turns."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.coalesce(claims.ask_route(F.col("text")), F.lit("none")).alias("route"))


@query("turn_sequence", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS previous FROM conversations")
def turn_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order, each with the role before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("n"), F.coalesce(F.lag("role").over(w), F.lit("")).alias("previous"))


@query("slugs", r"SELECT doc_id, regexp_replace(lower(regexp_replace(replace(lower(strip_accents(regexp_extract(text, '[^\n]*'))), 'đ', 'd'), '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') AS slug FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of the texts' first lines, which are their titles."""
    return _docs(spark, sf_dir).select("doc_id", text.folded_slug(F.regexp_extract("text", "[^\\n]*", 0)).alias("slug"))


@query(
    "margin_lines",
    """WITH l AS (SELECT source, doc_id, unnest([string_split(text, chr(10))[1], string_split(text, chr(10))[-1]]) AS line FROM documents), n AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1)
       SELECT source, line, count(DISTINCT doc_id) AS n_pages FROM l JOIN n USING (source) WHERE length(line) BETWEEN 8 AND 400 AND pages >= 4 GROUP BY source, line, pages HAVING count(DISTINCT doc_id) >= greatest(3, ceil(pages / 20.0))""",
)
def margin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines that many pages of a source share, as page headers do; here a twentieth of them, for these are no pages of one document."""
    docs = _docs(spark, sf_dir)
    pages = docs.groupBy("source").agg(F.count("*").alias("pages"))
    lines = F.split("text", "\n")
    margin = docs.select("source", "doc_id", F.explode(F.array(F.element_at(lines, 1), F.element_at(lines, -1))).alias("line")).where("length(line) between 8 and 400").distinct()
    counted = margin.groupBy("source", "line").agg(F.count("*").alias("n_pages")).join(pages, "source")
    return counted.where((F.col("pages") >= 4) & (F.col("n_pages") >= F.greatest(F.lit(3), F.ceil(F.col("pages") / 20)))).select("source", "line", "n_pages")


@query("benchmark_overlap", "SELECT doc_id, item_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item word for word: items meet documents by their first whole words behind the
    very first, five at most, and the meeting ones are compared whole. Items without such a word, of two words or fewer,
    are a stated set of queries against all documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"), F.split("text", r"[ \n]").alias("w"))
    lead = F.least(F.size("w") - 2, F.lit(5))
    keyed = items.where("size(w) > 2").select("item_id", "item", F.array_join(F.slice("w", F.lit(2), lead), " ").alias("k"), lead.alias("g"))
    sizes = [r["g"] for r in keyed.select("g").distinct().collect()]  # five at most
    words = F.array(F.split("text", r"[ \n]"))

    def grams(g: int) -> Column:
        return F.transform(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - g + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, g), " "))))[0]

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    short = docs.join(F.broadcast(items.where("size(w) <= 2").select("item_id", "item")), F.contains("text", F.col("item"))).select("doc_id", "item_id")
    if not sizes:
        return short
    leads = reduce(DataFrame.union, [docs.select("doc_id", F.explode(grams(g)).alias("k"), F.lit(g).alias("g")) for g in sizes])
    met = leads.join(keyed, ["k", "g"]).select("doc_id", "item_id", "item").distinct()
    return met.join(docs, "doc_id").where(F.contains("text", F.col("item"))).select("doc_id", "item_id").union(short)
