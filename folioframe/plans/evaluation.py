"""Evaluation queries: error rates, ranking measures and speed summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import numbers, text
from folioframe.plans.registry import query
from folioframe.session import table



@query(
    "cer_by_label",
    """WITH d AS (SELECT role, text AS a, lower(replace(text, 'th', 't')) AS b FROM conversations)
        SELECT role, count(*) AS n, round(avg(CASE WHEN length(a) = 0 THEN (length(b) > 0)::DOUBLE ELSE levenshtein(a, b)::DOUBLE / length(a) END), 9) AS cer FROM d GROUP BY 1""",
)
def cer_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean character error rate of a mangled copy of each turn, by role."""
    a = F.col("text")
    # edits take the square of a text's length: worth a shuffle where few files would make few tasks
    turns = table(spark, sf_dir, "conversations").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")
    rows = turns.select("role", a.alias("a"), F.lower(F.replace(a, F.lit("th"), F.lit("t"))).alias("b"))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(text.char_error_rate(F.col("a"), F.col("b"))), 9).alias("cer"))


@query(
    "retrieval_metrics",
    """WITH r AS (SELECT d.source AS query_id, l.quality + l.toxic AS grade, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) - 1 AS p FROM documents d JOIN labels l USING (doc_id)),
       i AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) - 1 AS p FROM r),
       a AS (SELECT query_id, sum((pow(2.0, grade) - 1) / log2(p + 2)) FILTER (p < 10) AS dcg, coalesce(max(1.0::DOUBLE / (p + 1)) FILTER (grade >= 2), 0) AS mrr,
                    count(*) FILTER (grade >= 2 AND p < 5) AS hit, count(*) FILTER (grade >= 2) AS relevant FROM r GROUP BY 1),
       b AS (SELECT query_id, sum((pow(2.0, grade) - 1) / log2(p + 2)) FILTER (p < 10) AS ideal FROM i GROUP BY 1)
       SELECT query_id, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg10, round(mrr, 6) AS mrr, round(coalesce(hit::DOUBLE / nullif(relevant, 0), 0), 6) AS recall5 FROM a JOIN b USING (query_id)""",
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG@10, MRR and Recall@5 of each query; labels are the judgments, length the ranking."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("query_id"), (F.col("quality") + F.col("toxic")).alias("grade"), "n_chars", "doc_id")
    own, best = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id"), Window.partitionBy("query_id").orderBy(F.desc("grade"))
    ranked = rows.select("query_id", "grade", (F.row_number().over(own) - 1).alias("p"), (F.row_number().over(best) - 1).alias("i"))
    good = F.col("grade") >= 2
    dcg = lambda at: F.sum(F.when(F.col(at) < 10, numbers.gain(F.col("grade"), F.col(at))))
    out = ranked.groupBy("query_id").agg(dcg("p").alias("dcg"), dcg("i").alias("ideal"), F.coalesce(F.max(F.when(good, 1 / (F.col("p") + 1))), F.lit(0.0)).alias("mrr"), F.count_if(good & (F.col("p") < 5)).alias("hit"), F.count_if(good).alias("relevant"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select("query_id", F.round(ratio("dcg", "ideal"), 6).alias("ndcg10"), F.round("mrr", 6).alias("mrr"), F.round(ratio("hit", "relevant"), 6).alias("recall5"))


@query(
    "speed_summary",
    """SELECT lang AS format, count(*) AS n, count(*) FILTER (n_chars > 0) AS ok, round(sum(n_chars) / 1024.0, 4) AS kb, round(avg(n_chars / 100.0), 4) AS ms_per_file,
              round(sum(n_chars) / 1024.0 / nullif(sum(n_chars / 100.0) / 1000.0, 0), 4) AS kb_per_s FROM documents GROUP BY 1""",
)
def speed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, volume and speed by format; a time of a hundredth of a millisecond a character stands for the measured one."""
    kb, ms = F.sum("n_chars") / 1024.0, F.sum(F.col("n_chars") / 100.0)
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("format")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 0).alias("ok"), F.round(kb, 4).alias("kb"), F.round(F.avg(F.col("n_chars") / 100.0), 4).alias("ms_per_file"), F.round(kb / F.nullif(ms / 1000.0, F.lit(0.0)), 4).alias("kb_per_s"))


@query(
    "capacity",
    "SELECT event_type AS format, round(3600 * count(*) / nullif(sum(value), 0), 4) AS docs_per_hour, round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95, round(max(value), 6) AS peak FROM events GROUP BY 1",
)
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents an hour and their percentiles by format; an event's value stands for its seconds."""
    v = F.col("value").cast("double")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("format")).agg(F.round(3600 * F.count("*") / F.nullif(F.sum("value"), F.lit(0.0)), 4).alias("docs_per_hour"), F.round(F.percentile(v, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.round(F.max("value"), 6).alias("peak"))


@query(
    "precision_recall",
    """WITH c AS (SELECT count(*) FILTER (n_chars >= 300 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 300 AND quality = 0) AS fp, count(*) FILTER (n_chars < 300 AND quality = 1) AS fn FROM documents JOIN labels USING (doc_id))
       SELECT tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 9) AS recall FROM c""",
)
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a rule against judgments; 0 where there is no sample."""
    said, true = F.col("n_chars") >= 300, F.col("quality") == 1
    c = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    ratio = lambda b: F.when(F.col("tp") + F.col(b) == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col(b)))
    return c.select("tp", "fp", "fn", F.round(ratio("fp"), 9).alias("precision"), F.round(ratio("fn"), 9).alias("recall"))


@query("batch_validity", "SELECT label, count(DISTINCT len(embedding)) = 1 AS one_size, bool_and(len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0) AS finite, count(*) FILTER (abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) - 1) <= 0.001) AS n_unit FROM embeddings GROUP BY 1")
def batch_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each batch of vectors has one size and finite numbers, and how many are of unit length."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg((F.min(F.size(v)) == F.max(F.size(v))).alias("one_size"), F.bool_and(F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("finite"), F.count_if(numbers.is_unit(v)).alias("n_unit"))


@query("token_budget", "SELECT conv_id, sum(greatest(1, ceil(length(text) / 4.0)))::BIGINT AS tokens, count(*) AS turns FROM conversations GROUP BY 1")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of each conversation."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(numbers.estimated_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("turns"))
