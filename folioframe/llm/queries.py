"""The queries of the subpackage, one for each operator, and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import byte_bpe, nearest, oracles, packing, quality_classifier, secret_scan, url_filter
from folioframe.llm.jaccard_join import Threshold, jaccard_groups
from folioframe.llm.language_model import score_texts
from folioframe.llm.passages import find_passages
from folioframe.llm.quality_rules import judge


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("broken_rules")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = packing.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, size=4096, end_id=1, payload="crc32")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where(quality_classifier.fold(labels["doc_id"], 5) != 0)
    model = quality_classifier.train(quality_classifier.training_rows(docs, learn, "quality"))
    scored = quality_classifier.score(docs, model)
    held_out = quality_classifier.fold(scored["doc_id"], 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_texts(docs, quality_classifier.fold(docs["doc_id"], 10) != 0)
    held_out = quality_classifier.fold(scored["doc_id"], 10) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secret_scan.ranked_words(public_tokenizers.path("word_bpe_49k.json"), [public_tokenizers.path("byte_bpe_multi_50k.tiktoken")])
    return secret_scan.digest(secret_scan.find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=words))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, threshold=Threshold(9, 10))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.nearest(vectors, vectors["vec_id"] % 20 == 0, k=20)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_url_filter, op4_substring_dedup, op5_best_fit_packing, op6_lm_scoring, op7_secret_scan, op8_ngram_jaccard_join, op9_byte_bpe, op10_nearest, pipeline)}
ORACLE = {k: v for k, v in vars(oracles).items() if k in QUERIES}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
