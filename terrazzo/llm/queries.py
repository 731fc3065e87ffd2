"""The registered queries of this subpackage: ``opN_<name>`` with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, line_dedup, mixing, pii, quality, suffix_dedup, tokens, topk, urls
from .common import table


def op1_topk_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, F.expr("coalesce(vec_id % 50 = 0, false)"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix_schedule(docs, target_entropy=0.98, seed=1)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return suffix_dedup.dedup_substrings(docs, length=200, keep_text=False).drop("kept")


def op4_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its scores, and whether the classifier keeps it."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).withColumn("keep", F.col("score") >= 0.5)


def op5_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return urls.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokens.read_ids(spark, tokens.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op9_jaccard_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), width=4, num=85, den=100)


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_topk_kdtree, op2_temperature_mixing, op3_suffix_dedup, op4_quality_cotraining, op5_greedy_tiling, op6_url_trust, op7_line_dedup, op8_rans_tokens, op9_jaccard_partition, op10_pii_crf)}
