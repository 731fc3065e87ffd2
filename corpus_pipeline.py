"""A corpus pipeline of five stages over ``documents``: each is written as Parquet and read again by the next.

Counted as part of the ``llm`` subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm import decontaminate, jaccard, mixing, quality, tokens
from terrazzo.llm.common import table
from terrazzo.plans.durable import broadcast_if_small, materialize
from terrazzo.plans.ship import ship_package

#: The stages that classify and match words have no SQL.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the co-trained quality classifier rejects."""
    ship_package(spark)
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at 0.8 on five-word shingles: the one with the smallest id."""
    ship_package(spark)
    found = jaccard.jaccard_components(docs, width=5, num=80, den=100)
    gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if_small(gone, 500_000), "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 0.8 of a benchmark item's words in tiles of five or more."""
    ship_package(spark)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = materialize(found.select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if_small(gone, 500_000), "doc_id", "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Resamples sources to the temperature at which their weights have 0.98 of uniform entropy."""
    return mixing.mix_documents(docs, target_entropy=0.98, seed=1)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns their per-document index, read back from them."""
    import public_tokenizers

    ship_package(spark)
    return tokens.read_ids(spark, tokens.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
