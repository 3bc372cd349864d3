"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage is ``function(spark, docs, sf_dir) -> DataFrame`` and works on
all rows its predecessor kept; ``run`` writes each stage's result as Parquet
in the shared scratch folder and rereads it as the next one's input. All but
the last return the columns of ``docs``. The functions take any columns
beside ``doc_id``, ``text`` and ``source``, null values, repeated rows and
empty tables; each operator's docstring states the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairforge.llm import decontam, jaccard_join, mixing, sharding, toxicity
from pairforge.llm.registry import table
from pairforge.session import materialize, ship_package


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the multiple-instance model, learnt from ``labels``, calls toxic."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of five-word n-gram sets with a Jaccard similarity of 0.8 or more."""
    ship_package(spark)
    return jaccard_join.drop_near_duplicates(docs, n=5, num=4, den=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of ``benchmark`` out of the texts; documents of which no word is left go."""
    ship_package(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings the sources to their target weights: every document once, those of smaller sources again where Pfair slots ask for it."""
    ship_package(spark)
    return mixing.mix_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` (0 to 23, near equal in bytes)."""
    return sharding.assign_shards(docs)


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("mixing", mixing_stage), ("sharding", sharding_stage)]

# A trained model and Pfair scheduling have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
