"""A training corpus from raw documents, stage by stage.

Each stage works on all that the one before kept and returns the columns of
``documents``; the last returns packed sequences.  Between stages the rows are
written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontamination, near_duplicates, packing, quality, toxicity
from corvane.llm.shared import fold_of, stage


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without toxic documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels.where(fold_of(F.col("doc_id"), 3) != 1))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_duplicates.drop_near_duplicates(docs)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' ids in sequences of at most 2048."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("toxicity", keep_harmless),
    ("near-duplicates", keep_distinct),
    ("benchmark decontamination", keep_clean_of_benchmark),
    ("packing", pack_sequences),
]
#: Trained classifiers and signatures cannot be put in SQL; the tests hold the
#: stages against their operators' verdicts row by row, decontamination against
#: brute force.
ORACLE_SQL = None


def load_queries() -> dict:
    return {"pipeline": run}


def load_oracles() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
