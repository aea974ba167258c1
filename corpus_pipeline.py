"""From raw documents to packed training sequences, in four stages.

Each stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm import mixing, ngram_join, packing, toxicity
from signalbox.llm.storage import stored

ORACLE_SQL = None


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, gives grade 0."""
    model = toxicity.fit(docs, toxicity.toxic_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.rejecting(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.one_of_each_class(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.whole_documents(docs, mixing.word_count(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [("toxicity", harmless), ("ngram_jaccard_join", distinct), ("source_mix", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
