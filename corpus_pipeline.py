"""A training corpus from documents: good texts, without copies, near copies and benchmark passages, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's rows to the shared
checkpoint folder and reads them again as the next stage's documents.

Cases: a null text counts as empty; null ids are rows like others; empty texts are equal to one another and have no
near copies; of texts alike in id too one row stays; columns of any name are carried through; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalake.llm.decontaminate import clean
from stratalake.llm.exact_dedup import drop_copies
from stratalake.llm.jaccard_join import drop_similar
from stratalake.llm.packing import best_fit, words_and_end
from stratalake.llm.quality import good
from stratalake.llm.store import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the one with the smallest id stays."""
    return drop_similar(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document: words and an end token, in sequences of 512 to 8192."""
    return best_fit(docs.select("doc_id", words_and_end("text").alias("n_words")), "n_words")


STAGES = [
    ("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies),
    ("decontaminated", decontaminated), ("packed", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
