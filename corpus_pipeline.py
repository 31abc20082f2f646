"""A pipeline over ``documents`` of operators from ``mediaquarry.llm``.

Each stage takes the session, the documents that its predecessor kept, and the
folder of the tables.  SQL can't express the first stage, which fits a model,
so there is no SQL for the rows of ``run``; tests/llm holds the stages against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.llm._store import result
from mediaquarry.llm.copies import distinct_documents
from mediaquarry.llm.lines import without_repeats
from mediaquarry.llm.packing import pack_documents
from mediaquarry.llm.toxicity import clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't reject."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeated runs of lines; n_chars follows the text."""
    lines, removed = "lines", "removed"
    while {lines, removed} & set(docs.columns):
        lines, removed = lines + "_", removed + "_"
    found = without_repeats(docs, counts=(lines, removed))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash candidates, five-word shingles with a similarity of 0.8 or more."""
    return distinct_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of each document."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("packing", pack_batches),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet for the next one; what a stage writes besides is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = result(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
