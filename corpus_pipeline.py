"""Corpus pipeline: toxicity, line dedup, near-duplicate removal, benchmark decontamination, source mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with
the stage's decisions carried out. The last returns these columns with size, source_size, target and taken, the words
the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayloom.llm import decontam, jaccard, lines, mixing, toxicity
from wayloom.llm.common import keep_table, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_repeats(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_duplicates(docs, percent=80, size=5)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("source_mix", mix_stage),
]

#: The toxicity scores cannot be expressed in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for nth, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if nth < len(STAGES) - 1:
            docs = keep_table(docs)
    return docs
