"""Raw position logs and text corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_LOG_SCHEMA = "taxi_id BIGINT, timestamp STRING, lng DOUBLE, lat DOUBLE"


def read_raw_log(spark: SparkSession, folder: str, taxi_ids: Sequence[int] | None = None) -> DataFrame:
    """Headerless per-vehicle CSV files of a folder, scanned as one table.

    Fields that do not parse become null and are dropped by the cleaning step.
    """
    log = spark.read.schema(RAW_LOG_SCHEMA).csv(folder, header=False, mode="PERMISSIVE")
    return log.filter(F.col("taxi_id").isin(list(taxi_ids))) if taxi_ids else log


def read_markdown(spark: SparkSession, folder: str, allow: str = r".*\.md$") -> DataFrame:
    """Markdown files below a folder as (path, content); a leading byte-order mark is removed."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )
    return files.filter(F.col("path").rlike(allow)).withColumn("content", F.regexp_replace("content", "^\\x{FEFF}", ""))
