"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folder: str | None = None

#: Rows that a driver of one GB holds many times over.
BROADCAST_ROWS = 100_000


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wayloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.local.dir", os.environ.get("SPARK_LOCAL_DIR") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on one machine (tests, the benchmark) may lack the setting and gets a
    temporary folder; on a cluster its absence is an error, since executors could not
    read each other's files.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _local_folder is None:
            _local_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _local_folder
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never forces a long replay."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder and read back, in a compressed columnar form.

    Wide or many rows take a fraction of a checkpoint's space, and readers of a few columns read no others.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def large(df: DataFrame) -> DataFrame:
    """``df`` with the hint that it is joined by shuffle and merge, never by broadcast.

    For sides with a row a trip or more: Spark takes the size of their files for that of their rows, and repeated tokens and
    coordinates are many times larger in memory. A broadcast of them passes through the driver whole.
    """
    return df.hint("merge")


def counted(df: DataFrame) -> DataFrame:
    """Rows written once, with the hint for joins that fits their number: broadcast for up to ``BROADCAST_ROWS``, else merge.

    For sums by cluster, token or road next to tables with a row a trip, which then stay where they are.
    """
    rows = kept(df)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else large(rows)
