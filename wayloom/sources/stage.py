"""Stage boundaries: derived tables written once and read back as parquet.

Downstream questions read tables, not the jobs that built them. A staged table is
bucketed by its trip key, so per-trip aggregations and joins between staged tables need
no further shuffle, box and time filters are pushed into the scan, and losing an
executor never replays the build. Tables that a cheap row-wise step makes from smaller
ones are not staged: they would only fill the disk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from wayloom.session import checkpoint_folder

#: Few enough for a task to sort or group them in memory.
ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the checkpoint folder of the session."""
    return f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}"


def bucket_count(spark: SparkSession, expected_rows: int) -> int:
    """Never fewer than the parts of a shuffle, so that joins bring the other side to the placed rows."""
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(MAX_BUCKETS, max(least, math.ceil(expected_rows / ROWS_PER_BUCKET)))


def staged(
    spark: SparkSession,
    name: str,
    origin: str,
    build: Callable[[], DataFrame],
    keys: Sequence[str],
    sort: Sequence[str],
    buckets: int,
    placed: bool = False,
) -> DataFrame:
    """Table ``name`` derived from ``origin``, built on first use in this application.

    ``placed`` rows are partitioned by ``keys`` into ``buckets`` parts already and are written where they are.
    """
    table = f"{name}_{hashlib.sha1(origin.encode()).hexdigest()[:12]}"
    if not spark.catalog.tableExists(table):
        rows = build()
        (
            (rows if placed else rows.repartition(buckets, *keys))
            .write.mode("overwrite")
            .option("path", f"{shared_folder(spark)}/{table}")
            .bucketBy(buckets, *keys)
            .sortBy(*keys, *sort)
            .format("parquet")
            .saveAsTable(table)
        )
    return spark.table(table)
