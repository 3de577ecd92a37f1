"""Table loading, incremental writes, merges, audit records and exports."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators.sequence import running_total


def number_points(points: DataFrame) -> DataFrame:
    """Give cleaned points a deterministic, unique id.

    Ids are dense within a vehicle's day and never need a global sort: the id is built
    from the number of points on earlier (vehicle, day) blocks plus the rank in the block.
    Only the vehicles' counts are ordered over all, by ranges.
    """
    day = F.to_date("gps_time")
    blocks = points.groupBy("taxi_id", day.alias("_day")).agg(F.count("*").alias("_n"))
    per_taxi = blocks.groupBy("taxi_id").agg(F.sum("_n").alias("_taxi_n"))
    earlier_days = Window.partitionBy("taxi_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    taxi_offset = running_total(per_taxi, ["taxi_id"], "_taxi_n", "_taxi_offset").drop("_taxi_n")
    offsets = blocks.select(
        "taxi_id", "_day", F.coalesce(F.sum("_n").over(earlier_days), F.lit(0)).alias("_day_offset")
    ).join(taxi_offset, "taxi_id")
    in_block = Window.partitionBy("taxi_id", "_day").orderBy("gps_time", "lon", "lat")
    return (
        points.withColumn("_day", day)
        .withColumn("_rank", F.row_number().over(in_block))
        .join(offsets, ["taxi_id", "_day"])
        .select(
            (F.col("_taxi_offset") + F.col("_day_offset") + F.col("_rank")).cast("long").alias("id"),
            "taxi_id",
            "trip_id",
            "gps_time",
            "lon",
            "lat",
        )
    )


def write_points(points: DataFrame, path: str, mode: str = "overwrite", step: float = 0.01, in_place: bool = False) -> None:
    """Points by day, sorted inside each file by cell so box filters skip row groups.

    A day's rows are spread over many writers by cell, which keeps a busy day from
    becoming one task. ``in_place`` leaves points that lie in many even parts already, such as
    those placed by trip, where they are: no point is shuffled, and each part writes its own files.
    """
    cell_x, cell_y = geo.degree_cell(F.col("lon"), step), geo.degree_cell(F.col("lat"), step)
    rows = points.withColumn("day", F.to_date("gps_time")).withColumn("_x", cell_x).withColumn("_y", cell_y)
    (
        (rows if in_place else rows.repartitionByRange("day", "_x", "_y", "gps_time"))
        .sortWithinPartitions("day", "_x", "_y", "gps_time")
        .drop("_x", "_y")
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )


def not_done(source: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the target yet: resume without cursors."""
    return source.join(done.select(*keys).distinct(), list(keys), "left_anti")


def merge_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], merge: dict[str, str]) -> DataFrame:
    """Upsert as one aggregation.

    ``merge`` maps a column to ``min``, ``max`` or ``new`` (the newer value wins).
    """
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    rules = {
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
        "new": lambda c: F.max_by(c, "_new"),
    }
    return both.groupBy(*keys).agg(*[rules[how](c).alias(c) for c, how in merge.items()])


def keep_first(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert rows whose key is absent; existing rows stay."""
    return old.unionByName(not_done(new, old, keys).dropDuplicates(list(keys)))


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def audit_record(counted: DataFrame, pipeline: str, status: str, **details: Column) -> DataFrame:
    """One row describing a build: pipeline, status and JSON details from aggregates."""
    named = [value.alias(name) for name, value in details.items()]
    return counted.agg(F.count("*").alias("rows"), *named).select(
        F.lit(pipeline).alias("pipeline_name"),
        F.lit(status).alias("status"),
        F.to_json(F.struct("rows", *details.keys())).alias("details"),
    )


def parameter_table(spark: SparkSession, rows: list[dict[str, Any]], schema: str) -> DataFrame:
    """Small request parameters (boxes, pairs, keys) as a table."""
    names = [part.strip().split()[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def parameters_from_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of a JSON array with their ordinal position."""
    return df.select("*", F.posexplode(F.from_json(column, f"array<struct<{schema}>>")).alias("ordinal", "_item")).select(
        "*", "_item.*"
    ).drop("_item")


def box_table(spark: SparkSession, boxes: Sequence[geo.Box]) -> DataFrame:
    rows = [(n, b.min_lon, b.min_lat, b.max_lon, b.max_lat) for n, b in enumerate(boxes)]
    return spark.createDataFrame(
        rows, "box_index INT, min_lon DOUBLE, min_lat DOUBLE, max_lon DOUBLE, max_lat DOUBLE"
    )


# Spellings of one-way marks seen in road extracts (fixed values).
ONEWAY_FORWARD = ["yes", "1", "true", "t"]
ONEWAY_REVERSE = ["-1", "reverse", "backward"]


def oneway_mode(mark: Column) -> Column:
    """forward, reverse or both, from the many spellings of the source field."""
    text = F.lower(F.trim(F.coalesce(mark.cast("string"), F.lit(""))))
    return F.when(text.isin(ONEWAY_FORWARD), "forward").when(text.isin(ONEWAY_REVERSE), "reverse").otherwise("both")


def normalise_roads(edges: DataFrame) -> DataFrame:
    """Road segments with travel mode and bounding box; a stable uid is derived when absent."""
    if "edge_uid" not in edges.columns:
        edges = edges.withColumn("edge_uid", F.xxhash64("u", "v", F.to_json("coords")))
    return edges.select(
        "*",
        oneway_mode(F.col("oneway")).alias("travel"),
        *geo.line_box(F.col("coords")),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export; nested columns are written as JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)
