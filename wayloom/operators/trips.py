"""Trip tables, polylines and matched-trip lookups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators.sequence import CHUNK_SECONDS, neighbour, row_numbers, running_sum, seconds_between

TRIP = ["taxi_id", "trip_id"]
GRID_STEP = 0.01


def time_window(start: datetime, end: datetime, column: str = "gps_time") -> Column:
    """Closed time filter; literals are zone-free so they push down to the scan."""
    if start >= end:
        raise ValueError("start must be earlier than end")
    return F.col(column).between(ntz(start), ntz(end))


def ntz(moment: datetime) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{moment:%Y-%m-%d %H:%M:%S.%f}'")


def od_endpoints(points: DataFrame) -> DataFrame:
    """First and last point, size and duration of every trip in one aggregation."""
    key = F.struct("gps_time", "id")
    place = F.struct("gps_time", "lon", "lat")
    return (
        points.groupBy(*TRIP)
        .agg(F.min_by(place, key).alias("a"), F.max_by(place, key).alias("b"), F.count("*").alias("point_count"))
        .select(
            *TRIP,
            F.col("a.gps_time").alias("start_time"),
            F.col("b.gps_time").alias("end_time"),
            F.col("a.lon").alias("start_lon"),
            F.col("a.lat").alias("start_lat"),
            F.col("b.lon").alias("end_lon"),
            F.col("b.lat").alias("end_lat"),
            "point_count",
            seconds_between(F.col("a.gps_time"), F.col("b.gps_time")).alias("duration_seconds"),
        )
    )


def trip_grid_points(
    points: DataFrame, step: float = GRID_STEP, chunk_seconds: int | None = CHUNK_SECONDS
) -> DataFrame:
    """Points with their position in the trip and their degree cell."""
    numbered = row_numbers(points, TRIP, ["gps_time", "id"], "point_seq", "gps_time", chunk_seconds)
    return numbered.select(
        *TRIP,
        F.col("point_seq").cast("int").alias("point_seq"),
        "gps_time",
        "lon",
        "lat",
        geo.degree_cell(F.col("lon"), step).alias("grid_x"),
        geo.degree_cell(F.col("lat"), step).alias("grid_y"),
        geo.degree_cell_key(F.col("lon"), F.col("lat"), step).alias("grid_key"),
    )


def trip_spatial_index(grid_points: DataFrame) -> DataFrame:
    """Cells each trip touched, with first and last visit."""
    return grid_points.groupBy(*TRIP, "grid_x", "grid_y", "grid_key").agg(
        F.min("gps_time").alias("first_seen_time"),
        F.max("gps_time").alias("last_seen_time"),
        F.min("point_seq").alias("first_point_seq"),
        F.count("*").cast("int").alias("point_count"),
    )


def candidate_trips(points: DataFrame, limit: int) -> DataFrame:
    """The earliest trips among already filtered points."""
    return (
        points.groupBy(*TRIP).agg(F.min("gps_time").alias("first_time")).orderBy("first_time", *TRIP).limit(limit)
    )


def filter_points(
    points: DataFrame,
    start: datetime,
    end: datetime,
    taxi_id: int | None = None,
    box: geo.Box | None = None,
) -> DataFrame:
    rows = points.filter(time_window(start, end))
    if taxi_id is not None:
        rows = rows.filter(F.col("taxi_id") == taxi_id)
    if box is not None:
        rows = rows.filter(geo.in_box(F.col("lon"), F.col("lat"), box))
    return rows


def segment_points(
    points: DataFrame,
    max_gap_minutes: float = 40,
    max_jump_km: float = 30.0,
    max_speed_kmh: float = 140.0,
    chunk_seconds: int | None = CHUNK_SECONDS,
) -> DataFrame:
    """Number the unbroken stretches of each trip."""
    paired = neighbour(points, TRIP, ["gps_time", "id"], ["gps_time", "lon", "lat"], "prev", "gps_time", chunk_seconds=chunk_seconds)
    dt = seconds_between(F.col("prev.gps_time"), F.col("gps_time"))
    metres = geo.haversine_m(F.col("prev.lon"), F.col("prev.lat"), F.col("lon"), F.col("lat"))
    breaks = (
        F.col("prev").isNull()
        | (dt <= 0)
        | (dt > max_gap_minutes * 60)
        | (metres > max_jump_km * 1000)
        | (F.try_divide(metres, dt) > max_speed_kmh / 3.6)
    )
    flagged = paired.withColumn("_break", F.when(breaks, 1).otherwise(0)).drop("prev")
    return running_sum(flagged, TRIP, ["gps_time", "id"], F.col("_break"), "segment_id", "gps_time", chunk_seconds).drop("_break")


def zoom_tolerance(zoom: int) -> float:
    """Simplification tolerance in degrees for a map zoom level."""
    return max(0.00002, 0.2 / 2 ** max(3, min(20, zoom)))


def polylines(
    points: DataFrame,
    start: datetime,
    end: datetime,
    taxi_id: int | None = None,
    box: geo.Box | None = None,
    max_trips: int | None = None,
    tolerance: float = 0.0,
    **break_rules: float | None,
) -> DataFrame:
    """Track lines, cut where the signal is implausible; with ``max_trips`` only the earliest trips and lines."""
    from wayloom.operators.lines import simplify

    rows = filter_points(points, start, end, taxi_id, box)
    if max_trips is not None:
        rows = rows.join(candidate_trips(rows, max_trips).select(*TRIP), TRIP, "left_semi")
    segments = segment_points(rows, **break_rules)
    lines = (
        segments.groupBy(*TRIP, "segment_id")
        .agg(
            F.count("*").alias("point_count"),
            F.min("gps_time").alias("start_time"),
            F.max("gps_time").alias("end_time"),
            geo.line_from_points([F.col("gps_time"), F.col("id")], F.col("lon"), F.col("lat")).alias("coords"),
        )
        .filter("point_count >= 2")
    )
    total = lines.agg(F.count("*").alias("total_segment_count"))
    shown = (
        lines.crossJoin(F.broadcast(total))
        .select(
            "taxi_id",
            F.concat(F.col("trip_id").cast("string"), F.lit("_s"), F.col("segment_id").cast("string")).alias("trip_id"),
            "point_count",
            "start_time",
            "end_time",
            "total_segment_count",
            "coords",
        )
    )
    if max_trips is not None:
        shown = shown.orderBy("start_time", "taxi_id", "trip_id").limit(max_trips)
    return simplify(shown, "coords", tolerance) if tolerance > 0 else shown


def base_trip_id(trip: Column) -> Column:
    """Trip id without its stretch suffix."""
    return F.substring_index(trip, "_s", 1)


def matched_of_taxi(matched: DataFrame, taxi_id: int, trip_ids: Sequence[int] | None = None) -> DataFrame:
    rows = matched.filter(F.col("taxi_id") == taxi_id)
    if trip_ids:
        rows = rows.filter(F.col("trip_id").isin(list(trip_ids)))
    return rows.orderBy("trip_id")


def matched_in_box(
    points: DataFrame,
    matched: DataFrame,
    start: datetime,
    end: datetime,
    box: geo.Box | None = None,
    taxi_range: tuple[int, int] | None = None,
) -> DataFrame:
    """Matched trips with at least one raw point in the window and box."""
    rows = filter_points(points, start, end, None, box)
    if taxi_range is not None:
        low, high = taxi_range
        if low > high:
            raise ValueError("taxi range is reversed")
        rows = rows.filter(F.col("taxi_id").between(low, high))
    seen = rows.groupBy(*TRIP).agg(F.min("gps_time").alias("start_time"), F.max("gps_time").alias("end_time"))
    return matched.join(seen, TRIP)


def matched_counts(found: DataFrame) -> DataFrame:
    return (
        found.groupBy("taxi_id").agg(F.count("*").alias("n"))
        .agg(F.count("*").alias("active_vehicle_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("trip_count"))
    )


def matched_detail(found: DataFrame, limit: int | None = None) -> DataFrame:
    """All found trips, or the latest ``limit``."""
    return found if limit is None else found.orderBy(F.col("start_time").desc(), "taxi_id", "trip_id").limit(limit)


def raw_and_matched(points: DataFrame, matched: DataFrame) -> DataFrame:
    """Raw track next to the matched line for every given trip."""
    raw = points.groupBy(*TRIP).agg(
        geo.line_from_points([F.col("gps_time"), F.col("id")], F.col("lon"), F.col("lat")).alias("raw_coords"),
    )
    joined = raw.join(matched.withColumnRenamed("coords", "matched_coords"), TRIP, "left")
    return joined.select(
        *TRIP,
        "raw_coords",
        "matched_coords",
        F.size("raw_coords").alias("raw_point_count"),
        F.col("matched_coords").isNotNull().alias("has_matched"),
    )
