"""Raw log → clean points, trips, stops and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators.sequence import CHUNK_SECONDS, neighbour, previous_where, running_sum, seconds_between

COARSE_BOX = geo.Box(72.0, 0.8, 137.9, 55.9)
LOCAL_BOX = geo.Box(115.4, 39.4, 117.6, 41.1)
SUMMARY_BOX = geo.Box(115.7, 39.4, 117.4, 41.1)
POINT_KEY = ["taxi_id", "gps_time", "lon", "lat"]
ORDER = ["gps_time", "lon", "lat"]


def parse_log(raw: DataFrame) -> DataFrame:
    """Typed columns; what does not parse becomes null."""
    return raw.select(
        "taxi_id",
        F.expr("try_to_timestamp(timestamp)").cast("timestamp_ntz").alias("gps_time"),
        F.col("lng").alias("lon"),
        "lat",
    )


def _present() -> Column:
    return F.col("gps_time").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()


def _in(box: geo.Box) -> Column:
    return geo.in_box(F.col("lon"), F.col("lat"), box)


def drop_invalid(parsed: DataFrame, local_box: geo.Box | None = None) -> DataFrame:
    """Complete rows inside the coarse range and, if given, the local box; exact copies removed."""
    keep = _present() & _in(COARSE_BOX)
    if local_box is not None:
        keep = keep & _in(local_box)
    return parsed.filter(keep).dropDuplicates(POINT_KEY)


def flag_speed_outliers(
    points: DataFrame,
    max_speed_kmh: float = 130.0,
    rounds: int = 3,
    min_dt_seconds: float = 1.0,
    chunk_seconds: int | None = CHUNK_SECONDS,
) -> DataFrame:
    """Add ``removed_round``: the pass in which a point is dropped, or null when it stays.

    Each pass compares a point with its predecessor among the survivors and removes all
    offenders of that pass together. A pass that removes nothing leaves later passes
    nothing to do, so the early stop needs no test. All passes mark rows of one frame, so
    nothing is written in between and plain windows need a single shuffle.
    """
    judged = points.withColumn("removed_round", F.lit(None).cast("int"))
    for turn in range(1, rounds + 1):
        stays = F.col("removed_round").isNull()
        paired = previous_where(judged, ["taxi_id"], ORDER, ["gps_time", "lon", "lat"], "prev", "gps_time", stays, chunk_seconds)
        dt = seconds_between(F.col("prev.gps_time"), F.col("gps_time"))
        metres = geo.planar_m(F.col("prev.lon"), F.col("prev.lat"), F.col("lon"), F.col("lat"))
        bad = stays & F.coalesce((dt >= min_dt_seconds) & (F.try_divide(metres * 3.6, dt) > max_speed_kmh), F.lit(False))
        judged = paired.withColumn("removed_round", F.when(bad, turn).otherwise(F.col("removed_round"))).drop("prev")
    return judged


def remove_speed_outliers(points: DataFrame, **rules: float) -> DataFrame:
    return flag_speed_outliers(points, **rules).filter("removed_round IS NULL").drop("removed_round")


def assign_trips(
    points: DataFrame, trip_gap_minutes: float = 30, chunk_seconds: int | None = CHUNK_SECONDS
) -> DataFrame:
    """Number trips per vehicle; a new one starts after a gap above the limit."""
    paired = neighbour(points, ["taxi_id"], ORDER, ["gps_time"], "prev", "gps_time", -1, chunk_seconds)
    gap = seconds_between(F.col("prev.gps_time"), F.col("gps_time"))
    starts = F.when(F.col("prev").isNull() | (gap > trip_gap_minutes * 60), 1).otherwise(0)
    numbered = running_sum(paired, ["taxi_id"], ORDER, starts, "trip_id", "gps_time", chunk_seconds)
    return numbered.drop("prev").withColumn("trip_id", F.col("trip_id").cast("long"))


def stop_events(points: DataFrame, stop_radius_m: float = 200.0, stop_minutes: float = 20) -> DataFrame:
    """Places where a vehicle lingered: runs of small steps, long and dense enough."""
    paired = neighbour(points, ["taxi_id"], ORDER, ["lon", "lat"], "prev", "gps_time")
    step = geo.planar_m(F.col("prev.lon"), F.col("prev.lat"), F.col("lon"), F.col("lat"))
    breaks = F.when(step > stop_radius_m, 1).otherwise(0)
    runs = running_sum(paired, ["taxi_id"], ORDER, breaks, "run", "gps_time")
    return (
        runs.groupBy("taxi_id", "run")
        .agg(
            F.min("gps_time").alias("start_time"),
            F.max("gps_time").alias("end_time"),
            F.avg("lon").alias("lng"),
            F.avg("lat").alias("lat"),
            F.count("*").alias("point_count"),
        )
        .filter(
            (F.col("point_count") >= 3)
            & (seconds_between(F.col("start_time"), F.col("end_time")) >= stop_minutes * 60)
        )
        .drop("run")
    )


def clean_log(
    raw: DataFrame,
    local_box: geo.Box | None = None,
    max_speed_kmh: float = 130.0,
    rounds: int = 3,
    min_dt_seconds: float = 1.0,
    trip_gap_minutes: float = 30,
) -> DataFrame:
    """The whole cleaning chain: (taxi_id, trip_id, gps_time, lon, lat)."""
    distinct = drop_invalid(parse_log(raw), local_box)
    steady = remove_speed_outliers(
        distinct, max_speed_kmh=max_speed_kmh, rounds=rounds, min_dt_seconds=min_dt_seconds
    )
    return assign_trips(steady, trip_gap_minutes).select("taxi_id", "trip_id", "gps_time", "lon", "lat")


def cleaning_stats(
    raw: DataFrame,
    local_box: geo.Box | None = None,
    max_speed_kmh: float = 130.0,
    rounds: int = 3,
    min_dt_seconds: float = 1.0,
) -> DataFrame:
    """Row counts per vehicle after each cleaning step."""
    parsed = parse_log(raw)
    in_local = _in(local_box) if local_box is not None else F.lit(True)
    counts = parsed.groupBy("taxi_id").agg(
        F.count("*").alias("raw_rows"),
        F.count_if(_present()).alias("valid_rows"),
        F.count_if(_present() & _in(COARSE_BOX)).alias("coarse_box_rows"),
        F.count_if(_present() & _in(COARSE_BOX) & in_local).alias("local_box_rows"),
    )
    flagged = flag_speed_outliers(drop_invalid(parsed, local_box), max_speed_kmh, rounds, min_dt_seconds)
    turns = [F.count_if(F.col("removed_round") == n).alias(f"removed_round_{n}") for n in range(1, rounds + 1)]
    outcome = flagged.groupBy("taxi_id").agg(
        F.count("*").alias("dedup_rows"),
        *turns,
        F.count("removed_round").alias("speed_removed_total"),
        F.count_if(F.col("removed_round").isNull()).alias("final_rows"),
    )
    filled = [c for c in outcome.columns if c != "taxi_id"]
    return counts.join(outcome, "taxi_id", "left").na.fill(0, filled)


def cleaning_summary(stats: DataFrame) -> DataFrame:
    """Totals of one run over vehicles that kept at least one row."""
    done = F.col("final_rows") > 0

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(done, F.col(name))), F.lit(0)).cast("long")

    return stats.agg(
        F.count("*").alias("file_count"),
        F.count_if(done).alias("processed_files"),
        total("raw_rows").alias("total_raw_rows"),
        total("final_rows").alias("total_final_rows"),
        total("speed_removed_total").alias("total_speed_removed"),
    )


def dataset_summary(points: DataFrame, box: geo.Box = SUMMARY_BOX) -> DataFrame:
    """One row: volumes, outliers, id coverage and time range of the point table.

    Distinct counts are taken from (vehicle, trip) groups that were already reduced
    on the map side, never from a single task over all points.
    """
    inside = geo.in_box(F.col("lon"), F.col("lat"), box)
    per_trip = points.groupBy("taxi_id", "trip_id").agg(
        F.count("*").alias("n"),
        F.count_if(~inside).alias("out"),
        F.min("gps_time").alias("t0"),
        F.max("gps_time").alias("t1"),
    )
    per_taxi = per_trip.groupBy("taxi_id").agg(
        F.sum("n").alias("n"),
        F.sum("out").alias("out"),
        F.count("trip_id").alias("trips"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    out = F.coalesce(F.sum("out"), F.lit(0))
    span = F.max("taxi_id") - F.min("taxi_id") + 1
    return per_taxi.agg(
        total.cast("long").alias("point_count"),
        out.cast("long").alias("outlier_count"),
        F.count("*").alias("taxi_count"),
        F.min("taxi_id").alias("min_taxi_id"),
        F.max("taxi_id").alias("max_taxi_id"),
        (span - F.count("*")).cast("long").alias("missing_taxi_ids"),
        F.min("t0").alias("start_time"),
        F.max("t1").alias("end_time"),
        F.coalesce(F.sum("trips"), F.lit(0)).cast("long").alias("trip_count"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(total - out, total))).alias("in_box_share"),
    )
