"""Cleaning queries over the event-derived raw log."""

from __future__ import annotations

from wayloom.functions import geo
from wayloom.operators import cleaning as op
from wayloom.plans.registry import query
from wayloom.plans.sqltext import POINTS, inside, planar, with_
from wayloom.sources import lattice
from wayloom.sources.tables import number_points

# The event log is far sparser than GPS, so the limits are scaled to it.
RULES = {"max_speed_kmh": 6.0, "rounds": 3, "min_dt_seconds": 1.0}
GAP_MINUTES = 480
STOP = {"stop_radius_m": 15000.0, "stop_minutes": 20}
BOX = geo.Box(116.2, 39.8, 116.55, 40.05)

RAW = """
raw AS (
  SELECT user_id AS taxi_id,
         CASE WHEN event_id % 97 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp,
         CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN 10.0::DOUBLE
              ELSE (116200000 + event_id * 37 % 400 * 1000)::DOUBLE / 1e6 END AS lng,
         (39800000 + event_id * 23 % 300 * 1000)::DOUBLE / 1e6 AS lat
  FROM (SELECT *, unnest(range(CASE WHEN event_id % 79 = 0 THEN 2 ELSE 1 END)) FROM events)
),
parsed AS (SELECT taxi_id, try_cast(timestamp AS TIMESTAMP) AS gps_time, lng AS lon, lat FROM raw),
valid AS (SELECT * FROM parsed WHERE gps_time IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL),
coarse AS (SELECT * FROM valid WHERE lon BETWEEN 72.0 AND 137.9 AND lat BETWEEN 0.8 AND 55.9)"""


def _rounds(local: bool) -> str:
    """Three unrolled speed passes over the deduplicated rows."""
    box = f" WHERE {inside(BOX)}" if local else ""
    parts = [RAW.strip(), f"alive0 AS (SELECT DISTINCT * FROM coarse{box})"]
    for n in (1, 2, 3):
        parts.append(
            f"""judged{n} AS (
  SELECT *, coalesce(dt >= 1.0 AND m * 3.6 / nullif(dt, 0) > 6.0, false) AS bad FROM (
    SELECT taxi_id, gps_time, lon, lat, epoch_us(gps_time - lag(gps_time) OVER w) / 1e6 AS dt,
           {planar("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")} AS m
    FROM alive{n - 1} WINDOW w AS (PARTITION BY taxi_id ORDER BY gps_time, lon, lat)))"""
        )
        parts.append(f"alive{n} AS (SELECT taxi_id, gps_time, lon, lat FROM judged{n} WHERE NOT bad)")
    return ",\n".join(parts)


ROUNDS, ROUNDS_LOCAL = _rounds(False), _rounds(True)
TRIPPED = (
    ROUNDS
    + """,
tripped AS (
  SELECT taxi_id, gps_time, lon, lat,
         (sum(CASE WHEN gap IS NULL OR gap > 28800 THEN 1 ELSE 0 END) OVER (
            PARTITION BY taxi_id ORDER BY gps_time, lon, lat ROWS UNBOUNDED PRECEDING))::BIGINT AS trip_id
  FROM (SELECT *, epoch_us(gps_time - lag(gps_time) OVER (PARTITION BY taxi_id ORDER BY gps_time, lon, lat)) / 1e6 AS gap
        FROM alive3))"""
)


@query(
    "clean_drop_invalid",
    with_(RAW, f"d AS (SELECT DISTINCT * FROM coarse WHERE {inside(BOX)})") + " SELECT taxi_id, gps_time, lon, lat FROM d",
)
def clean_drop_invalid(spark, sf_dir):
    return op.drop_invalid(op.parse_log(lattice.raw_log(spark, sf_dir)), BOX)


@query(
    "clean_speed_rounds",
    with_(ROUNDS)
    + " SELECT taxi_id, gps_time, lon, lat, 1 AS removed_round FROM judged1 WHERE bad"
    + " UNION ALL SELECT taxi_id, gps_time, lon, lat, 2 FROM judged2 WHERE bad"
    + " UNION ALL SELECT taxi_id, gps_time, lon, lat, 3 FROM judged3 WHERE bad",
)
def clean_speed_rounds(spark, sf_dir):
    points = op.drop_invalid(op.parse_log(lattice.raw_log(spark, sf_dir)))
    return op.flag_speed_outliers(points, **RULES).filter("removed_round IS NOT NULL")


@query("clean_trips", with_(TRIPPED) + " SELECT taxi_id, trip_id, gps_time, lon, lat FROM tripped")
def clean_trips(spark, sf_dir):
    return op.clean_log(lattice.raw_log(spark, sf_dir), trip_gap_minutes=GAP_MINUTES, **RULES)


@query(
    "load_numbered_points",
    with_(TRIPPED)
    + " SELECT row_number() OVER (ORDER BY taxi_id, gps_time, lon, lat) AS id, taxi_id, trip_id, gps_time, lon, lat FROM tripped",
)
def load_numbered_points(spark, sf_dir):
    return number_points(op.clean_log(lattice.raw_log(spark, sf_dir), trip_gap_minutes=GAP_MINUTES, **RULES))


@query(
    "clean_stop_events",
    with_(
        TRIPPED,
        f"""stepped AS (
  SELECT *, coalesce({planar("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")} > 15000.0, false) AS broke
  FROM tripped WINDOW w AS (PARTITION BY taxi_id ORDER BY gps_time, lon, lat)),
runs AS (SELECT *, sum(broke::INT) OVER (PARTITION BY taxi_id ORDER BY gps_time, lon, lat ROWS UNBOUNDED PRECEDING) AS run FROM stepped)""",
    )
    + """ SELECT taxi_id, min(gps_time) AS start_time, max(gps_time) AS end_time, round(avg(lon), 6) AS lng,
 round(avg(lat), 6) AS lat, count(*) AS point_count FROM runs GROUP BY taxi_id, run
 HAVING count(*) >= 3 AND epoch_us(max(gps_time) - min(gps_time)) >= 1200000000""",
)
def clean_stop_events(spark, sf_dir):
    from pyspark.sql import functions as F

    points = op.clean_log(lattice.raw_log(spark, sf_dir), trip_gap_minutes=GAP_MINUTES, **RULES)
    stops = op.stop_events(points, **STOP)
    return stops.withColumn("lng", F.round("lng", 6)).withColumn("lat", F.round("lat", 6))


STATS = (
    with_(
        ROUNDS_LOCAL,
        f"""c AS (SELECT taxi_id, count(*) AS raw_rows,
  count(*) FILTER (gps_time IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL) AS valid_rows FROM parsed GROUP BY taxi_id),
b AS (SELECT taxi_id, count(*) AS coarse_box_rows, count(*) FILTER ({inside(BOX)}) AS local_box_rows FROM coarse GROUP BY taxi_id),
d AS (SELECT taxi_id, count(*) AS dedup_rows FROM alive0 GROUP BY taxi_id),
r1 AS (SELECT taxi_id, count(*) AS n FROM judged1 WHERE bad GROUP BY taxi_id),
r2 AS (SELECT taxi_id, count(*) AS n FROM judged2 WHERE bad GROUP BY taxi_id),
r3 AS (SELECT taxi_id, count(*) AS n FROM judged3 WHERE bad GROUP BY taxi_id),
f AS (SELECT taxi_id, count(*) AS n FROM alive3 GROUP BY taxi_id),
stats AS (SELECT c.taxi_id, raw_rows, valid_rows, coalesce(coarse_box_rows, 0) AS coarse_box_rows,
  coalesce(local_box_rows, 0) AS local_box_rows, coalesce(dedup_rows, 0) AS dedup_rows,
  coalesce(r1.n, 0) AS removed_round_1, coalesce(r2.n, 0) AS removed_round_2, coalesce(r3.n, 0) AS removed_round_3,
  coalesce(r1.n, 0) + coalesce(r2.n, 0) + coalesce(r3.n, 0) AS speed_removed_total, coalesce(f.n, 0) AS final_rows
  FROM c LEFT JOIN b USING (taxi_id) LEFT JOIN d USING (taxi_id) LEFT JOIN r1 USING (taxi_id)
  LEFT JOIN r2 USING (taxi_id) LEFT JOIN r3 USING (taxi_id) LEFT JOIN f USING (taxi_id))""",
    )
)


@query("clean_stats_per_taxi", STATS + " SELECT * FROM stats")
def clean_stats_per_taxi(spark, sf_dir):
    return op.cleaning_stats(lattice.raw_log(spark, sf_dir), BOX, **RULES)


@query(
    "clean_run_summary",
    STATS
    + """ SELECT count(*) AS file_count, count(*) FILTER (final_rows > 0) AS processed_files,
 (sum(raw_rows) FILTER (final_rows > 0))::BIGINT AS total_raw_rows,
 (sum(final_rows) FILTER (final_rows > 0))::BIGINT AS total_final_rows,
 (sum(speed_removed_total) FILTER (final_rows > 0))::BIGINT AS total_speed_removed FROM stats""",
)
def clean_run_summary(spark, sf_dir):
    return op.cleaning_summary(op.cleaning_stats(lattice.raw_log(spark, sf_dir), BOX, **RULES))


SUMMARY_BOX = geo.Box(116.3, 39.9, 116.5, 40.05)


@query(
    "dataset_summary",
    with_(POINTS)
    + f""" SELECT count(*) AS point_count, count(*) FILTER (NOT {inside(SUMMARY_BOX)}) AS outlier_count,
 count(DISTINCT taxi_id) AS taxi_count, min(taxi_id) AS min_taxi_id, max(taxi_id) AS max_taxi_id,
 max(taxi_id) - min(taxi_id) + 1 - count(DISTINCT taxi_id) AS missing_taxi_ids,
 min(gps_time) AS start_time, max(gps_time) AS end_time, count(DISTINCT (taxi_id, trip_id)) AS trip_count,
 round(count(*) FILTER ({inside(SUMMARY_BOX)}) / count(*), 6) AS in_box_share FROM points""",
)
def dataset_summary(spark, sf_dir):
    from pyspark.sql import functions as F

    summary = op.dataset_summary(lattice.taxi_points(spark, sf_dir), SUMMARY_BOX)
    return summary.withColumn("in_box_share", F.round("in_box_share", 6))
