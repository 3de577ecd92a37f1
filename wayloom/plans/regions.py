"""Active vehicles, density, A/B flow and radiation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import geo, hexgrid
from wayloom.operators import regions as op
from wayloom.plans.registry import query
from wayloom.plans.shape import END, END_SQL, START, START_SQL, joined, rounded
from wayloom.plans.sqltext import POINTS, boxes_values, haversine, inside, near, with_
from wayloom.plans.trips import NUMBERED, OD
from wayloom.sources import lattice
from wayloom.sources.lattice import AREA_A, AREA_B, AREA_EMPTY, AREA_OVERLAP, WHOLE
from wayloom.sources.tables import box_table, parameter_table

BOXES = [AREA_A, AREA_B, AREA_OVERLAP, AREA_EMPTY]
IN_TIME = f"gps_time BETWEEN {START_SQL} AND {END_SQL}"


@query(
    "active_vehicles_box",
    with_(POINTS) + f" SELECT count(DISTINCT taxi_id) AS active_vehicle_count FROM points WHERE {IN_TIME} AND {inside(AREA_B)}",
)
def active_vehicles_box(spark, sf_dir):
    return op.active_vehicles(lattice.taxi_points(spark, sf_dir), START, END, AREA_B)


HITS = (
    boxes_values(BOXES)
    + f""",
hits AS (SELECT DISTINCT taxi_id, trip_id, box_index FROM points p JOIN boxes b
  ON p.lon BETWEEN b.min_lon AND b.max_lon AND p.lat BETWEEN b.min_lat AND b.max_lat
  WHERE {IN_TIME})"""
)


def _hits(spark, sf_dir):
    boxes = box_table(spark, BOXES)
    return op.box_hits(lattice.taxi_points(spark, sf_dir), boxes, START, END)


@query("boxes_union_count", with_(POINTS, HITS) + " SELECT count(DISTINCT taxi_id) AS active_vehicle_count FROM hits")
def boxes_union_count(spark, sf_dir):
    return op.vehicles_in_union(_hits(spark, sf_dir))


@query(
    "boxes_union_vehicles",
    with_(POINTS, HITS)
    + """ SELECT taxi_id, string_agg(DISTINCT box_index::VARCHAR, ',' ORDER BY box_index::VARCHAR) AS hit_boxes,
 count(DISTINCT trip_id) AS hit_trip_count FROM hits GROUP BY taxi_id""",
)
def boxes_union_vehicles(spark, sf_dir):
    return op.union_vehicles(_hits(spark, sf_dir)).withColumn("hit_boxes", joined(F.col("hit_boxes")))


@query("boxes_union_trips", with_(POINTS, HITS) + " SELECT DISTINCT taxi_id, trip_id FROM hits")
def boxes_union_trips(spark, sf_dir):
    return op.union_trips(_hits(spark, sf_dir))


@query(
    "boxes_vehicle_counts",
    with_(POINTS, HITS) + " SELECT box_index, count(DISTINCT taxi_id) AS vehicle_count FROM hits GROUP BY box_index",
)
def boxes_vehicle_counts(spark, sf_dir):
    return op.vehicles_per_box(_hits(spark, sf_dir))


DENSITY_BOX = geo.Box(116.22, 39.82, 116.52, 40.05)


def _density_sql(box: geo.Box, cell_m: int, vehicles: bool) -> str:
    snapped = geo.snap_box_to_mercator(box, cell_m)
    half = repr(geo.MERCATOR_HALF_M)
    lat_of = f"degrees(atan(sinh({{}} * pi() / {half})))"
    lon_of = f"({{}} * 180.0 / {half})"
    west, east = lon_of.format(f"(i * {cell_m})"), lon_of.format(f"((i + 1) * {cell_m})")
    south, north = lat_of.format(f"(j * {cell_m})"), lat_of.format(f"((j + 1) * {cell_m})")
    count = "count(DISTINCT taxi_id)" if vehicles else "NULL::BIGINT"
    return with_(
        POINTS,
        f"""placed AS (SELECT taxi_id, {inside(box)} AS asked, floor(lon * {half} / 180.0 / {cell_m})::INT AS i,
  floor(ln(tan((lat + 90.0) * pi() / 360.0)) * {half} / pi() / {cell_m})::INT AS j
  FROM points WHERE {IN_TIME} AND {inside(snapped)}),
cells AS (SELECT i, j, count(*) AS point_count, {count} AS vehicle_count, count(*) FILTER (asked) AS asked_n FROM placed GROUP BY i, j),
top AS (SELECT *, (SELECT sum(asked_n) FROM cells)::BIGINT AS total_points FROM cells),
density AS (SELECT i, j, point_count, vehicle_count, total_points, round({west}, 6) AS min_lon, round({south}, 6) AS min_lat,
  round({east}, 6) AS max_lon, round({north}, 6) AS max_lat, round(({west} + {east}) / 2, 6) AS center_lon,
  round(({south} + {north}) / 2, 6) AS center_lat FROM top)""",
    )


@query("grid_density", _density_sql(DENSITY_BOX, 500, False) + " SELECT * FROM density")
def grid_density(spark, sf_dir):
    return rounded(op.grid_density(lattice.taxi_points(spark, sf_dir), START, END, DENSITY_BOX))


@query("grid_density_vehicles", _density_sql(WHOLE, 1000, True) + " SELECT * FROM density")
def grid_density_vehicles(spark, sf_dir):
    return rounded(op.grid_density(lattice.taxi_points(spark, sf_dir), START, END, WHOLE, 1000, True))


@query(
    "grid_density_geojson",
    _density_sql(WHOLE, 1000, True)
    + " SELECT i, j, point_count, 'Polygon' AS geometry_type, 5 AS ring_size, min_lon AS first_lon FROM density",
)
def grid_density_geojson(spark, sf_dir):
    cells = op.grid_density(lattice.taxi_points(spark, sf_dir), START, END, WHOLE, 1000, True)
    shape = "type string, coordinates array<array<array<double>>>"
    parsed = cells.withColumn("g", F.from_json(geo.geojson_cell(), shape))
    return parsed.select(
        "i",
        "j",
        "point_count",
        F.col("g.type").alias("geometry_type"),
        F.size(F.col("g.coordinates")[0]).alias("ring_size"),
        F.round(F.col("g.coordinates")[0][0][0], 6).alias("first_lon"),
    )


AREA_KM2 = f"{haversine('min_lon', 'min_lat', 'max_lon', 'min_lat')} * {haversine('min_lon', 'min_lat', 'min_lon', 'max_lat')} / 1e6"


@query(
    "cell_density_per_km2",
    _density_sql(WHOLE, 1000, False).replace("round(", "(").replace(", 6) AS", ") AS")
    + f" SELECT i, j, round({AREA_KM2}, 6) AS area_km2, round(point_count / ({AREA_KM2}), 4) AS density_km2 FROM density",
)
def cell_density_per_km2(spark, sf_dir):
    cells = op.density_per_km2(op.grid_density(lattice.taxi_points(spark, sf_dir), START, END, WHOLE, 1000))
    return cells.select("i", "j", F.round("area_km2", 6).alias("area_km2"), F.round("density_km2", 4).alias("density_km2"))


def hex_sql(lon: str, lat: str, resolution: int) -> tuple[str, str]:
    """SQL of the axial coordinates before rounding."""
    edge = hexgrid.hex_edge_m(resolution)
    x = f"({lon} * {geo.MERCATOR_HALF_M!r} / 180.0)"
    y = f"(ln(tan(({lat} + 90.0) * pi() / 360.0)) * {geo.MERCATOR_HALF_M!r} / pi())"
    return f"(({x} * (sqrt(3.0) / 3.0) - {y} / 3.0) / {edge!r}::DOUBLE)", f"({y} * (2.0 / 3.0) / {edge!r}::DOUBLE)"


def hexed(source: str, name: str, lon: str, lat: str, resolution: int) -> str:
    """CTE adding hexagon coordinates hq, hr and the id to a source."""
    q, r = hex_sql(lon, lat, resolution)
    return f"""{name}_a AS (SELECT *, {q} AS fq, {r} AS fr FROM {source}),
{name}_b AS (SELECT *, floor(fq + 0.5) AS nq, floor(fr + 0.5) AS nr, floor(-fq - fr + 0.5) AS ns FROM {name}_a),
{name}_c AS (SELECT *, abs(nq - fq) AS dq, abs(nr - fr) AS dr, abs(ns + fq + fr) AS ds FROM {name}_b),
{name}_d AS (SELECT * EXCLUDE (fq, fr, nq, nr, ns, dq, dr, ds),
  (CASE WHEN dq > dr AND dq > ds THEN -nr - ns ELSE nq END)::BIGINT AS hq,
  (CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -nq - ns ELSE nr END)::BIGINT AS hr FROM {name}_c),
{name} AS (SELECT *, '{resolution}:' || hq || ':' || hr AS hex_id FROM {name}_d)"""


@query(
    "hex_density",
    with_(POINTS, f"boxed AS (SELECT lon, lat FROM points WHERE {inside(WHOLE)})", hexed("boxed", "cells", "lon", "lat", 9))
    + " SELECT hex_id, count(*) AS point_count FROM cells GROUP BY hex_id",
)
def hex_density(spark, sf_dir):
    return op.hex_density(lattice.taxi_points(spark, sf_dir), START, END, WHOLE, 9).drop("cell")


_EDGE9 = hexgrid.hex_edge_m(9)
_EDGE7 = hexgrid.hex_edge_m(7)


def _centre_sql(edge: float) -> tuple[str, str]:
    return (
        f"((hq + hr / 2.0) * (sqrt(3.0) * {edge!r}::DOUBLE) * 180.0 / {geo.MERCATOR_HALF_M!r})",
        f"degrees(atan(sinh(hr * (1.5 * {edge!r}::DOUBLE) * pi() / {geo.MERCATOR_HALF_M!r})))",
    )


@query(
    "hex_rollup",
    with_(
        POINTS,
        f"boxed AS (SELECT lon, lat FROM points WHERE {inside(WHOLE)})",
        hexed("boxed", "cells", "lon", "lat", 9),
        f"base AS (SELECT {_centre_sql(_EDGE9)[0]} AS clon, {_centre_sql(_EDGE9)[1]} AS clat, count(*) AS n FROM cells GROUP BY hq, hr)",
        hexed("base", "parents", "(clon + 1e-9)", "(clat + 1e-9)", 7),
    )
    + f""" SELECT hex_id, sum(n)::BIGINT AS point_count, round({_centre_sql(_EDGE7)[0]}, 6) AS center_lon,
 round({_centre_sql(_EDGE7)[1]}, 6) AS center_lat, 6 AS corners FROM parents GROUP BY hex_id, hq, hr""",
)
def hex_rollup(spark, sf_dir):
    base = op.hex_density(lattice.taxi_points(spark, sf_dir), START, END, WHOLE, 9)
    return op.hex_rollup(base, 9, 7).select(
        "hex_id",
        "point_count",
        F.round("center.lon", 6).alias("center_lon"),
        F.round("center.lat", 6).alias("center_lat"),
        F.size("boundary").alias("corners"),
    )


CELLS = "cells AS (SELECT grid_x, grid_y, count(*) AS n FROM numbered GROUP BY grid_x, grid_y)"


def _cells(spark, sf_dir):
    return (
        lattice.taxi_points(spark, sf_dir)
        .groupBy(
            geo.degree_cell(F.col("lon"), 0.01).alias("grid_x"),
            geo.degree_cell(F.col("lat"), 0.01).alias("grid_y"),
            geo.degree_cell_key(F.col("lon"), F.col("lat"), 0.01).alias("grid_key"),
        )
        .agg(F.count("*").alias("n"))
    )


def _pick(share: float) -> str:
    return f"(SELECT n FROM ranked WHERE rn = floor((total - 1) * {share}) + 1)"


RANKED = "ranked AS (SELECT n, row_number() OVER (ORDER BY n) AS rn, count(*) OVER () AS total FROM cells WHERE n > 0)"


@query(
    "class_levels_quantile",
    with_(
        POINTS,
        NUMBERED,
        CELLS,
        RANKED,
        "b AS (SELECT " + ", ".join(f"{_pick(n / 5)} AS b{n}" for n in range(6)) + ")",
    )
    + """ SELECT grid_x, grid_y, n, CASE WHEN n BETWEEN b4 AND b5 THEN 0 WHEN n BETWEEN b3 AND b4 THEN 1 WHEN n BETWEEN b2 AND b3 THEN 2
 WHEN n BETWEEN b1 AND b2 THEN 3 WHEN n BETWEEN b0 AND b1 THEN 4 WHEN n > b5 THEN 0 ELSE 4 END AS level FROM cells, b""",
)
def class_levels_quantile(spark, sf_dir):
    cells = _cells(spark, sf_dir).drop("grid_key")
    return op.assign_levels(cells, op.class_breaks(cells, "n", "quantile"), "n")


@query(
    "class_levels_equal",
    with_(
        POINTS,
        NUMBERED,
        CELLS,
        "m AS (SELECT min(n) AS lo, max(n) AS hi FROM cells)",
        "b AS (SELECT lo AS b0, lo + (hi - lo) / 5.0::DOUBLE AS b1, lo + (hi - lo) / 5.0::DOUBLE * 2 AS b2, "
        "lo + (hi - lo) / 5.0::DOUBLE * 3 AS b3, lo + (hi - lo) / 5.0::DOUBLE * 4 AS b4, hi AS b5 FROM m)",
    )
    + """ SELECT grid_x, grid_y, n, CASE WHEN n BETWEEN b4 AND b5 THEN 0 WHEN n BETWEEN b3 AND b4 THEN 1 WHEN n BETWEEN b2 AND b3 THEN 2
 WHEN n BETWEEN b1 AND b2 THEN 3 WHEN n BETWEEN b0 AND b1 THEN 4 WHEN n > b5 THEN 0 ELSE 4 END AS level FROM cells, b""",
)
def class_levels_equal(spark, sf_dir):
    cells = _cells(spark, sf_dir).drop("grid_key")
    return op.assign_levels(cells, op.class_breaks(cells, "n", "equal"), "n")


@query(
    "heat_clipped_maximum",
    with_(POINTS, NUMBERED, CELLS, RANKED)
    + f" SELECT {_pick(0.4)} AS q40, {_pick(0.6)} AS q60, {_pick(0.8)} AS q80, {_pick(0.95)} AS q95, greatest(1.0, {_pick(0.95)})::DOUBLE AS clipped_max",
)
def heat_clipped_maximum(spark, sf_dir):
    return op.clipped_maximum(_cells(spark, sf_dir), "n")


# A/B pairs: every trip's end cells become two boxes, so the pair table grows with trips.
PAIRS = """pairs AS (SELECT DISTINCT floor(start_lon / 0.05)::INT AS ax, floor(start_lat / 0.05)::INT AS ay,
  floor(end_lon / 0.05)::INT AS bx, floor(end_lat / 0.05)::INT AS by_ FROM od),
centred AS (SELECT ax, ay, bx, by_, (ax * 0.05::DOUBLE + (ax + 1) * 0.05::DOUBLE) / 2 AS alon, (ay * 0.05::DOUBLE + (ay + 1) * 0.05::DOUBLE) / 2 AS alat,
  (bx * 0.05::DOUBLE + (bx + 1) * 0.05::DOUBLE) / 2 AS blon, (by_ * 0.05::DOUBLE + (by_ + 1) * 0.05::DOUBLE) / 2 AS blat FROM pairs)"""


@query(
    "transition_threshold",
    with_(
        POINTS,
        OD,
        PAIRS,
        f"far AS (SELECT *, {haversine('alon', 'alat', 'blon', 'blat')} AS m FROM centred)",
        "sec AS (SELECT *, m / 2.8 * 1.6 AS raw FROM far)",
    )
    + """ SELECT ax, ay, bx, by_, round(m, 3) AS distance_meters, round(raw, 3) AS raw_seconds,
 least(7200, ceil(greatest(600.0, least(7200.0, raw)) / 60.0) * 60)::INT AS recommended_seconds,
 (least(7200, ceil(greatest(600.0, least(7200.0, raw)) / 60.0) * 60)::INT // 60)::INT AS recommended_minutes FROM sec""",
)
def transition_threshold(spark, sf_dir):
    od = lattice.trip_od(spark, sf_dir)
    cell = {"ax": "start_lon", "ay": "start_lat", "bx": "end_lon", "by_": "end_lat"}
    pairs = od.select(*[geo.degree_cell(F.col(c), 0.05).alias(n) for n, c in cell.items()]).distinct()
    boxes = pairs
    for side, x, y in (("a", "ax", "ay"), ("b", "bx", "by_")):
        for axis, column in (("lon", x), ("lat", y)):
            boxes = boxes.withColumn(f"{side}_min_{axis}", F.col(column) * 0.05)
            boxes = boxes.withColumn(f"{side}_max_{axis}", (F.col(column) + 1) * 0.05)
    out = op.transition_threshold(boxes)
    return out.select(
        "ax",
        "ay",
        "bx",
        "by_",
        F.round("distance_meters", 3).alias("distance_meters"),
        F.round("raw_seconds", 3).alias("raw_seconds"),
        "recommended_seconds",
        "recommended_minutes",
    )


# Two overlapping areas on many routes, so stays change often.
FLOW_A = geo.Box(116.245, 39.835, 116.345, 39.905)
FLOW_B = geo.Box(116.335, 39.835, 116.525, 40.06)
TAGGED = f"""tagged AS (SELECT * FROM (SELECT taxi_id, trip_id, gps_time, id,
  CASE WHEN {near(FLOW_A, 30)} THEN 'A' WHEN {near(FLOW_B, 30)} THEN 'B' END AS area FROM points WHERE {IN_TIME}) WHERE area IS NOT NULL)"""
CHANGES = """changes AS (SELECT * EXCLUDE (prev) FROM (SELECT *, lag(area) OVER (PARTITION BY taxi_id, trip_id ORDER BY gps_time, id) AS prev FROM tagged)
  WHERE prev IS NULL OR prev <> area)"""
MOVES = """moves AS (SELECT taxi_id, trip_id, gps_time AS leave_time, CASE WHEN area = 'A' THEN 'A_TO_B' ELSE 'B_TO_A' END AS direction,
  secs / 60.0::DOUBLE AS duration_min FROM (
    SELECT *, lead(area) OVER w AS a2, epoch_us(lead(gps_time) OVER w - gps_time) / 1e6 AS secs FROM changes
    WINDOW w AS (PARTITION BY taxi_id, trip_id ORDER BY gps_time, id)) WHERE a2 <> area AND secs BETWEEN 0 AND 3600)"""
FLOW = """flow AS (SELECT date_trunc('hour', leave_time) AS time_bucket, count(*) FILTER (direction = 'A_TO_B') AS a_to_b,
  count(*) FILTER (direction = 'B_TO_A') AS b_to_a, avg(duration_min) FILTER (direction = 'A_TO_B') AS a_to_b_avg_duration_min,
  avg(duration_min) FILTER (direction = 'B_TO_A') AS b_to_a_avg_duration_min FROM moves GROUP BY 1)"""


@query("area_tags", with_(POINTS, TAGGED) + " SELECT area, count(*) AS points, count(DISTINCT trip_id) AS trips FROM tagged GROUP BY area")
def area_tags(spark, sf_dir):
    tagged = op.tag_areas(lattice.taxi_points(spark, sf_dir), START, END, FLOW_A, FLOW_B)
    per_trip = tagged.groupBy("area", "trip_id").agg(F.count("*").alias("n"))
    return per_trip.groupBy("area").agg(F.sum("n").alias("points"), F.count("*").alias("trips"))


@query("area_changes", with_(POINTS, TAGGED, CHANGES) + " SELECT taxi_id, trip_id, gps_time, id, area FROM changes")
def area_changes(spark, sf_dir):
    return op.area_changes(op.tag_areas(lattice.taxi_points(spark, sf_dir), START, END, FLOW_A, FLOW_B), lattice.track_chunk(spark, sf_dir))


def _moves(spark, sf_dir):
    tagged = op.tag_areas(lattice.taxi_points(spark, sf_dir), START, END, FLOW_A, FLOW_B)
    chunk = lattice.track_chunk(spark, sf_dir)
    return op.area_transitions(op.area_changes(tagged, chunk), 3600, chunk)


@query(
    "area_transitions",
    with_(POINTS, TAGGED, CHANGES, MOVES)
    + " SELECT taxi_id, trip_id, leave_time, direction, round(duration_min, 6) AS duration_min FROM moves",
)
def area_transitions(spark, sf_dir):
    return rounded(_moves(spark, sf_dir))


@query(
    "ab_flow_hourly",
    with_(POINTS, TAGGED, CHANGES, MOVES, FLOW)
    + """ SELECT time_bucket, a_to_b, b_to_a, round(a_to_b_avg_duration_min, 6) AS a_to_b_avg_duration_min,
 round(b_to_a_avg_duration_min, 6) AS b_to_a_avg_duration_min, a_to_b + b_to_a AS total, a_to_b - b_to_a AS net_flow FROM flow""",
)
def ab_flow_hourly(spark, sf_dir):
    return rounded(op.ab_flow(_moves(spark, sf_dir)))


@query(
    "ab_flow_summary",
    with_(POINTS, TAGGED, CHANGES, MOVES, FLOW)
    + """ SELECT sum(a_to_b)::BIGINT AS a_to_b_total, sum(b_to_a)::BIGINT AS b_to_a_total, sum(a_to_b + b_to_a)::BIGINT AS total,
 sum(a_to_b - b_to_a)::BIGINT AS net_flow, CASE WHEN sum(a_to_b - b_to_a) > 0 THEN 'A_TO_B' WHEN sum(a_to_b - b_to_a) < 0 THEN 'B_TO_A' ELSE 'BALANCED' END AS dominant_direction,
 round(sum(a_to_b_avg_duration_min * a_to_b) / sum(a_to_b) FILTER (a_to_b_avg_duration_min IS NOT NULL), 6) AS a_to_b_avg_duration_min,
 round(sum(b_to_a_avg_duration_min * b_to_a) / sum(b_to_a) FILTER (b_to_a_avg_duration_min IS NOT NULL), 6) AS b_to_a_avg_duration_min FROM flow""",
)
def ab_flow_summary(spark, sf_dir):
    return rounded(op.ab_flow_summary(op.ab_flow(_moves(spark, sf_dir))))


CORE = AREA_A
S_IN, E_IN = near(CORE, 120, "start_lon", "start_lat"), near(CORE, 120, "end_lon", "end_lat")
STRICT = f"""events_ AS (
  SELECT taxi_id, trip_id, date_trunc('hour', start_time) AS time_bucket, 'outbound' AS direction, end_lon AS external_lon, end_lat AS external_lat,
         duration_seconds / 60.0::DOUBLE AS duration_min FROM od WHERE start_time BETWEEN {START_SQL} AND {END_SQL} AND {S_IN} AND NOT {E_IN}
  UNION ALL
  SELECT taxi_id, trip_id, date_trunc('hour', end_time), 'inbound', start_lon, start_lat, duration_seconds / 60.0::DOUBLE
  FROM od WHERE end_time BETWEEN {START_SQL} AND {END_SQL} AND {E_IN} AND NOT {S_IN})"""
IN_CORE = near(CORE, 120)
THROUGH = f"""core AS (SELECT taxi_id, trip_id, min(gps_time) AS t0, max(gps_time) AS t1 FROM points WHERE {IN_TIME} AND {IN_CORE} GROUP BY ALL),
events_ AS (
  SELECT taxi_id, trip_id, date_trunc('hour', t1) AS time_bucket, 'outbound' AS direction, lon AS external_lon, lat AS external_lat,
         epoch_us(gps_time - t1) / 6e7 AS duration_min FROM (
    SELECT p.*, t1, row_number() OVER (PARTITION BY taxi_id, trip_id ORDER BY gps_time, id) AS rn FROM points p JOIN core USING (taxi_id, trip_id)
    WHERE {IN_TIME} AND NOT {IN_CORE} AND gps_time > t1 AND gps_time <= t1 + INTERVAL 3600 SECOND) WHERE rn = 1
  UNION ALL
  SELECT taxi_id, trip_id, date_trunc('hour', t0), 'inbound', lon, lat, epoch_us(t0 - gps_time) / 6e7 FROM (
    SELECT p.*, t0, row_number() OVER (PARTITION BY taxi_id, trip_id ORDER BY gps_time DESC, id DESC) AS rn FROM points p JOIN core USING (taxi_id, trip_id)
    WHERE {IN_TIME} AND NOT {IN_CORE} AND gps_time < t0 AND gps_time >= t0 - INTERVAL 3600 SECOND) WHERE rn = 1)"""
EVENT_ROWS = """ SELECT taxi_id, trip_id, time_bucket, direction, external_lon, external_lat, round(duration_min, 6) AS duration_min FROM events_"""


@query("radiation_strict_events", with_(POINTS, OD, STRICT) + EVENT_ROWS)
def radiation_strict_events(spark, sf_dir):
    od = lattice.trip_od(spark, sf_dir)
    return rounded(op.radiation_strict(od, CORE, START, END, 120).drop("event_time"))


@query("radiation_through_events", with_(POINTS, THROUGH) + EVENT_ROWS)
def radiation_through_events(spark, sf_dir):
    points = lattice.taxi_points(spark, sf_dir)
    return rounded(op.radiation_through(points, CORE, START, END, 120).drop("event_time"))


@query("radiation_through_grid", with_(POINTS, THROUGH) + EVENT_ROWS)
def radiation_through_grid(spark, sf_dir):
    points = lattice.grid_points(spark, sf_dir)
    events = op.radiation_through(
        points, CORE, START, END, 120, order=("gps_time", "point_seq"), cell_step=0.01
    )
    return rounded(events.drop("event_time"))


REGIONS = """regions AS (SELECT hex_id AS region_id, count(*) FILTER (direction = 'outbound') AS outbound_total,
  count(*) FILTER (direction = 'inbound') AS inbound_total, count(*) AS total, sum(duration_min) AS duration_sum FROM placed GROUP BY hex_id),
top AS (SELECT * FROM regions ORDER BY total DESC, region_id LIMIT 30)"""


def _events(spark, sf_dir):
    return op.radiation_through(lattice.taxi_points(spark, sf_dir), CORE, START, END, 120)


PLACED = hexed("events_", "placed", "external_lon", "external_lat", 8)


@query(
    "radiation_top_regions",
    with_(POINTS, THROUGH, PLACED, REGIONS)
    + """ SELECT region_id, outbound_total, inbound_total, total, outbound_total - inbound_total AS net_flow,
 round(duration_sum / total, 6) AS avg_duration_min FROM top""",
)
def radiation_top_regions(spark, sf_dir):
    top = op.top_regions(op.radiation_regions(_events(spark, sf_dir), 8), 30)
    return rounded(top.drop("cell", "duration_sum"))


@query(
    "radiation_summary",
    with_(POINTS, OD, STRICT, PLACED, REGIONS)
    + """ SELECT sum(outbound_total)::BIGINT AS total_outbound, sum(inbound_total)::BIGINT AS total_inbound, sum(total)::BIGINT AS total_flow,
 sum(outbound_total - inbound_total)::BIGINT AS net_flow, CASE WHEN sum(outbound_total - inbound_total) > 0 THEN 'outbound'
 WHEN sum(outbound_total - inbound_total) < 0 THEN 'inbound' ELSE 'balanced' END AS dominant_direction,
 round(sum(duration_sum) / sum(total), 6) AS avg_duration_min, count(*) AS external_region_count,
 (SELECT sum(total) FROM top)::BIGINT AS top_k_flow, round((SELECT sum(total) FROM top) / sum(total), 6) AS top_k_ratio FROM regions""",
)
def radiation_summary(spark, sf_dir):
    od = lattice.trip_od(spark, sf_dir)
    events = op.radiation_strict(od, CORE, START, END, 120)
    return rounded(op.radiation_summary(op.radiation_regions(events, 8), 30))


@query(
    "radiation_series",
    with_(POINTS, THROUGH, PLACED, REGIONS)
    + """ SELECT region_id, time_bucket, count(*) FILTER (direction = 'outbound') AS outbound, count(*) FILTER (direction = 'inbound') AS inbound,
 count(*) AS total, count(*) FILTER (direction = 'outbound') - count(*) FILTER (direction = 'inbound') AS net_flow
 FROM placed JOIN (SELECT region_id FROM top) t ON t.region_id = placed.hex_id GROUP BY region_id, time_bucket""",
)
def radiation_series(spark, sf_dir):
    return op.radiation_series(_events(spark, sf_dir), 8, 30)


# Box arithmetic on the box of every trip.
TRIP_BOX = """tb AS (SELECT taxi_id, trip_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM points GROUP BY ALL)"""


@query(
    "trip_box_measures",
    with_(POINTS, TRIP_BOX)
    + f""" SELECT taxi_id, trip_id,
 round(min_lon - 200 / (111320.0 * greatest(0.01, abs(cos(radians((min_lat + max_lat) / 2))))), 6) AS grown_min_lon,
 round(max_lat + 200 / 110540.0, 6) AS grown_max_lat,
 round(greatest(0, least(max_lon, {AREA_B.max_lon}) - greatest(min_lon, {AREA_B.min_lon})) * greatest(0, least(max_lat, {AREA_B.max_lat}) - greatest(min_lat, {AREA_B.min_lat}))
   / nullif(least((max_lon - min_lon) * (max_lat - min_lat), ({AREA_B.max_lon}::DOUBLE - {AREA_B.min_lon}::DOUBLE) * ({AREA_B.max_lat}::DOUBLE - {AREA_B.min_lat}::DOUBLE)), 0), 6) AS overlap,
 (floor(max_lon / 0.01) - floor(min_lon / 0.01) + 1)::BIGINT * (floor(max_lat / 0.01) - floor(min_lat / 0.01) + 1)::BIGINT AS cell_count
 FROM tb WHERE max_lon > min_lon AND max_lat > min_lat""",
)
def trip_box_measures(spark, sf_dir):
    boxes = (
        lattice.taxi_points(spark, sf_dir)
        .groupBy("taxi_id", "trip_id")
        .agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lon", "lat")])
        .filter("max_lon > min_lon AND max_lat > min_lat")
    )
    b = AREA_B
    boxes = boxes.select(
        "*",
        F.lit(b.min_lon).alias("b_min_lon"),
        F.lit(b.min_lat).alias("b_min_lat"),
        F.lit(b.max_lon).alias("b_max_lon"),
        F.lit(b.max_lat).alias("b_max_lat"),
    )
    grown = geo.grow_box_columns("", F.lit(200.0))
    xs, ys = geo.explode_box_cells(0.01)
    return boxes.select(
        "taxi_id",
        "trip_id",
        F.round(grown[0], 6).alias("grown_min_lon"),
        F.round(grown[3], 6).alias("grown_max_lat"),
        F.round(geo.overlap_ratio("", "b_"), 6).alias("overlap"),
        (F.size(xs).cast("long") * F.size(ys)).alias("cell_count"),
    )


@query(
    "boxes_from_json",
    with_(
        POINTS,
        boxes_values(BOXES),
        "m AS (SELECT b.box_index AS ordinal, count(*) AS points FROM points p JOIN boxes b ON p.lon BETWEEN b.min_lon AND b.max_lon AND p.lat BETWEEN b.min_lat AND b.max_lat GROUP BY 1)",
    )
    + " SELECT * FROM m",
)
def boxes_from_json(spark, sf_dir):
    """Boxes arrive as a JSON request text and keep their ordinal."""
    import json

    from wayloom.sources.tables import parameters_from_json

    text = json.dumps([b.__dict__ for b in BOXES])
    request = parameter_table(spark, [{"body": text}], "body STRING")
    boxes = parameters_from_json(request, "body", "min_lon:double,min_lat:double,max_lon:double,max_lat:double").drop("body")
    points = lattice.taxi_points(spark, sf_dir).select("lon", "lat")
    hits = points.join(F.broadcast(boxes), geo.in_box_columns(F.col("lon"), F.col("lat")))
    return hits.groupBy("ordinal").agg(F.count("*").alias("points"))
