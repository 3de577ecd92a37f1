"""Trip tables, polylines and matched-trip queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators import lines, trips as op
from wayloom.plans.registry import query
from wayloom.plans.shape import END, END_SQL, START, START_SQL, rounded, vertices
from wayloom.plans.sqltext import POINTS, TRIPS, haversine, inside, with_
from wayloom.sources import lattice

BOX = geo.Box(116.25, 39.85, 116.45, 40.0)

NUMBERED = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY taxi_id, trip_id ORDER BY gps_time, id) AS point_seq,
         floor(lon / 0.01)::INT AS grid_x, floor(lat / 0.01)::INT AS grid_y FROM points)"""

OD = """od AS (
  SELECT taxi_id, trip_id, min(gps_time) AS start_time, max(gps_time) AS end_time,
         arg_min(lon, (gps_time, id)) AS start_lon, arg_min(lat, (gps_time, id)) AS start_lat,
         arg_max(lon, (gps_time, id)) AS end_lon, arg_max(lat, (gps_time, id)) AS end_lat,
         count(*) AS point_count, epoch_us(max(gps_time) - min(gps_time)) / 1e6 AS duration_seconds
  FROM points GROUP BY taxi_id, trip_id)"""


@query("od_endpoints", with_(POINTS, OD) + " SELECT * FROM od")
def od_endpoints(spark, sf_dir):
    return op.od_endpoints(lattice.taxi_points(spark, sf_dir))


@query(
    "trip_grid_points",
    with_(POINTS, NUMBERED)
    + """ SELECT taxi_id, trip_id, point_seq::INT AS point_seq, gps_time, lon, lat, grid_x, grid_y,
 grid_x || ':' || grid_y AS grid_key FROM numbered""",
)
def trip_grid_points(spark, sf_dir):
    return op.trip_grid_points(lattice.taxi_points(spark, sf_dir), chunk_seconds=lattice.track_chunk(spark, sf_dir))


@query(
    "trip_spatial_index",
    with_(POINTS, NUMBERED)
    + """ SELECT taxi_id, trip_id, grid_x, grid_y, grid_x || ':' || grid_y AS grid_key,
 min(gps_time) AS first_seen_time, max(gps_time) AS last_seen_time, min(point_seq)::INT AS first_point_seq,
 count(*)::INT AS point_count FROM numbered GROUP BY ALL""",
)
def trip_spatial_index(spark, sf_dir):
    return op.trip_spatial_index(op.trip_grid_points(lattice.taxi_points(spark, sf_dir), chunk_seconds=lattice.track_chunk(spark, sf_dir)))


@query(
    "candidate_trips",
    with_(POINTS)
    + f""" SELECT taxi_id, trip_id, min(gps_time) AS first_time FROM points WHERE {inside(BOX)}
 GROUP BY taxi_id, trip_id ORDER BY first_time, taxi_id, trip_id LIMIT 500""",
)
def candidate_trips(spark, sf_dir):
    points = op.filter_points(lattice.taxi_points(spark, sf_dir), START, END, None, BOX)
    return op.candidate_trips(points, 500)


SEGMENTED = f"""lagged AS (
  SELECT *, lag(gps_time) OVER w AS pt, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM points
  WINDOW w AS (PARTITION BY taxi_id, trip_id ORDER BY gps_time, id)),
measured AS (SELECT *, epoch_us(gps_time - pt) / 1e6 AS dt, {haversine("plon", "plat", "lon", "lat")} AS m FROM lagged),
segmented AS (
  SELECT *, (sum(CASE WHEN pt IS NULL OR dt <= 0 OR dt > 120 * 60 OR m > 0.95 * 1000 OR m / nullif(dt, 0) > 45.0 / 3.6
              THEN 1 ELSE 0 END) OVER (PARTITION BY taxi_id, trip_id ORDER BY gps_time, id ROWS UNBOUNDED PRECEDING))::BIGINT AS segment_id
  FROM measured)"""
BREAKS = {"max_gap_minutes": 120, "max_jump_km": 0.95, "max_speed_kmh": 45.0}


@query("segment_breaks", with_(POINTS, SEGMENTED) + " SELECT taxi_id, trip_id, id, segment_id FROM segmented")
def segment_breaks(spark, sf_dir):
    points = op.segment_points(lattice.taxi_points(spark, sf_dir), **BREAKS, chunk_seconds=lattice.track_chunk(spark, sf_dir))
    return points.select("taxi_id", "trip_id", "id", F.col("segment_id").cast("long").alias("segment_id"))


@query(
    "polylines",
    with_(POINTS, SEGMENTED)
    + """, lines AS (SELECT taxi_id, trip_id || '_s' || segment_id AS trip_id, count(*) AS point_count,
  min(gps_time) AS start_time, max(gps_time) AS end_time, list({'lon': lon, 'lat': lat} ORDER BY gps_time, id) AS coords
  FROM segmented GROUP BY taxi_id, segmented.trip_id, segment_id HAVING count(*) >= 2),
shown AS (SELECT *, (SELECT count(*) FROM lines) AS total_segment_count FROM lines)
SELECT taxi_id, trip_id, point_count, start_time, end_time, total_segment_count, n, round(p.lon, 6) AS lon, round(p.lat, 6) AS lat
FROM (SELECT *, unnest(coords) AS p, unnest(range(1, len(coords) + 1)) AS n FROM shown)""",
)
def polylines(spark, sf_dir):
    found = op.polylines(lattice.taxi_points(spark, sf_dir), START, END, **BREAKS, chunk_seconds=lattice.track_chunk(spark, sf_dir))
    return vertices(found)


@query("polylines_simplified")
def polylines_simplified(spark, sf_dir):
    found = op.polylines(
        lattice.taxi_points(spark, sf_dir),
        START,
        END,
        tolerance=op.zoom_tolerance(9),
        **BREAKS,
        chunk_seconds=lattice.track_chunk(spark, sf_dir),
    )
    return vertices(found)


@query(
    "simplify_tracks",
)
def simplify_tracks(spark, sf_dir):
    """Douglas–Peucker over the raw line of every trip."""
    points = lattice.taxi_points(spark, sf_dir)
    track = points.groupBy("taxi_id", "trip_id").agg(
        geo.line_from_points([F.col("gps_time"), F.col("id")], F.col("lon"), F.col("lat")).alias("coords")
    )
    return lines.simplify(track, "coords", 0.0005).select(
        "taxi_id", "trip_id", F.size("coords").alias("vertex_count"), F.round(geo.line_length_m(F.col("coords")), 3).alias("length_m")
    )


@query(
    "base_trip_ids",
    with_(POINTS, SEGMENTED)
    + """ SELECT split_part(trip_id || '_s' || segment_id, '_s', 1) AS base_trip_id, count(DISTINCT segment_id) AS segments
 FROM segmented GROUP BY trip_id, segment_id % 1, split_part(trip_id || '_s' || segment_id, '_s', 1)""",
)
def base_trip_ids(spark, sf_dir):
    segments = op.segment_points(lattice.taxi_points(spark, sf_dir), **BREAKS, chunk_seconds=lattice.track_chunk(spark, sf_dir))
    named = segments.select(F.concat_ws("_s", "trip_id", "segment_id").alias("t")).groupBy("t").agg(F.lit(1).alias("one"))
    return named.groupBy(op.base_trip_id(F.col("t")).alias("base_trip_id")).agg(F.count("*").alias("segments"))


NODES_OF = """vertex AS (SELECT taxi_id, trip_id, k + 1 AS n, (116200000 + i * 10000)::DOUBLE / 1e6 AS lon,
  (39800000 + j * 8000)::DOUBLE / 1e6 AS lat FROM walk)"""


@query(
    "matched_of_taxi",
    with_(TRIPS, NODES_OF) + " SELECT taxi_id, trip_id, n, round(lon, 6) AS lon, round(lat, 6) AS lat FROM vertex WHERE taxi_id = 17",
)
def matched_of_taxi(spark, sf_dir):
    return vertices(op.matched_of_taxi(lattice.matched_trips(spark, sf_dir).drop("node_ids"), 17))


SEEN = f"""seen AS (SELECT taxi_id, trip_id, min(gps_time) AS start_time, max(gps_time) AS end_time FROM points
  WHERE gps_time BETWEEN {START_SQL} AND {END_SQL} AND {inside(BOX)} GROUP BY taxi_id, trip_id)"""


def _found(spark, sf_dir):
    matched = lattice.matched_trips(spark, sf_dir)
    return op.matched_in_box(lattice.taxi_points(spark, sf_dir), matched, START, END, BOX)


@query(
    "matched_in_box_counts",
    with_(POINTS, SEEN) + " SELECT count(DISTINCT taxi_id) AS active_vehicle_count, count(*) AS trip_count FROM seen",
)
def matched_in_box_counts(spark, sf_dir):
    return op.matched_counts(_found(spark, sf_dir)).select(
        "active_vehicle_count", F.col("trip_count").cast("long").alias("trip_count")
    )


@query(
    "matched_in_box_detail",
    with_(POINTS, SEEN, "sizes AS (SELECT taxi_id, trip_id, count(*) AS vertex_count FROM walk GROUP BY ALL)")
    + """ SELECT taxi_id, trip_id, start_time, end_time, vertex_count FROM seen JOIN sizes USING (taxi_id, trip_id)""",
)
def matched_in_box_detail(spark, sf_dir):
    return op.matched_detail(_found(spark, sf_dir)).select(
        "taxi_id", "trip_id", "start_time", "end_time", F.size("coords").cast("long").alias("vertex_count")
    )


@query(
    "raw_and_matched",
    with_(POINTS, OD, "sizes AS (SELECT taxi_id, trip_id, count(*) AS n FROM walk GROUP BY ALL)")
    + """ SELECT taxi_id, trip_id, point_count AS raw_point_count, n AS matched_point_count, true AS has_matched,
 start_lon AS raw_start_lon, end_lat AS raw_end_lat FROM od JOIN sizes USING (taxi_id, trip_id)""",
)
def raw_and_matched(spark, sf_dir):
    both = op.raw_and_matched(lattice.taxi_points(spark, sf_dir), lattice.matched_trips(spark, sf_dir))
    return both.select(
        "taxi_id",
        "trip_id",
        F.col("raw_point_count").cast("long").alias("raw_point_count"),
        F.size("matched_coords").cast("long").alias("matched_point_count"),
        "has_matched",
        geo.line_start(F.col("raw_coords"))["lon"].alias("raw_start_lon"),
        geo.line_end(F.col("raw_coords"))["lat"].alias("raw_end_lat"),
    )


@query(
    "line_measures",
    with_(
        TRIPS,
        NODES_OF,
        f"""pairs AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM vertex WINDOW w AS (PARTITION BY taxi_id, trip_id ORDER BY n)),
seg AS (SELECT *, coalesce({haversine("plon", "plat", "lon", "lat")}, 0) AS m, coalesce(sqrt(pow(lon - plon, 2) + pow(lat - plat, 2)), 0) AS w FROM pairs)""",
    )
    + """ SELECT taxi_id, trip_id, round(sum(m), 3) AS length_m, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon,
 max(lat) AS max_lat, round(coalesce(sum(w * (lon + plon) / 2) / nullif(sum(w), 0), min(lon)), 6) AS centroid_lon,
 round(coalesce(sum(w * (lat + plat) / 2) / nullif(sum(w), 0), min(lat)), 6) AS centroid_lat,
 arg_min(lon, n) AS start_lon, arg_max(lat, n) AS end_lat, count(DISTINCT (round(lon, 3), round(lat, 3))) AS signature_size
 FROM seg GROUP BY taxi_id, trip_id""",
)
def line_measures(spark, sf_dir):
    line = F.col("coords")
    centre = geo.line_centroid(line)
    return lattice.matched_trips(spark, sf_dir).select(
        "taxi_id",
        "trip_id",
        F.round(geo.line_length_m(line), 3).alias("length_m"),
        *geo.line_box(line),
        F.round(centre["lon"], 6).alias("centroid_lon"),
        F.round(centre["lat"], 6).alias("centroid_lat"),
        geo.line_start(line)["lon"].alias("start_lon"),
        geo.line_end(line)["lat"].alias("end_lat"),
        F.size(geo.grid_signature(line)).cast("long").alias("signature_size"),
    )


@query(
    "layer_extent",
    with_(TRIPS, NODES_OF) + " SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM vertex",
)
def layer_extent(spark, sf_dir):
    return lines.extent(lattice.matched_trips(spark, sf_dir))


@query(
    "line_vertices",
    with_(TRIPS, NODES_OF) + " SELECT taxi_id, trip_id, n AS point_index, lon, lat FROM vertex",
)
def line_vertices(spark, sf_dir):
    return lines.line_vertices(lattice.matched_trips(spark, sf_dir), ["taxi_id", "trip_id"])


def _axis(a: str, b: str, low: float, high: float) -> tuple[str, str]:
    d = f"({b} - {a})"
    t1, t2 = f"(({low!r}::DOUBLE - {a}) / nullif({d}, 0))", f"(({high!r}::DOUBLE - {a}) / nullif({d}, 0))"
    ok = f"({a} BETWEEN {low!r}::DOUBLE AND {high!r}::DOUBLE)"
    return (
        f"CASE WHEN {d} = 0 THEN CASE WHEN {ok} THEN 0.0 ELSE 2.0 END ELSE least({t1}, {t2}) END",
        f"CASE WHEN {d} = 0 THEN CASE WHEN {ok} THEN 1.0 ELSE -1.0 END ELSE greatest({t1}, {t2}) END",
    )


def _clip_sql(box: geo.Box) -> str:
    ex, lx = _axis("plon", "lon", box.min_lon, box.max_lon)
    ey, ly = _axis("plat", "lat", box.min_lat, box.max_lat)
    return f"greatest(0.0, {ex}, {ey}) AS t0, least(1.0, {lx}, {ly}) AS t1"


STEP_PAIRS = """pairs AS (SELECT * FROM (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM vertex
  WINDOW w AS (PARTITION BY taxi_id, trip_id ORDER BY n)) WHERE plon IS NOT NULL)"""
CLIP_BOX = geo.Box(116.247, 39.843, 116.333, 39.957)


@query(
    "lines_meeting_box",
    with_(TRIPS, NODES_OF, STEP_PAIRS, f"cut AS (SELECT taxi_id, trip_id, {_clip_sql(CLIP_BOX)} FROM pairs)")
    + " SELECT DISTINCT taxi_id, trip_id FROM cut WHERE t0 <= t1",
)
def lines_meeting_box(spark, sf_dir):
    matched = lattice.matched_trips(spark, sf_dir)
    return matched.filter(geo.line_meets_box(F.col("coords"), CLIP_BOX.columns())).select("taxi_id", "trip_id")


@query(
    "clip_lines_to_box",
    with_(
        TRIPS,
        NODES_OF,
        STEP_PAIRS,
        f"""cut AS (SELECT taxi_id, trip_id, n, plon + t0 * (lon - plon) AS x0, plat + t0 * (lat - plat) AS y0,
  plon + t1 * (lon - plon) AS x1, plat + t1 * (lat - plat) AS y1 FROM (SELECT *, {_clip_sql(CLIP_BOX)} FROM pairs) WHERE t0 <= t1),
real AS (SELECT * FROM cut WHERE NOT (abs(x0 - x1) < 1e-10 AND abs(y0 - y1) < 1e-10)),
flag AS (SELECT *, CASE WHEN abs(lag(x1) OVER w - x0) < 1e-10 AND abs(lag(y1) OVER w - y0) < 1e-10 THEN 0 ELSE 1 END AS fresh
  FROM real WINDOW w AS (PARTITION BY taxi_id, trip_id ORDER BY n)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY taxi_id, trip_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS piece FROM flag)""",
    )
    + """ SELECT taxi_id, trip_id, piece::INT AS piece, count(*) + 1 AS vertex_count, round(arg_min(x0, n), 6) AS start_lon,
 round(arg_min(y0, n), 6) AS start_lat, round(arg_max(x1, n), 6) AS end_lon, round(arg_max(y1, n), 6) AS end_lat
 FROM numbered GROUP BY taxi_id, trip_id, piece""",
)
def clip_lines_to_box(spark, sf_dir):
    from wayloom.sources.tables import box_table

    pieces = lines.clip_to_boxes(
        lattice.matched_trips(spark, sf_dir), box_table(spark, [CLIP_BOX]), ["taxi_id", "trip_id"]
    )
    start, end = geo.line_start(F.col("coords")), geo.line_end(F.col("coords"))
    return pieces.select(
        "taxi_id",
        "trip_id",
        "piece",
        F.size("coords").cast("long").alias("vertex_count"),
        F.round(start["lon"], 6).alias("start_lon"),
        F.round(start["lat"], 6).alias("start_lat"),
        F.round(end["lon"], 6).alias("end_lon"),
        F.round(end["lat"], 6).alias("end_lat"),
    )


# Playback compares the matched line of a trip, stored backwards for odd trips, with its
# raw points between the 3rd and the 3rd-last one (or all when the trip is short).
PLAYBACK = """line AS (SELECT taxi_id, trip_id, CASE WHEN trip_id % 2 = 1 THEN list(struct_pack(lon := lon, lat := lat) ORDER BY n DESC)
  ELSE list(struct_pack(lon := lon, lat := lat) ORDER BY n) END AS m FROM vertex GROUP BY taxi_id, trip_id),
rawall AS (SELECT taxi_id, trip_id, list(struct_pack(lon := lon, lat := lat) ORDER BY gps_time, id) AS r FROM points GROUP BY ALL),
raw AS (SELECT taxi_id, trip_id, CASE WHEN len(r) > 6 THEN r[3:len(r) - 2] ELSE r END AS r FROM rawall),
pos AS (SELECT taxi_id, trip_id, len(m) AS nm, len(r) AS nr, unnest(m) AS p, unnest(range(len(m))) AS n, r[1] AS rs, r[len(r)] AS re,
  m[1] AS ms, m[len(m)] AS me FROM line JOIN raw USING (taxi_id, trip_id)),
near AS (SELECT taxi_id, trip_id, any_value(nm) AS nm, any_value(nr) AS nr,
  min((pow(p.lon - rs.lon, 2) + pow(p.lat - rs.lat, 2), n)) AS a, min((pow(p.lon - re.lon, 2) + pow(p.lat - re.lat, 2), n)) AS b,
  any_value(pow(me.lon - rs.lon, 2) + pow(me.lat - rs.lat, 2) + pow(ms.lon - re.lon, 2) + pow(ms.lat - re.lat, 2)
          < pow(ms.lon - rs.lon, 2) + pow(ms.lat - rs.lat, 2) + pow(me.lon - re.lon, 2) + pow(me.lat - re.lat, 2)) AS flip
  FROM pos GROUP BY taxi_id, trip_id)"""


@query(
    "playback_slices",
    with_(POINTS, NODES_OF, PLAYBACK)
    + """ SELECT taxi_id, trip_id, CASE WHEN nm < 2 OR nr < 2 OR a[2] = b[2] THEN nm ELSE abs(a[2] - b[2]) + 1 END AS vertex_count,
 CASE WHEN nm < 2 OR nr < 2 THEN 'same' WHEN a[2] = b[2] THEN CASE WHEN flip THEN 'turned' ELSE 'same' END
      WHEN a[2] < b[2] THEN 'cut' ELSE 'cut back' END AS how, nm >= 2 AND nr >= 2 AND flip AS turned FROM near""",
)
def playback_slices(spark, sf_dir):
    both = op.raw_and_matched(lattice.taxi_points(spark, sf_dir), lattice.matched_trips(spark, sf_dir))
    raw, matched = F.col("raw"), F.col("matched")
    both = both.select(
        "taxi_id",
        "trip_id",
        F.when(F.size("raw_coords") > 6, F.slice("raw_coords", F.lit(3), F.size("raw_coords") - 4))
        .otherwise(F.col("raw_coords"))
        .alias("raw"),
        F.when(F.col("trip_id") % 2 == 1, F.reverse("matched_coords")).otherwise(F.col("matched_coords")).alias("matched"),
    )
    done = lines.playback(both, "matched", "raw", "cut").withColumn("turn", lines.aligned(matched, raw))
    n, full, a, b = F.size("cut"), F.size("matched"), F.col("_from"), F.col("_to")
    usable = (full >= 2) & (F.size(raw) >= 2)
    turned = usable & (F.col("turn") != matched)
    return done.select(
        "taxi_id",
        "trip_id",
        n.cast("long").alias("vertex_count"),
        F.when(~usable, "same")
        .when(a == b, F.when(turned, "turned").otherwise("same"))
        .when(a < b, "cut")
        .otherwise("cut back")
        .alias("how"),
        turned.alias("turned"),
    )


def _waves_sql(v: str, terms) -> str:
    return "(" + " + ".join(f"{w} * sin({v} * {f * math.pi!r}::DOUBLE)" for w, f in terms) + ") * 2.0 / 3.0"


def _shift_sql(lon: str, lat: str) -> tuple[str, str]:
    x, y = f"({lon} - 105.0)", f"({lat} - 35.0)"
    ripple = _waves_sql(x, [(20.0, 6.0), (20.0, 2.0)])
    d_lat = (
        f"(-100.0 + 2.0 * {x} + 3.0 * {y} + 0.2 * {y} * {y} + 0.1 * {x} * {y} + 0.2 * sqrt(abs({x})) + {ripple} + "
        + _waves_sql(y, [(20.0, 1.0), (40.0, 1 / 3)])
        + " + "
        + _waves_sql(y, [(160.0, 1 / 12), (320.0, 1 / 30)])
        + ") * 180.0 / (6335552.717000426 * pi())"
    )
    magic = f"(1 - 0.00669342162296594323::DOUBLE * pow(sin(radians({lat})), 2))"
    d_lon = (
        f"(300.0 + {x} + 2.0 * {y} + 0.1 * {x} * {x} + 0.1 * {x} * {y} + 0.1 * sqrt(abs({x})) + {ripple} + "
        + _waves_sql(x, [(20.0, 1.0), (40.0, 1 / 3)])
        + " + "
        + _waves_sql(x, [(150.0, 1 / 12), (300.0, 1 / 30)])
        + f") * 180.0 / (6378245.0 / sqrt({magic}) * cos(radians({lat})) * pi())"
    )
    return d_lon, d_lat


_DX, _DY = _shift_sql("lon", "lat")
_BX, _BY = _shift_sql("slon", "slat")


@query(
    "points_offset_datum",
    with_(POINTS, f"moved AS (SELECT id, lon + {_DX} AS slon, lat + {_DY} AS slat FROM points)")
    + f" SELECT id, round(slon, 6) AS lon, round(slat, 6) AS lat, round(slon - {_BX}, 6) AS back_lon, round(slat - {_BY}, 6) AS back_lat FROM moved",
)
def points_offset_datum(spark, sf_dir):
    shifted = geo.to_offset_datum(F.col("lon"), F.col("lat"))
    back = geo.from_offset_datum(F.col("s.lon"), F.col("s.lat"))
    points = lattice.taxi_points(spark, sf_dir).withColumn("s", shifted)
    return rounded(
        points.select("id", F.col("s.lon").alias("lon"), F.col("s.lat").alias("lat"), back["lon"].alias("back_lon"), back["lat"].alias("back_lat"))
    )


@query(
    "geojson_tracks",
    with_(TRIPS, NODES_OF)
    + """ SELECT taxi_id, trip_id, count(*) AS vertex_count, 'LineString' AS geometry_type,
 round(arg_min(lon, n), 6) AS first_lon FROM vertex GROUP BY taxi_id, trip_id""",
)
def geojson_tracks(spark, sf_dir):
    """Feature text per trip, read back through the JSON functions."""
    features = lattice.matched_trips(spark, sf_dir).select(
        geo.geojson_feature(geo.geojson_line(F.col("coords")), F.struct("taxi_id", "trip_id")).alias("feature")
    )
    schema = (
        "type string, geometry struct<type:string,coordinates:array<array<double>>>, "
        "properties struct<taxi_id:bigint,trip_id:bigint>"
    )
    parsed = features.select(F.from_json("feature", schema).alias("f"))
    return parsed.select(
        "f.properties.taxi_id",
        "f.properties.trip_id",
        F.size("f.geometry.coordinates").cast("long").alias("vertex_count"),
        F.col("f.geometry.type").alias("geometry_type"),
        F.round(F.col("f.geometry.coordinates")[0][0], 6).alias("first_lon"),
    )
