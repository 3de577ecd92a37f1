"""Road facts, rollups, tokens and table maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import names
from wayloom.operators import roads as op
from wayloom.operators.trips import trip_spatial_index
from wayloom.plans.registry import query
from wayloom.plans.shape import joined, rounded
from wayloom.plans.sqltext import EDGES, POINTS, ROADS, TRIPS, haversine, with_
from wayloom.plans.trips import NUMBERED
from wayloom.sources import lattice, tables

MEASURED = haversine("lon0", "lat0", "lon1", "lat1")
# RE2 has no look-around, so the check spells the same rules with plain groups.
_PACKED = "regexp_replace(lower(name), '\\s+', '', 'g')"
_NORMAL = f"regexp_replace(regexp_replace({_PACKED}, '{names.FRAGMENT_SUFFIX}', ''), '{names.BRACKET_SUFFIX}', '')"
NAMED = f"""featured AS (SELECT edge_uid AS road_uid, id, u, v, highway, oneway, lon0, lat0, lon1, lat1, name,
  CASE WHEN length > 0 THEN length ELSE {MEASURED} END AS segment_length_m, {MEASURED} AS measured_m,
  CASE WHEN {_PACKED} IN ('', 'unnamed', 'unknown', 'null') OR {_NORMAL} IN ('', 'unnamed', 'unknown', 'null') THEN NULL ELSE {_NORMAL} END AS key,
  coalesce(nullif(trim(name), ''), 'edge:' || id) AS road_group_key FROM roads)"""
TOKENS = """tokened AS (SELECT *, CASE
  WHEN key IS NOT NULL AND (highway IN ('motorway', 'trunk', 'primary', 'secondary') OR segment_length_m >= 200) AND segment_length_m >= 20 THEN 'road:' || key
  WHEN key IS NULL AND highway IN ('motorway', 'trunk', 'primary') AND segment_length_m >= 200 THEN 'edge:' || road_uid END AS token FROM featured)"""
PASSES = """groups_ AS (SELECT road_group_key, sum(measured_m) AS group_length_m FROM featured
  WHERE road_uid IN (SELECT road_uid FROM edges) GROUP BY road_group_key),
passes AS (SELECT DISTINCT e.taxi_id, e.trip_id, e.road_uid, f.id AS road_id, f.road_group_key, e.direction, f.road_group_key AS road_name, f.highway,
  lower(coalesce(f.oneway, '')) IN ('yes', 'true', '1', 't', '-1', 'reverse', 'backward') AS has_oneway_segment, 1 AS segment_count,
  g.group_length_m, f.measured_m AS matched_segment_length_m, start_time, end_time
  FROM edges e JOIN featured f USING (road_uid) JOIN groups_ g USING (road_group_key) JOIN od USING (taxi_id, trip_id))"""
# Trip times straight from the trip table: the first and last point of a walk.
OD_FAST = """od AS (SELECT taxi_id, trip_id, TIMESTAMP '2008-02-02 00:00:00' + to_seconds(min(at_s)) AS start_time,
  TIMESTAMP '2008-02-02 00:00:00' + to_seconds(max(at_s)) AS end_time, (max(at_s) - min(at_s))::DOUBLE AS duration_seconds FROM walk GROUP BY ALL)"""
HOURLY = """hourly AS (SELECT road_uid, direction, date_trunc('hour', start_time) AS hour_bucket, count(*) AS trip_count,
  count(DISTINCT taxi_id) AS vehicle_count FROM passes GROUP BY ALL)"""
GROUP_HOURLY = """per_trip AS (SELECT road_group_key, direction, date_trunc('hour', start_time) AS hour_bucket, taxi_id, trip_id, count(*) AS w FROM passes GROUP BY ALL),
group_hourly AS (SELECT road_group_key, direction, hour_bucket, count(*) AS trip_count, count(DISTINCT taxi_id) AS vehicle_count,
  sum(w)::BIGINT AS edge_pass_weight FROM per_trip GROUP BY ALL)"""
FACTS = (EDGES, ROADS, NAMED, OD_FAST, PASSES)


@query(
    "matched_trip_edges",
    with_(EDGES) + " SELECT taxi_id, trip_id, edge_seq::INT AS edge_seq, road_uid, road_uid + 1 AS road_id, direction::SMALLINT AS direction FROM edges",
)
def matched_trip_edges(spark, sf_dir):
    return op.edge_sequence(lattice.matched_trips(spark, sf_dir), lattice.road_edges(spark))


@query(
    "edges_from_coordinates",
    with_(EDGES) + " SELECT taxi_id, trip_id, edge_seq::INT AS edge_seq, road_uid, direction::SMALLINT AS direction FROM edges",
)
def edges_from_coordinates(spark, sf_dir):
    """Node ids looked up by exact vertex coordinates first."""
    matched = lattice.matched_trips(spark, sf_dir).drop("node_ids")
    with_ids = op.with_node_ids(matched, lattice.road_nodes(spark))
    return op.edge_sequence(with_ids, lattice.road_edges(spark)).drop("road_id")


@query(
    "road_features_travelled",
    with_(EDGES, ROADS, NAMED)
    + """ SELECT road_uid, highway AS highway_class, key AS road_group_key, round(segment_length_m, 3) AS segment_length_m,
 least(lon0, lon1) AS min_lon, least(lat0, lat1) AS min_lat, greatest(lon0, lon1) AS max_lon, greatest(lat0, lat1) AS max_lat, count(*) AS uses
 FROM edges JOIN featured USING (road_uid) GROUP BY ALL""",
)
def road_features_travelled(spark, sf_dir):
    uses = lattice.trip_edges(spark, sf_dir).groupBy("road_uid").agg(F.count("*").alias("uses"))
    features = op.road_features(lattice.road_edges(spark)).join(uses, "road_uid")
    return features.withColumn("segment_length_m", F.round("segment_length_m", 3))


@query(
    "road_passes",
    with_(*FACTS)
    + """ SELECT taxi_id, trip_id, road_uid, road_id, road_group_key, direction::SMALLINT AS direction, road_name, highway, has_oneway_segment,
 segment_count, round(group_length_m, 3) AS group_length_m, round(matched_segment_length_m, 3) AS matched_segment_length_m, start_time, end_time FROM passes""",
)
def road_passes(spark, sf_dir):
    return lattice.passes(spark, sf_dir, digits=3)


@query(
    "road_group_lengths_distinct",
    with_(EDGES, ROADS, NAMED)
    + """, lens AS (SELECT DISTINCT road_group_key, measured_m FROM featured WHERE road_uid IN (SELECT road_uid FROM edges))
 SELECT road_group_key, round(sum(measured_m), 3) AS group_length_m FROM lens GROUP BY road_group_key""",
)
def road_group_lengths_distinct(spark, sf_dir):
    passes = lattice.passes(spark, sf_dir, True)
    return rounded(passes.groupBy("road_group_key").agg(F.max("group_length_m").alias("group_length_m")), 3)


@query("road_hourly_counts", with_(*FACTS, HOURLY) + " SELECT road_uid, direction::SMALLINT AS direction, hour_bucket, trip_count, vehicle_count FROM hourly")
def road_hourly_counts(spark, sf_dir):
    return op.road_hourly_counts(lattice.passes(spark, sf_dir))


@query(
    "road_group_hourly_counts",
    with_(*FACTS, GROUP_HOURLY)
    + " SELECT road_group_key, direction::SMALLINT AS direction, hour_bucket, trip_count, vehicle_count, edge_pass_weight FROM group_hourly",
)
def road_group_hourly_counts(spark, sf_dir):
    return op.road_group_hourly_counts(lattice.passes(spark, sf_dir))


@query(
    "edge_arrays",
    with_(EDGES)
    + """ SELECT taxi_id, trip_id, count(*)::INT AS edge_count, string_agg(road_uid::VARCHAR, ',' ORDER BY edge_seq) AS road_uids
 FROM edges GROUP BY taxi_id, trip_id""",
)
def edge_arrays(spark, sf_dir):
    arrays = op.edge_arrays(lattice.trip_edges(spark, sf_dir))
    return arrays.select("taxi_id", "trip_id", "edge_count", joined(F.col("road_uid_array")).alias("road_uids"))


@query(
    "trip_tokens",
    with_(
        EDGES,
        ROADS,
        NAMED,
        TOKENS,
        OD_FAST,
        """te AS (SELECT e.taxi_id, e.trip_id, e.edge_seq, t.token, t.segment_length_m FROM edges e JOIN tokened t USING (road_uid)),
sizes AS (SELECT taxi_id, trip_id, count(*)::INT AS raw_edge_count, sum(segment_length_m) AS route_length_m FROM te GROUP BY ALL),
seqs AS (SELECT taxi_id, trip_id, string_agg(token, ',' ORDER BY edge_seq) AS sequence_tokens FROM (
  SELECT *, lag(token) OVER (PARTITION BY taxi_id, trip_id ORDER BY edge_seq) AS prev FROM te WHERE token IS NOT NULL)
  WHERE prev IS DISTINCT FROM token GROUP BY ALL),
vecs AS (SELECT taxi_id, trip_id, string_agg(token, ',' ORDER BY first_seq) AS vector_tokens FROM (
  SELECT taxi_id, trip_id, token, min(edge_seq) AS first_seq FROM te WHERE token IS NOT NULL GROUP BY ALL) GROUP BY ALL)""",
    )
    + """ SELECT taxi_id, trip_id, start_time, end_time, duration_seconds, round(route_length_m, 3) AS route_length_m, raw_edge_count,
 coalesce(vector_tokens, '') AS vector_tokens, coalesce(sequence_tokens, '') AS sequence_tokens
 FROM sizes JOIN od USING (taxi_id, trip_id) LEFT JOIN seqs USING (taxi_id, trip_id) LEFT JOIN vecs USING (taxi_id, trip_id)""",
)
def trip_tokens(spark, sf_dir):
    tokens = op.trip_tokens(
        lattice.trip_edges(spark, sf_dir), lattice.road_edges(spark), lattice.trip_od(spark, sf_dir)
    )
    return rounded(
        tokens.withColumn("vector_tokens", joined(F.col("vector_token_array")))
        .withColumn("sequence_tokens", joined(F.col("sequence_token_array")))
        .drop("vector_token_array", "sequence_token_array"),
        3,
    )


_D = names.CHINESE_DIGITS
_W = "[^\\p{L}\\p{N}_]"
_KNOWN = " ".join(f"WHEN contains(key, '{w}') THEN '{r}'" for w, r in names.EXPRESSWAY_ROUTES)
_BASE = f"regexp_replace(key, '{names.FAST_ROAD_SUFFIX}', '')"
ALIASES = f"""aliased AS (SELECT road_uid, nullif(regexp_extract(key, '(^|{_W})([gsx]\\d+[a-z]?)($|{_W})', 2), '') AS code,
  CASE {_KNOWN} END AS known, nullif(regexp_extract(key, '([{_D}0-9]+环)', 1), '') AS ring,
  CASE WHEN (regexp_matches(key, '(高速|快速路|快速)$') OR highway IN ('motorway', 'trunk')) AND length({_BASE}) >= 2 THEN {_BASE} END AS base FROM featured)"""


@query(
    "road_aliases_travelled",
    with_(EDGES, ROADS, NAMED)
    + f""", used AS (SELECT f.*, n FROM featured f JOIN (SELECT road_uid, count(*) AS n FROM edges GROUP BY 1) USING (road_uid)),
parts AS (SELECT road_uid, n, key, nullif(regexp_extract(key, '(^|{_W})([gsx]\\d+[a-z]?)($|{_W})', 2), '') AS code,
  CASE {_KNOWN} END AS known, nullif(regexp_extract(key, '([{_D}0-9]+环)', 1), '') AS ring,
  CASE WHEN (regexp_matches(key, '(高速|快速路|快速)$') OR highway IN ('motorway', 'trunk')) AND length({_BASE}) >= 2 THEN {_BASE} END AS base FROM used)
SELECT road_uid, n AS uses, CASE WHEN key IS NULL THEN '' ELSE concat_ws(',', 'alias:route:' || code, 'alias:route:' || known, 'alias:ring:' || ring,
 'alias:express:' || base, 'alias:corridor:c') END AS aliases, regexp_extract(key, '^([东南西北]?[{_D}]+环)[东南西北中]?路?$', 1) AS ring_family FROM parts""",
)
def road_aliases_travelled(spark, sf_dir):
    uses = lattice.trip_edges(spark, sf_dir).groupBy("road_uid").agg(F.count("*").alias("uses"))
    features = op.road_features(lattice.road_edges(spark)).join(uses, "road_uid")
    key = F.col("road_group_key")
    family = names.corridor_family(key)
    return features.select(
        "road_uid",
        "uses",
        joined(names.alias_tokens(key, F.col("highway_class"), F.lit("c"))).alias("aliases"),
        F.when(names.is_ring(key), family).when(key.isNotNull(), F.lit("")).alias("ring_family"),
    )


# --- table maintenance -------------------------------------------------------


@query(
    "merge_spatial_index",
    with_(POINTS, NUMBERED)
    + """ SELECT taxi_id, trip_id, grid_x, grid_y, min(gps_time) AS first_seen_time, max(gps_time) AS last_seen_time,
 min(point_seq)::INT AS first_point_seq, count(*)::INT AS point_count FROM numbered GROUP BY ALL""",
)
def merge_spatial_index(spark, sf_dir):
    """Upsert of an index built from early points with one built from all points."""
    grid = lattice.grid_points(spark, sf_dir)
    whole = trip_spatial_index(grid).drop("grid_key")
    early = trip_spatial_index(grid.filter("point_seq <= 20")).drop("grid_key")
    rules = {"first_seen_time": "min", "last_seen_time": "max", "first_point_seq": "min", "point_count": "new"}
    return tables.merge_rows(early, whole, ["taxi_id", "trip_id", "grid_x", "grid_y"], rules)


@query(
    "resume_not_done",
    with_(TRIPS) + " SELECT taxi_id, trip_id FROM trips WHERE start_s >= 302400",
)
def resume_not_done(spark, sf_dir):
    """Trips still to build when the first half of the week is already in the target."""
    od = lattice.trip_od(spark, sf_dir)
    done = od.filter("start_time < TIMESTAMP_NTZ '2008-02-05 12:00:00'")
    return tables.not_done(od, done, ["taxi_id", "trip_id"]).select("taxi_id", "trip_id")


@query(
    "insert_keep_first",
    with_(TRIPS) + " SELECT taxi_id, trip_id, CASE WHEN start_s < 302400 THEN 'old' ELSE 'new' END AS origin FROM trips",
)
def insert_keep_first(spark, sf_dir):
    od = lattice.trip_od(spark, sf_dir).select("taxi_id", "trip_id", "start_time")
    old = od.filter("start_time < TIMESTAMP_NTZ '2008-02-05 12:00:00'").select("taxi_id", "trip_id", F.lit("old").alias("origin"))
    return tables.keep_first(old, od.select("taxi_id", "trip_id", F.lit("new").alias("origin")), ["taxi_id", "trip_id"])


@query(
    "build_audit",
    with_(*FACTS)
    + """ SELECT 'road_passes' AS pipeline_name, 'ready' AS status,
 '{"rows":' || count(*) || ',"trips":' || count(DISTINCT trip_id) || '}' AS details FROM passes""",
)
def build_audit(spark, sf_dir):
    passes = lattice.passes(spark, sf_dir).select("trip_id")
    return tables.audit_record(passes, "road_passes", "ready", trips=F.count_distinct("trip_id"))


@query(
    "normalised_roads_travelled",
    with_(EDGES, ROADS)
    + """ SELECT CASE WHEN lower(coalesce(oneway, '')) IN ('yes', '1', 'true', 't') THEN 'forward' WHEN lower(coalesce(oneway, '')) IN ('-1', 'reverse', 'backward')
 THEN 'reverse' ELSE 'both' END AS travel, count(*) AS passes, count(DISTINCT road_uid) AS segments, round(max(greatest(lon0, lon1)), 6) AS max_lon
 FROM edges JOIN roads ON road_uid = edge_uid GROUP BY 1""",
)
def normalised_roads_travelled(spark, sf_dir):
    roads = tables.normalise_roads(lattice.road_edges(spark)).select(F.col("edge_uid").alias("road_uid"), "travel", "max_lon")
    uses = lattice.trip_edges(spark, sf_dir).groupBy("road_uid").agg(F.count("*").alias("n"))
    return uses.join(roads, "road_uid").groupBy("travel").agg(
        F.sum("n").alias("passes"), F.count("*").alias("segments"), F.round(F.max("max_lon"), 6).alias("max_lon")
    )
