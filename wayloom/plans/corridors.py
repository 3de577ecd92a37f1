"""Frequent corridor queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from wayloom.operators import corridors as op
from wayloom.plans.registry import query
from wayloom.plans.roads import FACTS, GROUP_HOURLY, HOURLY
from wayloom.plans.shape import END, START, joined, rounded
from wayloom.plans.sqltext import with_
from wayloom.sources import lattice
from wayloom.sources.lattice import WHOLE

SHORT_START, SHORT_END = datetime(2008, 2, 4, 6), datetime(2008, 2, 4, 12)
SHORT = "start_time <= TIMESTAMP '2008-02-04 12:00:00' AND end_time >= TIMESTAMP '2008-02-04 06:00:00'"
BAND = "hour_bucket BETWEEN TIMESTAMP '2008-02-03 08:00:00' AND TIMESTAMP '2008-02-06 20:00:00'"
BAND_START, BAND_END = datetime(2008, 2, 3, 8, 20), datetime(2008, 2, 6, 20, 45)

EXACT = f"""hit AS (SELECT * FROM passes WHERE {SHORT}),
stats AS (SELECT road_uid, direction, count(DISTINCT trip_id) AS trip_count, count(DISTINCT taxi_id) AS vehicle_count, count(*) AS edge_pass_weight
  FROM hit GROUP BY ALL),
keyed AS (SELECT s.*, f.road_group_key, f.highway, f.segment_length_m,
  lower(coalesce(oneway, '')) IN ('yes', 'true', '1', 't', '-1', 'reverse', 'backward') AS has_oneway_segment FROM stats s JOIN featured f USING (road_uid))"""
ROLLED = f"""stats AS (SELECT road_uid, direction, sum(trip_count)::BIGINT AS trip_count, sum(vehicle_count)::BIGINT AS vehicle_count,
  sum(trip_count)::BIGINT AS edge_pass_weight FROM hourly WHERE {BAND} GROUP BY ALL),
keyed AS (SELECT s.*, f.road_group_key, f.highway, f.segment_length_m,
  lower(coalesce(oneway, '')) IN ('yes', 'true', '1', 't', '-1', 'reverse', 'backward') AS has_oneway_segment FROM stats s JOIN featured f USING (road_uid))"""
STAT_ROWS = """ SELECT road_uid, direction::SMALLINT AS direction, road_group_key, highway, has_oneway_segment, trip_count, vehicle_count, edge_pass_weight,
 round(segment_length_m, 3) AS length_m FROM keyed"""


def _flat_stats(stats):
    return stats.select(
        "road_uid",
        "direction",
        "road_group_key",
        "highway",
        "has_oneway_segment",
        "trip_count",
        "vehicle_count",
        "edge_pass_weight",
        F.round("matched_segment_length_m", 3).alias("length_m"),
    )


@query("corridor_edges_exact", with_(*FACTS, EXACT) + STAT_ROWS)
def corridor_edges_exact(spark, sf_dir):
    keyed = op.keyed_roads(lattice.road_edges(spark), WHOLE)
    return _flat_stats(op.exact_edge_stats(lattice.passes(spark, sf_dir), keyed, SHORT_START, SHORT_END))


@query("corridor_edges_rollup", with_(*FACTS, HOURLY, ROLLED) + STAT_ROWS)
def corridor_edges_rollup(spark, sf_dir):
    keyed = op.keyed_roads(lattice.road_edges(spark), WHOLE)
    return _flat_stats(op.rollup_edge_stats(lattice.hourly_roads(spark, sf_dir), keyed, BAND_START, BAND_END))


CANDIDATES = f"""flows AS (SELECT road_group_key, direction, sum(trip_count)::BIGINT AS trip_count, sum(vehicle_count)::BIGINT AS vehicle_count,
  sum(edge_pass_weight)::BIGINT AS edge_pass_weight FROM group_hourly WHERE {BAND} GROUP BY ALL),
lens AS (SELECT road_group_key, string_agg(DISTINCT highway, ', ' ORDER BY highway) AS highway, bool_or(lower(coalesce(oneway, '')) IN ('yes', 'true', '1', 't', '-1', 'reverse', 'backward')) AS has_oneway_segment,
  count(DISTINCT road_uid) AS segment_count, sum(DISTINCT segment_length_m) AS matched_segment_length_m, sum(segment_length_m) AS group_length_m
  FROM featured GROUP BY road_group_key HAVING sum(segment_length_m) >= 300),
cand AS (SELECT * FROM flows JOIN lens USING (road_group_key)),
fam AS (SELECT *, coalesce(nullif(regexp_extract(trim(road_group_key), '^([东南西北]?[一二三四五六七八九十]+环)[东南西北中]?路?$', 1), ''), trim(road_group_key)) AS family FROM cand)"""


def _candidates(spark, sf_dir):
    keyed = op.keyed_roads(lattice.road_edges(spark), WHOLE)
    return op.group_candidates(lattice.hourly_groups(spark, sf_dir), keyed, BAND_START, BAND_END, 300)


@query(
    "corridor_candidates",
    with_(*FACTS, GROUP_HOURLY, CANDIDATES)
    + """ SELECT road_group_key, direction::SMALLINT AS direction, trip_count, vehicle_count, edge_pass_weight, highway, has_oneway_segment, segment_count,
 round(matched_segment_length_m, 3) AS matched_segment_length_m, round(group_length_m, 3) AS group_length_m FROM cand""",
)
def corridor_candidates(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir), 3)


@query(
    "corridor_candidates_by_length",
    with_(*FACTS, GROUP_HOURLY, CANDIDATES)
    + """ SELECT road_group_key, direction::SMALLINT AS direction, trip_count, round(group_length_m, 3) AS group_length_m,
 row_number() OVER (PARTITION BY family, direction ORDER BY trip_count * greatest(group_length_m, 1.0) DESC, trip_count DESC, edge_pass_weight DESC, group_length_m DESC, road_group_key)::INT AS family_rank FROM fam""",
)
def corridor_candidates_by_length(spark, sf_dir):
    rows = op.corridor_families(_candidates(spark, sf_dir), "length_weighted")
    return rounded(rows.select("road_group_key", "direction", "trip_count", "group_length_m", "family_rank"), 3)


@query(
    "corridor_families",
    with_(*FACTS, GROUP_HOURLY, CANDIDATES)
    + """ SELECT family AS road_group_key, direction::SMALLINT AS direction, sum(segment_count)::BIGINT AS segment_count, sum(trip_count)::BIGINT AS trip_count,
 sum(vehicle_count)::BIGINT AS vehicle_count, sum(edge_pass_weight)::BIGINT AS edge_pass_weight, round(sum(group_length_m), 3) AS group_length_m,
 bool_or(has_oneway_segment) AS has_oneway_segment FROM fam GROUP BY family, direction""",
)
def corridor_families(spark, sf_dir):
    totals = op.family_totals(op.corridor_families(_candidates(spark, sf_dir)))
    return rounded(totals.drop("highway", "matched_segment_length_m", "road_name"), 3)


# Every lattice road is a straight line: its parts are runs of neighbouring segments, and
# the backbone of a run is the whole run.
RUNS = """placed AS (SELECT *, CASE WHEN road_uid % 2 = 0 THEN (road_uid // 2) // 1000 ELSE (road_uid // 2) % 1000 END AS spot FROM keyed),
runs AS (SELECT *, spot - row_number() OVER (PARTITION BY road_group_key, direction ORDER BY spot) AS island FROM placed),
parts AS (SELECT road_group_key, direction, island, min(road_uid) AS first_uid, count(*) AS segment_count, sum(segment_length_m) AS len,
  sum(edge_pass_weight)::BIGINT AS w FROM runs GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY road_group_key, direction ORDER BY round(len, 6) DESC, first_uid) AS component_id,
  count(*) OVER (PARTITION BY road_group_key, direction) AS fragment_count FROM parts)"""


@query(
    "corridor_components",
    with_(*FACTS, EXACT, RUNS)
    + """ SELECT road_group_key, direction::SMALLINT AS direction, component_id::INT AS component_id, segment_count, fragment_count, w AS edge_pass_weight,
 round(len, 3) AS group_length_m, 0::BIGINT AS branch_count, segment_count AS backbone_segment_count, 1.0::DOUBLE AS corridor_confidence
 FROM numbered WHERE len >= 300""",
)
def corridor_components(spark, sf_dir):
    keyed = op.keyed_roads(lattice.road_edges(spark), WHOLE)
    stats = op.exact_edge_stats(lattice.passes(spark, sf_dir), keyed, SHORT_START, SHORT_END)
    rows = op.component_rows(op._built(stats), 300)
    return rounded(
        rows.select(
            "road_group_key",
            "direction",
            "component_id",
            "segment_count",
            "fragment_count",
            "edge_pass_weight",
            "group_length_m",
            "branch_count",
            "backbone_segment_count",
            "corridor_confidence",
        ),
        3,
    )


MERGED = """kept AS (SELECT * FROM numbered WHERE len >= 300),
members AS (SELECT r.road_group_key, r.direction, count(DISTINCT h.trip_id) AS trip_count, count(DISTINCT h.taxi_id) AS vehicle_count
  FROM hit h JOIN runs r ON h.road_uid = r.road_uid AND h.direction = r.direction JOIN kept k ON k.road_group_key = r.road_group_key AND k.direction = r.direction AND k.island = r.island GROUP BY ALL),
merged AS (SELECT road_group_key, direction, sum(segment_count)::BIGINT AS segment_count, sum(w)::BIGINT AS edge_pass_weight, sum(len) AS group_length_m, count(*) AS fragment_count FROM kept GROUP BY ALL),
scored AS (SELECT *, (trip_count + edge_pass_weight * 0.18::DOUBLE) * greatest(0.45::DOUBLE, 1.0 - (fragment_count - 1) * 0.14::DOUBLE) AS score FROM merged JOIN members USING (road_group_key, direction)),
top AS (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, trip_count DESC, edge_pass_weight DESC, group_length_m DESC, road_group_key, direction) AS rank FROM scored)"""


@query(
    "corridors_exact",
    with_(*FACTS, EXACT, RUNS, MERGED)
    + """ SELECT rank::INT AS rank, road_group_key, direction::SMALLINT AS direction, CASE WHEN direction > 0 THEN 'forward' ELSE 'reverse' END AS direction_label,
 trip_count, vehicle_count, edge_pass_weight, segment_count, round(group_length_m, 3) AS group_length_m, fragment_count, round(score, 3) AS continuity,
 (SELECT sum(trip_count) FROM scored)::BIGINT AS total_ranked_trip_count, (SELECT count(*) FROM scored) AS total_path_count FROM top WHERE rank <= 50""",
)
def corridors_exact(spark, sf_dir):
    found = op.corridors_exact(lattice.passes(spark, sf_dir), lattice.road_edges(spark), SHORT_START, SHORT_END, 50, 300, box=WHOLE)
    return rounded(
        found.select(
            "rank",
            "road_group_key",
            "direction",
            "direction_label",
            "trip_count",
            "vehicle_count",
            "edge_pass_weight",
            "segment_count",
            "group_length_m",
            "fragment_count",
            "continuity",
            "total_ranked_trip_count",
            "total_path_count",
        ),
        3,
    )


@query(
    "corridors_exact_summary",
    with_(*FACTS, EXACT, RUNS, MERGED)
    + """ SELECT count(*) AS path_count, (SELECT count(*) FROM scored) AS total_path_count_before_top_k, sum(trip_count)::BIGINT AS top_k_trip_count,
 (SELECT sum(trip_count) FROM scored)::BIGINT AS total_ranked_trip_count, round(sum(trip_count) / (SELECT sum(trip_count) FROM scored), 6) AS top_k_ratio,
 max(trip_count) AS max_trip_count, max(vehicle_count) AS max_vehicle_count, sum(edge_pass_weight)::BIGINT AS top_k_edge_pass_weight FROM top WHERE rank <= 20""",
)
def corridors_exact_summary(spark, sf_dir):
    found = op.corridors_exact(lattice.passes(spark, sf_dir), lattice.road_edges(spark), SHORT_START, SHORT_END, 20, 300, box=WHOLE)
    return rounded(op.corridor_summary(found))


@query("corridors_hourly")
def corridors_hourly(spark, sf_dir):
    found = op.corridors_hourly(lattice.hourly_roads(spark, sf_dir), lattice.road_edges(spark), BAND_START, BAND_END, 50, box=WHOLE)
    return rounded(found.drop("backbones", "branches", "component_ids"), 3)


@query("corridors_rollup")
def corridors_rollup(spark, sf_dir):
    found = op.corridors_rollup(
        lattice.hourly_groups(spark, sf_dir), lattice.hourly_roads(spark, sf_dir), lattice.road_edges(spark), START, END, 50, box=WHOLE
    )
    return rounded(found.withColumn("component_ids", joined(F.col("component_ids"))).drop("backbones", "branches"), 3)


@query(
    "corridors_from_edges",
    with_(
        *FACTS,
        """glen AS (SELECT road_group_key, sum(segment_length_m) AS group_length_m FROM featured GROUP BY 1 HAVING sum(segment_length_m) >= 2000),
elig AS (SELECT f.*, group_length_m FROM featured f JOIN glen USING (road_group_key)),
tr AS (SELECT DISTINCT taxi_id, trip_id, start_time FROM od JOIN edges USING (taxi_id, trip_id) WHERE road_uid IN (SELECT road_uid FROM elig)),
segs AS (SELECT DISTINCT taxi_id, trip_id, direction, elig.* FROM edges JOIN tr USING (taxi_id, trip_id) JOIN elig USING (road_uid)),
flows AS (SELECT road_group_key, direction, count(DISTINCT trip_id) AS trip_count, count(DISTINCT taxi_id) AS vehicle_count FROM segs GROUP BY ALL),
uniq AS (SELECT DISTINCT road_group_key, direction, road_uid, highway, segment_length_m, group_length_m FROM segs),
grp AS (SELECT road_group_key, direction, string_agg(DISTINCT highway, ', ' ORDER BY highway) AS highway, count(*) AS segment_count, sum(segment_length_m) AS matched_segment_length_m, max(group_length_m) AS group_length_m FROM uniq GROUP BY ALL)""",
    )
    + """ SELECT road_group_key, direction::SMALLINT AS direction, highway, segment_count, round(matched_segment_length_m, 3) AS matched_segment_length_m, round(group_length_m, 3) AS group_length_m,
 trip_count, vehicle_count, (SELECT sum(trip_count) FROM flows)::BIGINT AS total_ranked_trip_count, (SELECT count(*) FROM flows) AS total_path_count
 FROM grp JOIN flows USING (road_group_key, direction) ORDER BY trip_count DESC, vehicle_count DESC, grp.group_length_m DESC, road_group_key, direction LIMIT 50""",
)
def corridors_from_edges(spark, sf_dir):
    found = op.corridors_from_edges(
        lattice.trip_edges(spark, sf_dir), lattice.trip_od(spark, sf_dir), lattice.road_edges(spark), START, END, 50, 2000, box=WHOLE
    )
    return rounded(found.drop("has_oneway_segment"), 3)


DETAIL = """seg AS (SELECT c.*, f.id AS road_id, f.highway, f.measured_m AS length_m, (lon0 + lon1) / 2 AS cx, (lat0 + lat1) / 2 AS cy FROM counts c JOIN featured f USING (road_uid) WHERE f.road_group_key = '{key}')
SELECT '{key}' AS road_group_key, road_uid, road_id, highway, round(length_m, 3) AS length_m, trip_count, trip_count AS edge_pass_weight, vehicle_count,
 row_number() OVER (ORDER BY trip_count DESC, round(length_m, 6) DESC, road_uid)::INT AS flow_rank, row_number() OVER (ORDER BY {axis}, road_uid)::INT AS profile_order,
 count(*) OVER () AS total_segment_count, (sum(trip_count) OVER ())::BIGINT AS total_trip_count, max(trip_count) OVER () AS max_trip_count FROM seg"""


def _flat_detail(found):
    return rounded(found.drop("coords", "total_edge_pass_weight", "max_edge_pass_weight"), 3)


@query(
    "road_detail_exact",
    with_(*FACTS, f"counts AS (SELECT road_uid, count(*) AS trip_count, NULL::BIGINT AS vehicle_count FROM passes WHERE direction = -1 AND {SHORT} GROUP BY 1)")
    + ", "
    + DETAIL.format(key="G31高速", axis="round(-cx, 9)"),
)
def road_detail_exact(spark, sf_dir):
    counts = op.detail_counts_exact(lattice.passes(spark, sf_dir), "G31高速", -1, SHORT_START, SHORT_END)
    return _flat_detail(op.road_detail(counts, lattice.road_edges(spark), "G31高速", -1, WHOLE, component_id=1))


@query(
    "road_detail_rollup",
    with_(*FACTS, HOURLY, f"counts AS (SELECT road_uid, sum(trip_count)::BIGINT AS trip_count, max(vehicle_count) AS vehicle_count FROM hourly WHERE direction = 1 AND {BAND} GROUP BY 1)")
    + ", "
    + DETAIL.format(key="col5", axis="round(cy, 9)"),
)
def road_detail_rollup(spark, sf_dir):
    counts = op.detail_counts_rollup(lattice.hourly_roads(spark, sf_dir), 1, BAND_START, BAND_END)
    return _flat_detail(op.road_detail(counts, lattice.road_edges(spark), "col5", 1, WHOLE))


@query(
    "road_parts_travelled",
    with_(*FACTS, EXACT, RUNS.replace("PARTITION BY road_group_key, direction", "PARTITION BY road_group_key").replace("FROM keyed)", "FROM (SELECT DISTINCT ON (road_uid) * FROM keyed))").replace("SELECT road_group_key, direction, island", "SELECT road_group_key, island"))
    + " SELECT road_group_key, count(*) AS parts, sum(segment_count)::BIGINT AS segments FROM parts GROUP BY 1",
)
def road_parts_travelled(spark, sf_dir):
    """Spatial parts of every road among the segments travelled in a window."""
    hit = op.overlapping(lattice.passes(spark, sf_dir), SHORT_START, SHORT_END).select("road_uid").distinct()
    segments = op.keyed_roads(lattice.road_edges(spark)).join(hit, "road_uid", "left_semi")
    parts = op.near_components(segments.select("road_group_key", "road_uid", "coords"))
    return parts.groupBy("road_group_key").agg(F.max("component_id").cast("long").alias("parts"), F.count("*").alias("segments"))
