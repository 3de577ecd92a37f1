"""Frequent A→B route queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators import routes as op
from wayloom.plans.registry import query
from wayloom.plans.roads import ALIASES, NAMED, TOKENS
from wayloom.plans.shape import END, END_SQL, START, START_SQL, joined, rounded
from wayloom.plans.sqltext import EDGES, POINTS, ROADS, inside, with_
from wayloom.plans.trips import NUMBERED, OD
from wayloom.session import counted, cut_lineage, kept
from wayloom.sources import lattice
from wayloom.sources.lattice import AREA_A, AREA_B

ALL_DAY = op.RouteQuery(START, END, AREA_A, AREA_B)
EVENING = op.RouteQuery(START, END, AREA_A, AREA_B, hours=(22, 23, 0, 1), minutes=(1350, 75))
STRICT = op.RouteQuery(START, END, AREA_A, AREA_B, mode="strict_od")


def _keys(box: geo.Box) -> str:
    return "(" + ", ".join(f"'{k}'" for k in geo.box_cell_keys(box, 0.01)) + ")"


def _tables(spark, sf_dir):
    return (
        lattice.trip_od(spark, sf_dir),
        lattice.spatial_index(spark, sf_dir),
        lattice.grid_points(spark, sf_dir),
        lattice.trip_edges(spark, sf_dir),
    )


WINDOW = f"""tw AS (SELECT taxi_id, trip_id, start_time, end_time, start_lon, start_lat, end_lon, end_lat, duration_seconds FROM od
  WHERE start_time >= {START_SQL} AND end_time <= {END_SQL} AND duration_seconds > 0 {{hours}})"""
A_KEYS, B_KEYS = _keys(ALL_DAY.a), _keys(ALL_DAY.b)
HITS = f"""keyed_points AS (SELECT *, grid_x || ':' || grid_y AS grid_key FROM numbered),
si AS (SELECT taxi_id, trip_id, grid_key, min(point_seq) AS first_point_seq FROM keyed_points GROUP BY ALL),
ah AS (SELECT taxi_id, trip_id, min(first_point_seq) AS a_seq FROM si JOIN tw USING (taxi_id, trip_id) WHERE grid_key IN {A_KEYS} GROUP BY ALL),
gh AS (SELECT DISTINCT taxi_id, trip_id FROM si JOIN ah USING (taxi_id, trip_id) WHERE grid_key IN {B_KEYS} AND first_point_seq > a_seq),
pa AS (SELECT taxi_id, trip_id, min(point_seq) AS a1, min(gps_time) AS t1 FROM keyed_points JOIN gh USING (taxi_id, trip_id) WHERE grid_key IN {A_KEYS} AND {inside(ALL_DAY.a)} GROUP BY ALL),
pb AS (SELECT taxi_id, trip_id, min(point_seq) AS b_seq, min(gps_time) AS b_enter_time FROM keyed_points JOIN pa USING (taxi_id, trip_id)
  WHERE grid_key IN {B_KEYS} AND {inside(ALL_DAY.b)} AND point_seq > a1 AND gps_time > t1 GROUP BY ALL),
fa AS (SELECT taxi_id, trip_id, b_enter_time, max(gps_time) AS a_enter_time FROM keyed_points JOIN pb USING (taxi_id, trip_id)
  WHERE grid_key IN {A_KEYS} AND {inside(ALL_DAY.a)} AND point_seq < b_seq AND gps_time < b_enter_time GROUP BY ALL),
precise AS (SELECT taxi_id, trip_id, a_enter_time, b_enter_time, epoch_us(b_enter_time - a_enter_time) / 1e6 AS duration_seconds FROM fa)"""
LATE = """late AS (SELECT * FROM precise WHERE hour(a_enter_time) IN (22, 23, 0, 1)
  AND (hour(a_enter_time) * 60 + minute(a_enter_time) >= 1350 OR hour(a_enter_time) * 60 + minute(a_enter_time) <= 75))"""
HOURS = "AND hour(start_time) IN (21, 22, 23, 0, 1)"
CANDIDATE_ROWS = " SELECT taxi_id, trip_id, a_enter_time, b_enter_time, duration_seconds FROM "


@query("route_candidates", with_(POINTS, NUMBERED, OD, WINDOW.format(hours=""), HITS) + CANDIDATE_ROWS + "precise")
def route_candidates(spark, sf_dir):
    chosen, _ = op.candidates(*_tables(spark, sf_dir), ALL_DAY)
    return chosen.drop("start_time")


@query("route_candidates_evening", with_(POINTS, NUMBERED, OD, WINDOW.format(hours=HOURS), HITS, LATE) + CANDIDATE_ROWS + "late")
def route_candidates_evening(spark, sf_dir):
    chosen, _ = op.candidates(*_tables(spark, sf_dir), EVENING)
    return chosen.drop("start_time")


@query(
    "route_candidates_strict",
    with_(POINTS, OD, WINDOW.format(hours=""))
    + f""" SELECT taxi_id, trip_id, start_time AS a_enter_time, end_time AS b_enter_time, duration_seconds FROM tw
 WHERE {inside(STRICT.a, "start_lon", "start_lat")} AND {inside(STRICT.b, "end_lon", "end_lat")}""",
)
def route_candidates_strict(spark, sf_dir):
    chosen, _ = op.candidates(*_tables(spark, sf_dir), STRICT)
    return chosen.drop("start_time")


@query(
    "route_candidates_unindexed",
    with_(
        POINTS,
        OD,
        WINDOW.format(hours=""),
        f"""a AS (SELECT taxi_id, trip_id, min(gps_time) AS a_enter_time FROM points WHERE {inside(ALL_DAY.a)} GROUP BY ALL),
b AS (SELECT taxi_id, trip_id, a_enter_time, min(gps_time) AS b_enter_time FROM points JOIN a USING (taxi_id, trip_id) WHERE {inside(ALL_DAY.b)} AND gps_time > a_enter_time GROUP BY ALL)""",
    )
    + " SELECT taxi_id, trip_id, a_enter_time, b_enter_time, epoch_us(b_enter_time - a_enter_time) / 1e6 AS duration_seconds FROM b JOIN tw USING (taxi_id, trip_id)",
)
def route_candidates_unindexed(spark, sf_dir):
    found = op.unindexed_times(lattice.taxi_points(spark, sf_dir), lattice.trip_od(spark, sf_dir), ALL_DAY)
    return found.drop("start_time")


@query(
    "route_stage_counts",
    with_(POINTS, NUMBERED, OD, WINDOW.format(hours=HOURS), HITS, LATE)
    + """ SELECT 'window' AS stage, count(*) AS trips FROM tw UNION ALL SELECT 'grid', count(*) FROM gh UNION ALL SELECT 'precise', count(*) FROM precise
 UNION ALL SELECT 'departure', count(*) FROM late UNION ALL SELECT 'matched', count(*) FROM late""",
)
def route_stage_counts(spark, sf_dir):
    _, stages = op.candidates(*_tables(spark, sf_dir), EVENING)
    return op.stage_counts(stages)


def _meets(box: geo.Box) -> str:
    # Lattice segments run along one axis, so the overlap of their boxes is exact.
    return (
        f"(greatest(lon0, lon1) >= {box.min_lon!r}::DOUBLE AND least(lon0, lon1) <= {box.max_lon!r}::DOUBLE AND "
        f"greatest(lat0, lat1) >= {box.min_lat!r}::DOUBLE AND least(lat0, lat1) <= {box.max_lat!r}::DOUBLE)"
    )


SLICED = f"""flagged AS (SELECT e.*, t.token, t.segment_length_m, {_meets(ALL_DAY.a)} AS in_a, {_meets(ALL_DAY.b)} AS in_b FROM edges e JOIN tokened t USING (road_uid) JOIN precise USING (taxi_id, trip_id)),
a0 AS (SELECT taxi_id, trip_id, min(edge_seq) AS a0 FROM flagged WHERE in_a GROUP BY ALL),
b0 AS (SELECT taxi_id, trip_id, min(edge_seq) AS b_seq FROM flagged JOIN a0 USING (taxi_id, trip_id) WHERE in_b AND edge_seq > a0 GROUP BY ALL),
ab AS (SELECT taxi_id, trip_id, b_seq, max(edge_seq) AS a_seq FROM flagged JOIN b0 USING (taxi_id, trip_id) WHERE in_a AND edge_seq < b_seq GROUP BY ALL),
cut AS (SELECT f.*, a_seq, b_seq FROM flagged f JOIN ab USING (taxi_id, trip_id) WHERE edge_seq BETWEEN a_seq AND b_seq),
named AS (SELECT taxi_id, trip_id, a_seq, b_seq, count(*) AS n, sum(segment_length_m) AS route_length_m, count(DISTINCT token) AS road_tokens FROM cut GROUP BY ALL)"""


@query(
    "route_subpaths",
    with_(POINTS, NUMBERED, OD, WINDOW.format(hours=""), HITS, EDGES.replace(EDGES[: EDGES.index("steps AS")], ""), ROADS, NAMED, TOKENS, SLICED)
    + """ SELECT taxi_id, trip_id, a_seq::INT AS a_seq, b_seq::INT AS b_seq, n::INT AS raw_edge_count, round(route_length_m, 3) AS route_length_m,
 road_tokens FROM named WHERE route_length_m >= 500 AND road_tokens > 0""",
)
def route_subpaths(spark, sf_dir):
    chosen, _ = op.candidates(*_tables(spark, sf_dir), ALL_DAY)
    edges, roads = lattice.trip_edges(spark, sf_dir), lattice.road_edges(spark)
    trips = op.sampled_trips(kept(chosen), edges, counted(op.route_features(roads, ALL_DAY)), ALL_DAY)
    own = F.array_distinct(F.filter("sequence_tokens", lambda t: t.rlike("^(road|edge):")))
    return rounded(
        trips.select(
            "taxi_id", "trip_id", "a_seq", "b_seq", "raw_edge_count", "route_length_m", F.size(own).cast("long").alias("road_tokens")
        ),
        3,
    )


def _sampled(spark, sf_dir):
    chosen, _ = op.candidates(*_tables(spark, sf_dir), ALL_DAY)
    edges, roads = lattice.trip_edges(spark, sf_dir), lattice.road_edges(spark)
    trips = kept(op.sampled_trips(kept(chosen), edges, counted(op.route_features(roads, ALL_DAY)), ALL_DAY))
    return kept(op.drop_stop_tokens(op.drop_slow(trips, 3)))


def _grid(step: float) -> str:
    """Cell of the centre of a segment; half-way values go to the even neighbour."""

    def axis(low: str, high: str) -> str:
        return f"round_even(round_even((least({low}, {high}) + greatest({low}, {high})) / 2.0 / {step!r}::DOUBLE, 0) * {step!r}::DOUBLE, 3)"

    return f"'grid:' || {axis('lon0', 'lon1')} || ':' || {axis('lat0', 'lat1')}"


FROM_WALK = EDGES.replace(EDGES[: EDGES.index("steps AS")], "")
VECTORS = (
    ALIASES
    + f""",
spoken AS (SELECT road_uid, unnest(list_concat([t.token, {_grid(0.01)}], CASE WHEN starts_with(t.token, 'road:') THEN list_concat(['alias:' || {_grid(0.01)}],
    list_filter(['alias:route:' || code, 'alias:route:' || known, 'alias:ring:' || ring, 'alias:express:' || base, 'alias:corridor:' || {_grid(0.02)}], lambda x: x IS NOT NULL)) ELSE [] END)) AS word
  FROM tokened t JOIN aliased USING (road_uid) WHERE t.token IS NOT NULL),
usable AS (SELECT n.*, p.duration_seconds, row_number() OVER (ORDER BY o.start_time, n.taxi_id, n.trip_id) AS trip_index FROM named n JOIN precise p USING (taxi_id, trip_id) JOIN od o USING (taxi_id, trip_id)
  WHERE route_length_m >= 500 AND road_tokens > 0),
limits AS (SELECT greatest(3 * quantile_cont(duration_seconds, 0.5) FILTER (WHERE duration_seconds > 0), 1800) AS cutoff, count(*) AS total FROM usable),
fast AS (SELECT usable.* FROM usable, limits WHERE NOT (total >= 20 AND (SELECT count(*) FROM usable, limits WHERE duration_seconds > 0 AND duration_seconds <= cutoff) >= 3)
  OR (duration_seconds > 0 AND duration_seconds <= cutoff)),
words AS (SELECT DISTINCT trip_index, word FROM fast JOIN cut USING (taxi_id, trip_id) JOIN spoken USING (road_uid)),
rare AS (SELECT word FROM words GROUP BY word HAVING count(*) <= (SELECT greatest(2, ceil(count(*) * 0.9::DOUBLE)) FROM fast)),
token_sets AS MATERIALIZED (SELECT trip_index, CASE WHEN len(k) > 0 THEN k ELSE e END AS tokens FROM (SELECT trip_index, list_sort(coalesce(list(word) FILTER (WHERE word IN (SELECT word FROM rare)), [])) AS k, list_sort(list(word)) AS e
  FROM words GROUP BY 1)),
sets AS MATERIALIZED (SELECT tokens, count(*) AS trips, min(trip_index) AS set_id FROM token_sets GROUP BY tokens)"""
)
SETS = with_(POINTS, NUMBERED, OD, WINDOW.format(hours=""), HITS, FROM_WALK, ROADS, NAMED, TOKENS, SLICED, VECTORS)
JACCARD = "len(list_intersect(a.tokens, b.tokens))::DOUBLE / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)))"


@query("route_token_sets", SETS + " SELECT set_id, trips, len(tokens)::INT AS size, array_to_string(tokens, ',') AS tokens FROM sets")
def route_token_sets(spark, sf_dir):
    sets = op.token_sets(_sampled(spark, sf_dir))
    return sets.select("set_id", "trips", F.size("token_set").alias("size"), joined(F.col("token_set")).alias("tokens"))


@query(
    "route_similar_sets",
    SETS + f" SELECT * FROM (SELECT a.set_id AS src, b.set_id AS dst, round({JACCARD}, 6) AS similarity FROM sets a JOIN sets b ON a.set_id < b.set_id) WHERE similarity >= 0.42",
)
def route_similar_sets(spark, sf_dir):
    return rounded(op.similar_sets(op.token_sets(_sampled(spark, sf_dir))))


LADDER = f""",
pairs AS MATERIALIZED (SELECT a.set_id AS src, b.set_id AS dst, {JACCARD} AS s FROM sets a JOIN sets b ON a.set_id < b.set_id AND {JACCARD} >= 0.42),
links AS (SELECT level, src, dst FROM pairs, (VALUES (0, 0.78::DOUBLE), (1, 0.70), (2, 0.62), (3, 0.55), (4, 0.48), (5, 0.42)) t(level, least) WHERE s >= least),
both_ways AS MATERIALIZED (SELECT level, src, dst FROM links UNION ALL SELECT level, dst, src FROM links),
reach AS (SELECT level, set_id AS v, set_id AS u FROM sets, range(6) t(level) UNION SELECT reach.level, v, dst FROM reach JOIN both_ways b ON b.level = reach.level AND b.src = reach.u),
ladder AS MATERIALIZED (SELECT level, v AS set_id, min(u) AS cluster FROM reach GROUP BY ALL)"""


@query(
    "route_threshold_ladder",
    SETS.replace("WITH", "WITH RECURSIVE", 1) + LADDER + " SELECT level::INT AS level, cluster, count(*) AS sets, sum(trips)::BIGINT AS trips FROM ladder JOIN sets USING (set_id) GROUP BY ALL",
)
def route_threshold_ladder(spark, sf_dir):
    """Clusters of token sets at every threshold."""
    sets = cut_lineage(op.token_sets(_sampled(spark, sf_dir)))
    labels = op.ladder_labels(sets, op.similar_sets(sets))
    return labels.groupBy("level", "cluster").agg(F.count("*").alias("sets"), F.sum("trips").alias("trips"))


def _answer(spark, sf_dir, q=ALL_DAY):
    od, index, grid, edges = _tables(spark, sf_dir)
    return op.frequent_routes(od, index, grid, edges, lattice.road_edges(spark), q)


ROUTE_COLUMNS = [
    "route_rank",
    "parent_cluster_id",
    "split_mode",
    "quality_tier",
    "trip_count",
    "vehicle_count",
    "share_of_candidates",
    "avg_duration_min",
    "p20_duration_min",
    "p50_duration_min",
    "p90_duration_min",
    "avg_route_length_m",
    "quality",
    "directness",
    "repeat_ratio",
    "representative",
    "signature",
    "similarity_threshold",
]


@query("frequent_routes")
def frequent_routes(spark, sf_dir):
    return rounded(_answer(spark, sf_dir)["routes"].select(*ROUTE_COLUMNS))


@query("frequent_routes_strict")
def frequent_routes_strict(spark, sf_dir):
    return rounded(_answer(spark, sf_dir, STRICT)["routes"].select(*ROUTE_COLUMNS))


@query("route_variants")
def route_variants(spark, sf_dir):
    return rounded(_answer(spark, sf_dir)["variants"])


@query("route_summary")
def route_summary(spark, sf_dir):
    return rounded(_answer(spark, sf_dir)["summary"])


@query("route_recommendations")
def route_recommendations(spark, sf_dir):
    """Best route under each strategy."""
    routes = _answer(spark, sf_dir)["routes"].select(*ROUTE_COLUMNS)
    parts = [op.recommend(routes, s) for s in op.STRATEGIES]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("route_sort_modes")
def route_sort_modes(spark, sf_dir):
    routes = _answer(spark, sf_dir)["routes"].select(*ROUTE_COLUMNS)
    parts = [
        op.sort_routes(routes, [*op.sort_mode(m), F.col("route_rank")]).select(F.lit(m).alias("mode"), "position", "route_rank")
        for m in ("frequency", "avg", "p50")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "strategy_over_road_hours",
    with_(
        POINTS,
        OD,
        """h AS (SELECT taxi_id, count(*) AS trip_count, round(avg(duration_seconds / 60.0), 6) AS avg_duration_min,
  round(quantile_cont(duration_seconds / 60.0, 0.5), 6) AS p50_duration_min, round(quantile_cont(duration_seconds / 60.0, 0.9), 6) AS p90_duration_min FROM od GROUP BY 1),
m AS (SELECT max(trip_count) AS mx FROM h),
f AS (SELECT *, 'fastest' AS strategy FROM h ORDER BY CASE WHEN p50_duration_min > 0 THEN p50_duration_min END NULLS LAST, trip_count DESC, taxi_id LIMIT 1),
s AS (SELECT *, 'stable' AS strategy FROM h ORDER BY CASE WHEN p90_duration_min > 0 THEN p90_duration_min END NULLS LAST, CASE WHEN p50_duration_min > 0 THEN p50_duration_min END NULLS LAST, taxi_id LIMIT 1),
q AS (SELECT h.*, 'frequent_fast' AS strategy FROM h, m ORDER BY round(trip_count / greatest(1, mx) * 1.35 - (least(p50_duration_min, 180) * 0.65 + least(avg_duration_min, 180) * 0.35) / 180.0, 9) DESC, taxi_id LIMIT 1)""",
    )
    + " SELECT * FROM f UNION ALL SELECT * FROM s UNION ALL SELECT * FROM q",
)
def strategy_over_road_hours(spark, sf_dir):
    """The recommendation rules applied to duration figures per vehicle."""
    od = lattice.trip_od(spark, sf_dir).withColumn("minutes", F.col("duration_seconds") / 60.0)
    figures = od.groupBy("taxi_id").agg(
        F.count("*").alias("trip_count"),
        F.round(F.avg("minutes"), 6).alias("avg_duration_min"),
        F.round(F.expr("percentile(minutes, 0.5)"), 6).alias("p50_duration_min"),
        F.round(F.expr("percentile(minutes, 0.9)"), 6).alias("p90_duration_min"),
    )
    parts = [op.recommend(figures, s, "taxi_id").drop("position") for s in op.STRATEGIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
