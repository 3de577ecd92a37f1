"""SQL building blocks of the checks: the lattice tables and distance formulas."""

from __future__ import annotations

from wayloom.functions.geo import EARTH_RADIUS_M, Box

TRIPS = """
trips AS (
  SELECT o_orderkey AS trip_id, 1 + o_custkey % 200 AS taxi_id,
         o_orderkey * 997 % 604800 AS start_s, 60 + 15 * (o_custkey % 5) AS pace_s,
         CASE WHEN o_orderkey % 3 = 0 THEN 5 + (o_orderkey // 3) % 3 ELSE o_orderkey * 7 % 40 END AS i0,
         CASE WHEN o_orderkey % 3 = 0 THEN 5 + (o_orderkey // 9) % 3 ELSE (o_orderkey * 13 + o_custkey) % 40 END AS j0,
         CASE WHEN o_orderkey % 3 = 0 THEN 30 + o_custkey % 3 ELSE o_custkey * 11 % 40 END AS i1,
         CASE WHEN o_orderkey % 3 = 0 THEN 30 + (o_custkey // 3) % 3 ELSE (o_custkey * 17 + o_orderkey) % 40 END AS j1,
         (o_orderkey // 3) % 4 < 3 AS across_first
  FROM orders
),
walk AS (
  SELECT taxi_id, trip_id, k, start_s + k * pace_s AS at_s,
         CASE WHEN across_first THEN i0 + sign(i1 - i0) * least(k, abs(i1 - i0))
              ELSE i0 + sign(i1 - i0) * greatest(k - abs(j1 - j0), 0) END AS i,
         CASE WHEN across_first THEN j0 + sign(j1 - j0) * greatest(k - abs(i1 - i0), 0)
              ELSE j0 + sign(j1 - j0) * least(k, abs(j1 - j0)) END AS j
  FROM (SELECT *, unnest(range(0, abs(i1 - i0) + abs(j1 - j0) + 1)) AS k FROM trips)
)"""

POINTS = TRIPS + """,
points AS (
  SELECT trip_id * 100 + k AS id, taxi_id, trip_id,
         TIMESTAMP '2008-02-02 00:00:00' + to_seconds(at_s) AS gps_time,
         (116200000 + i * 10000 + (trip_id * 31 + k * 17) % 401 - 200)::DOUBLE / 1e6 AS lon,
         (39800000 + j * 8000 + (trip_id * 29 + k * 13) % 401 - 200)::DOUBLE / 1e6 AS lat
  FROM walk
)"""

ROADS = """
grid AS (SELECT n // 40 AS i, n % 40 AS j FROM range(1600) t(n)),
roads AS (
  SELECT edge_uid + 1 AS id, edge_uid, u, v,
         CASE WHEN edge_uid % 11 <> 0 THEN CASE WHEN edge_uid % 2 = 0 THEN 850.0::DOUBLE ELSE 890.0::DOUBLE END END AS length,
         [NULL, 'yes', '-1', 'true', 'no'][mark % 5 + 1] AS oneway, name,
         CASE WHEN mark % 10 = 0 THEN 'motorway' WHEN mark % 5 = 0 THEN 'primary' ELSE 'residential' END AS highway,
         (116200000 + i * 10000)::DOUBLE / 1e6 AS lon0, (39800000 + j * 8000)::DOUBLE / 1e6 AS lat0,
         (116200000 + i2 * 10000)::DOUBLE / 1e6 AS lon1, (39800000 + j2 * 8000)::DOUBLE / 1e6 AS lat1
  FROM (
    SELECT 2 * (1000 * i + j) AS edge_uid, 1000 * i + j AS u, 1000 * i + j + 1000 AS v, j AS mark,
           i, j, i + 1 AS i2, j AS j2,
           CASE WHEN j % 7 = 3 THEN NULL WHEN j = 20 THEN '北四环路' WHEN j % 10 = 0 THEN 'G' || (j + 1) || '高速'
                WHEN j % 5 = 0 THEN 'Row ' || j || ' 辅路' ELSE 'row' || j END AS name
    FROM grid WHERE i < 39
    UNION ALL
    SELECT 2 * (1000 * i + j) + 1, 1000 * i + j, 1000 * i + j + 1, i, i, j, i, j + 1,
           CASE WHEN i % 7 = 3 THEN NULL WHEN i = 20 THEN '东四环路'
                WHEN i % 5 = 2 THEN 'Col ' || i || ' 西段' ELSE 'col' || i END
    FROM grid WHERE j < 39
  )
)"""

EDGES = TRIPS + """,
steps AS (
  SELECT taxi_id, trip_id, k + 1 AS edge_seq, i, j,
         lag(i) OVER w AS pi, lag(j) OVER w AS pj
  FROM walk WINDOW w AS (PARTITION BY taxi_id, trip_id ORDER BY k)
),
edges AS (
  SELECT taxi_id, trip_id, edge_seq,
         CASE WHEN i <> pi THEN 2 * (1000 * least(i, pi) + j) ELSE 2 * (1000 * i + least(j, pj)) + 1 END AS road_uid,
         CASE WHEN i > pi OR j > pj THEN 1 ELSE -1 END AS direction
  FROM steps WHERE pi IS NOT NULL
)"""


def with_(*parts: str) -> str:
    """``WITH`` clause from blocks, each block used once."""
    return "WITH " + ",\n".join(p.strip() for p in parts)


def haversine(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = EARTH_RADIUS_M) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2.0), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2.0), 2))"
    )
    return f"({2.0 * radius} * asin(sqrt(CASE WHEN {a} > 1.0 THEN 1.0 ELSE {a} END)))"


def planar(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    scale = f"(111320.0 * greatest(0.1, abs(cos(radians(({lat1} + {lat2}) / 2.0)))))"
    return f"sqrt(pow(({lon2} - {lon1}) * {scale}, 2) + pow(({lat2} - {lat1}) * 111320.0, 2))"


def inside(box: Box, lon: str = "lon", lat: str = "lat") -> str:
    return (
        f"({lon} BETWEEN {box.min_lon!r}::DOUBLE AND {box.max_lon!r}::DOUBLE "
        f"AND {lat} BETWEEN {box.min_lat!r}::DOUBLE AND {box.max_lat!r}::DOUBLE)"
    )


def near(box: Box, metres: float, lon: str = "lon", lat: str = "lat") -> str:
    nearest_lon = f"greatest({box.min_lon!r}::DOUBLE, least({box.max_lon!r}::DOUBLE, {lon}))"
    nearest_lat = f"greatest({box.min_lat!r}::DOUBLE, least({box.max_lat!r}::DOUBLE, {lat}))"
    return f"({inside(box.grown(metres), lon, lat)} AND {haversine(lon, lat, nearest_lon, nearest_lat)} <= {metres})"


def boxes_values(boxes: list[Box]) -> str:
    rows = ", ".join(
        f"({n}, {b.min_lon!r}::DOUBLE, {b.min_lat!r}::DOUBLE, {b.max_lon!r}::DOUBLE, {b.max_lat!r}::DOUBLE)"
        for n, b in enumerate(boxes)
    )
    return f"boxes AS (SELECT * FROM (VALUES {rows}) t(box_index, min_lon, min_lat, max_lon, max_lat))"
