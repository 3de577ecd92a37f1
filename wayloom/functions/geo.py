"""Geometry as Spark column expressions.

Points are (lon, lat) doubles in degrees, lines are ``array<struct<lon,lat>>``
and boxes are four doubles, so every test stays inside generated code and box
filters reach the parquet scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0
MERCATOR_HALF_M = 20037508.342789244
LINE = "array<struct<lon:double,lat:double>>"


@dataclass(frozen=True)
class Box:
    """Closed lon/lat rectangle."""

    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    def __post_init__(self) -> None:
        if self.min_lon >= self.max_lon or self.min_lat >= self.max_lat:
            raise ValueError("box needs min < max on both axes")

    def grown(self, metres: float) -> "Box":
        """The box widened on every side by a distance in metres."""
        if metres <= 0:
            return self
        cos_mid = abs(math.cos(math.radians((self.min_lat + self.max_lat) / 2.0)))
        d_lat = metres / 110540.0
        d_lon = metres / (111320.0 * max(0.01, cos_mid))
        return Box(self.min_lon - d_lon, self.min_lat - d_lat, self.max_lon + d_lon, self.max_lat + d_lat)

    def columns(self) -> tuple[Column, Column, Column, Column]:
        return F.lit(self.min_lon), F.lit(self.min_lat), F.lit(self.max_lon), F.lit(self.max_lat)


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def planar_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Flat-earth distance used by the cleaning rules."""
    scale = F.greatest(F.lit(0.1), F.abs(F.cos(F.radians((lat1 + lat2) / 2.0))))
    dx = (lon2 - lon1) * (F.lit(111320.0) * scale)
    dy = (lat2 - lat1) * F.lit(111320.0)
    return F.sqrt(dx * dx + dy * dy)


def _haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Squared half chord of the unit sphere; every coordinate term appears once."""
    across_lat = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), F.lit(2.0))
    across_lon = F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), F.lit(2.0))
    return across_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across_lon


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    # Rounding can push antipodes past one, where asin is not a number; nulls stay null.
    angle = F.nanvl(F.asin(F.sqrt(_haversine(lon1, lat1, lon2, lat2))), F.lit(math.pi / 2.0))
    return F.lit(2.0 * radius) * angle


def in_box(lon: Column, lat: Column, box: Box) -> Column:
    return lon.between(box.min_lon, box.max_lon) & lat.between(box.min_lat, box.max_lat)


def in_box_columns(lon: Column, lat: Column, prefix: str = "") -> Column:
    """Closed containment test against box columns of the same row."""
    return lon.between(F.col(prefix + "min_lon"), F.col(prefix + "max_lon")) & lat.between(
        F.col(prefix + "min_lat"), F.col(prefix + "max_lat")
    )


def near_box(lon: Column, lat: Column, box: Box, metres: float) -> Column:
    """Within a distance of a box: coarse rectangle, then the box itself, then exact.

    The exact test compares squared half chords, which needs no inverse sine, and only
    points in the narrow rim reach it. Small expressions also keep the generated method
    within what the JVM compiles.
    """
    nearest_lon = F.greatest(F.lit(box.min_lon), F.least(F.lit(box.max_lon), lon))
    nearest_lat = F.greatest(F.lit(box.min_lat), F.least(F.lit(box.max_lat), lat))
    limit = math.sin(metres / (2.0 * EARTH_RADIUS_M)) ** 2
    return in_box(lon, lat, box.grown(metres)) & (
        in_box(lon, lat, box) | (_haversine(lon, lat, nearest_lon, nearest_lat) <= limit)
    )


def box_centre(prefix: str) -> tuple[Column, Column]:
    return (
        (F.col(prefix + "min_lon") + F.col(prefix + "max_lon")) / 2.0,
        (F.col(prefix + "min_lat") + F.col(prefix + "max_lat")) / 2.0,
    )


def grow_box_columns(prefix: str, metres: Column) -> list[Column]:
    """Column form of :meth:`Box.grown` for boxes held in a table."""
    metres = F.greatest(metres, F.lit(0.0))
    _, mid_lat = box_centre(prefix)
    d_lat = metres / 110540.0
    d_lon = metres / (F.lit(111320.0) * F.greatest(F.lit(0.01), F.abs(F.cos(F.radians(mid_lat)))))
    return [
        (F.col(prefix + "min_lon") - d_lon).alias(prefix + "min_lon"),
        (F.col(prefix + "min_lat") - d_lat).alias(prefix + "min_lat"),
        (F.col(prefix + "max_lon") + d_lon).alias(prefix + "max_lon"),
        (F.col(prefix + "max_lat") + d_lat).alias(prefix + "max_lat"),
    ]


def mercator_x(lon: Column) -> Column:
    return lon * MERCATOR_HALF_M / 180.0


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan((lat + 90.0) * math.pi / 360.0)) * MERCATOR_HALF_M / math.pi


def mercator_lon(x: Column) -> Column:
    return x * 180.0 / MERCATOR_HALF_M


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y * math.pi / MERCATOR_HALF_M)))


def snap_box_to_mercator(box: Box, cell_m: float) -> Box:
    """Outward snap of a request box to the metric grid (request parameter, so plain floats)."""

    def x_of(lon: float) -> float:
        return lon * MERCATOR_HALF_M / 180.0

    def y_of(lat: float) -> float:
        return math.log(math.tan((lat + 90.0) * math.pi / 360.0)) * MERCATOR_HALF_M / math.pi

    def lat_of(y: float) -> float:
        return math.degrees(math.atan(math.sinh(y * math.pi / MERCATOR_HALF_M)))

    low_x, high_x = math.floor(x_of(box.min_lon) / cell_m) * cell_m, math.ceil(x_of(box.max_lon) / cell_m) * cell_m
    low_y, high_y = math.floor(y_of(box.min_lat) / cell_m) * cell_m, math.ceil(y_of(box.max_lat) / cell_m) * cell_m
    return Box(low_x * 180.0 / MERCATOR_HALF_M, lat_of(low_y), high_x * 180.0 / MERCATOR_HALF_M, lat_of(high_y))


def degree_cell(value: Column, step: float) -> Column:
    return F.floor(value / step).cast("int")


def degree_cell_key(lon: Column, lat: Column, step: float) -> Column:
    return F.concat_ws(":", degree_cell(lon, step).cast("string"), degree_cell(lat, step).cast("string"))


def box_cell_keys(box: Box, step: float) -> list[str]:
    """Keys of all degree cells a request box touches."""
    xs = range(math.floor(box.min_lon / step), math.floor(box.max_lon / step) + 1)
    ys = range(math.floor(box.min_lat / step), math.floor(box.max_lat / step) + 1)
    return [f"{x}:{y}" for x in xs for y in ys]


def explode_box_cells(step: float, prefix: str = "") -> tuple[Column, Column]:
    """Arrays of the cell columns and rows a box row covers, ready to explode."""
    return tuple(
        F.sequence(
            degree_cell(F.col(f"{prefix}min_{axis}"), step),
            degree_cell(F.col(f"{prefix}max_{axis}"), step),
        )
        for axis in ("lon", "lat")
    )


# --- lines -------------------------------------------------------------------


def line_from_points(order: list[Column], lon: Column, lat: Column) -> Column:
    """Aggregate: ordered polyline of a group."""
    rows = F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], point(lon, lat).alias("p"))))
    return F.transform(rows, lambda r: r["p"])


def line_segments(coords: Column) -> Column:
    """Array of {a, b} vertex pairs; empty for lines below two vertices."""
    n = F.greatest(F.size(coords) - 1, F.lit(0))
    return F.zip_with(
        F.slice(coords, F.lit(1), n),
        F.slice(coords, F.lit(2), n),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def line_length_m(coords: Column, radius: float = EARTH_RADIUS_M) -> Column:
    return F.aggregate(
        line_segments(coords),
        F.lit(0.0),
        lambda acc, s: acc + haversine_m(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"], radius),
    )


def line_box(coords: Column) -> list[Column]:
    lons, lats = F.transform(coords, lambda p: p["lon"]), F.transform(coords, lambda p: p["lat"])
    return [
        F.array_min(lons).alias("min_lon"),
        F.array_min(lats).alias("min_lat"),
        F.array_max(lons).alias("max_lon"),
        F.array_max(lats).alias("max_lat"),
    ]


def line_start(coords: Column) -> Column:
    return F.element_at(coords, 1)


def line_end(coords: Column) -> Column:
    return F.element_at(coords, -1)


def line_centroid(coords: Column) -> Column:
    """Length-weighted mean of segment midpoints (planar, in degrees)."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, s: Column) -> Column:
        dx, dy = s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"]
        w = F.sqrt(dx * dx + dy * dy)
        return F.struct(
            (acc["w"] + w).alias("w"),
            (acc["x"] + w * (s["a"]["lon"] + s["b"]["lon"]) / 2.0).alias("x"),
            (acc["y"] + w * (s["a"]["lat"] + s["b"]["lat"]) / 2.0).alias("y"),
        )

    first = line_start(coords)
    return F.aggregate(
        line_segments(coords),
        zero,
        add,
        lambda acc: F.when(acc["w"] > 0, point(acc["x"] / acc["w"], acc["y"] / acc["w"])).otherwise(
            point(first["lon"], first["lat"])
        ),
    )


def clip_range(a: Column, b: Column, box: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Parameter interval of segment a→b inside a box; empty when start > end."""
    min_lon, min_lat, max_lon, max_lat = box

    def axis(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = end - start
        t1, t2 = F.try_divide(low - start, d), F.try_divide(high - start, d)
        inside = (start >= low) & (start <= high)
        enter = F.when(d == 0, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(t1, t2))
        leave = F.when(d == 0, F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(t1, t2))
        return enter, leave

    enter_x, leave_x = axis(a["lon"], b["lon"], min_lon, max_lon)
    enter_y, leave_y = axis(a["lat"], b["lat"], min_lat, max_lat)
    return F.greatest(F.lit(0.0), enter_x, enter_y), F.least(F.lit(1.0), leave_x, leave_y)


def line_meets_box(coords: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    def hit(s: Column) -> Column:
        start, end = clip_range(s["a"], s["b"], box)
        return start <= end

    return F.exists(line_segments(coords), hit)


def boxes_overlap(a: str, b: str) -> Column:
    return (
        (F.col(a + "min_lon") <= F.col(b + "max_lon"))
        & (F.col(a + "max_lon") >= F.col(b + "min_lon"))
        & (F.col(a + "min_lat") <= F.col(b + "max_lat"))
        & (F.col(a + "max_lat") >= F.col(b + "min_lat"))
    )


def overlap_ratio(a: str, b: str) -> Column:
    """Shared area over the smaller area; zero when either box has none."""

    def side(axis: str) -> Column:
        low = F.greatest(F.col(f"{a}min_{axis}"), F.col(f"{b}min_{axis}"))
        high = F.least(F.col(f"{a}max_{axis}"), F.col(f"{b}max_{axis}"))
        return F.greatest(F.lit(0.0), high - low)

    def area(p: str) -> Column:
        return (F.col(p + "max_lon") - F.col(p + "min_lon")) * (F.col(p + "max_lat") - F.col(p + "min_lat"))

    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, side("lon") * side("lat") / smaller).otherwise(F.lit(0.0))


def grid_signature(coords: Column, digits: int = 3) -> Column:
    """Distinct rounded vertices, for near-identity of shapes."""
    return F.array_distinct(F.transform(coords, lambda p: point(F.bround(p["lon"], digits), F.bround(p["lat"], digits))))


def turn_penalty(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(1 - cos of the turn between a→b and c→d) · 0.35; zero without direction."""
    ux, uy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    vx, vy = d["lon"] - c["lon"], d["lat"] - c["lat"]
    norm = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ux * vx + uy * vy, norm)))
    return F.when(norm > 0, (F.lit(1.0) - cosine) * 0.35).otherwise(F.lit(0.0))


def centre_token(prefix: str, step: float) -> Column:
    lon, lat = box_centre(prefix)
    return F.concat_ws(
        ":",
        F.lit("grid"),
        F.bround(F.bround(lon / step) * step, 3).cast("string"),
        F.bround(F.bround(lat / step) * step, 3).cast("string"),
    )


def cell_area_km2() -> Column:
    """Area of a row's box from its lower and left sides; never zero."""
    width = haversine_m(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("min_lat"))
    height = haversine_m(F.col("min_lon"), F.col("min_lat"), F.col("min_lon"), F.col("max_lat"))
    return F.greatest(F.lit(1e-8), width * height / 1e6)


# --- China offset datum ------------------------------------------------------

# Fixed values of the published offset polynomial (Krasovsky 1940 ellipsoid). The
# meridian radius is taken as a constant.
OFFSET_AXIS_M = 6378245.0
OFFSET_MERIDIAN_M = 6335552.717000426
OFFSET_ECCENTRICITY = 0.00669342162296594323
OFFSET_AREA = Box(72.004, 0.8293, 137.8347, 55.8271)


def _waves(value: Column, terms: list[tuple[float, float]]) -> Column:
    total = None
    for weight, frequency in terms:
        term = F.lit(weight) * F.sin(value * (frequency * math.pi))
        total = term if total is None else total + term
    return total * 2.0 / 3.0


def _datum_shift(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lon - 105.0, lat - 35.0
    root = F.sqrt(F.abs(x))
    ripple = _waves(x, [(20.0, 6.0), (20.0, 2.0)])
    d_lat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root
    d_lat = d_lat + ripple + _waves(y, [(20.0, 1.0), (40.0, 1 / 3)]) + _waves(y, [(160.0, 1 / 12), (320.0, 1 / 30)])
    d_lon = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root
    d_lon = d_lon + ripple + _waves(x, [(20.0, 1.0), (40.0, 1 / 3)]) + _waves(x, [(150.0, 1 / 12), (300.0, 1 / 30)])
    rad = F.radians(lat)
    magic = F.lit(1.0) - F.lit(OFFSET_ECCENTRICITY) * F.sin(rad) * F.sin(rad)
    d_lat = d_lat * 180.0 / (OFFSET_MERIDIAN_M * math.pi)
    d_lon = d_lon * 180.0 / (F.lit(OFFSET_AXIS_M) / F.sqrt(magic) * F.cos(rad) * math.pi)
    # Listed instead of chosen by a condition: Spark makes common parts once only where they are always needed.
    place = F.when(~in_box(lon, lat, OFFSET_AREA), 1).otherwise(2)
    return tuple(F.element_at(F.array(F.lit(0.0), d), place) for d in (d_lon, d_lat))


def to_offset_datum(lon: Column, lat: Column) -> Column:
    d_lon, d_lat = _datum_shift(lon, lat)
    return point(lon + d_lon, lat + d_lat)


def from_offset_datum(lon: Column, lat: Column) -> Column:
    """One-step inverse: subtract the shift evaluated at the shifted point."""
    d_lon, d_lat = _datum_shift(lon, lat)
    return point(lon - d_lon, lat - d_lat)


# --- GeoJSON -----------------------------------------------------------------


def geojson_line(coords: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit("LineString").alias("type"),
            F.transform(coords, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"),
        )
    )


def geojson_cell() -> Column:
    """Closed ring of a row's box."""
    corners = [("min", "min"), ("max", "min"), ("max", "max"), ("min", "max"), ("min", "min")]
    ring = F.array(*[F.array(F.col(f"{x}_lon"), F.col(f"{y}_lat")) for x, y in corners])
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def geojson_feature(geometry: Column, properties: Column) -> Column:
    """Feature text from geometry text and a struct of properties."""
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(properties), F.lit("}")
    )
