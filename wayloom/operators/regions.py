"""Region questions: active vehicles, density, A/B flow, radiation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import geo, hexgrid
from wayloom.operators.sequence import CHUNK_SECONDS, neighbour, seconds_between
from wayloom.operators.trips import TRIP, filter_points, time_window
from wayloom.session import counted

FINEST_CELL = 0.01

def bucket(time: Column, granularity: str) -> Column:
    """Hour or day a moment belongs to."""
    if granularity not in ("hour", "day"):
        raise ValueError("granularity is hour or day")
    return F.date_trunc(granularity, time).cast("timestamp_ntz")


def with_totals(rows: DataFrame, **totals: Column) -> DataFrame:
    """Attach grand totals to every row without a one-partition window."""
    summary = rows.agg(*[value.alias(name) for name, value in totals.items()])
    return rows.crossJoin(F.broadcast(summary))


# --- active vehicles ---------------------------------------------------------


def active_vehicles(points: DataFrame, start: datetime, end: datetime, box: geo.Box | None = None) -> DataFrame:
    """Number of distinct vehicles seen; two-level count, so no task sees all ids of the points."""
    seen = filter_points(points, start, end, None, box).groupBy("taxi_id").agg(F.lit(1).alias("one"))
    return seen.agg(F.count("*").alias("active_vehicle_count"))


def box_hits(
    points: DataFrame, boxes: DataFrame, start: datetime, end: datetime, taxi_range: tuple[int, int] | None = None
) -> DataFrame:
    """Distinct (taxi, trip, box) visits.

    Points and boxes meet in square cells. A box is filed on the level of a doubling
    pyramid where it spans at most two cells each way, so that large boxes do not make
    more rows than small ones; a point looks once per level that holds a box.
    """
    rows = points.filter(time_window(start, end)).select(*TRIP, "lon", "lat")
    if taxi_range is not None:
        low, high = taxi_range
        if low > high:
            raise ValueError("taxi range is reversed")
        rows = rows.filter(F.col("taxi_id").between(low, high))
    side = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"), F.lit(FINEST_CELL))
    leveled = boxes.withColumn("_level", F.ceil(F.log2(side / FINEST_CELL)).cast("int"))

    def cell(value: Column, level: Column) -> Column:
        return F.floor(value / (F.pow(F.lit(2.0), level) * FINEST_CELL)).cast("long")

    def span(low: str, high: str) -> Column:
        return F.sequence(cell(F.col(low), F.col("_level")), cell(F.col(high), F.col("_level")))

    cells = leveled.withColumn("_x", F.explode(span("min_lon", "max_lon"))).withColumn("_y", F.explode(span("min_lat", "max_lat")))
    levels = [r["_level"] for r in leveled.select("_level").distinct().collect()]  # at most some twenty for boxes on earth
    if not levels:
        return rows.select(*TRIP, F.lit(None).cast(boxes.schema["box_index"].dataType).alias("box_index")).limit(0)
    placed = rows.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels])))
    placed = placed.withColumn("_x", cell(F.col("lon"), F.col("_level"))).withColumn("_y", cell(F.col("lat"), F.col("_level")))
    # Points stay where they are unless the boxes are very many; Spark cannot tell how few cells these lists of cells make.
    hits = placed.join(counted(cells), ["_level", "_x", "_y"]).filter(geo.in_box_columns(F.col("lon"), F.col("lat")))
    return hits.select(*TRIP, "box_index").distinct()


def vehicles_in_union(hits: DataFrame) -> DataFrame:
    return hits.select("taxi_id").distinct().agg(F.count("*").alias("active_vehicle_count"))


def union_vehicles(hits: DataFrame, row_limit: int | None = None) -> DataFrame:
    """Boxes and number of trips per vehicle; with ``row_limit`` only the first vehicles by id."""
    per_trip = hits.groupBy(*TRIP).agg(F.collect_set("box_index").alias("boxes"))
    per_box = hits.groupBy("taxi_id", "box_index").agg(F.lit(1).alias("one"))
    boxes = per_box.groupBy("taxi_id").agg(F.sort_array(F.collect_set("box_index")).alias("hit_boxes"))
    trips = per_trip.groupBy("taxi_id").agg(F.count("*").alias("hit_trip_count"))
    found = boxes.join(trips, "taxi_id")
    return found if row_limit is None else found.orderBy("taxi_id").limit(row_limit)


def union_trips(hits: DataFrame, row_limit: int | None = None) -> DataFrame:
    """Trips of the listed vehicles, one row each, so a busy vehicle never forms one huge value."""
    trips = hits.select(*TRIP).distinct()
    if row_limit is None:
        return trips
    return trips.join(hits.select("taxi_id").distinct().orderBy("taxi_id").limit(row_limit), "taxi_id", "left_semi")


def vehicles_per_box(hits: DataFrame) -> DataFrame:
    pairs = hits.select("box_index", "taxi_id").distinct()
    return pairs.groupBy("box_index").agg(F.count("*").alias("vehicle_count"))


# --- grid density ------------------------------------------------------------


def grid_density(
    points: DataFrame,
    start: datetime,
    end: datetime,
    box: geo.Box,
    cell_m: int = 500,
    count_vehicles: bool = False,
    max_cells: int | None = None,
) -> DataFrame:
    """Mercator cells of a box with their points; with ``max_cells`` only the busiest.

    The request box is widened to whole cells; ``total_points`` still counts only the
    points inside the box as requested.
    """
    snapped = geo.snap_box_to_mercator(box, cell_m)
    lon, lat = F.col("lon"), F.col("lat")
    rows = points.filter(time_window(start, end) & geo.in_box(lon, lat, snapped)).select(
        "taxi_id",
        F.floor(geo.mercator_x(lon) / cell_m).cast("int").alias("i"),
        F.floor(geo.mercator_y(lat) / cell_m).cast("int").alias("j"),
        geo.in_box(lon, lat, box).alias("asked"),
    )
    if count_vehicles:
        # Per-vehicle pre-aggregation keeps a crowded cell from becoming one large group.
        rows = rows.groupBy("i", "j", "taxi_id").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked_n"))
        cells = rows.groupBy("i", "j").agg(
            F.sum("n").alias("point_count"), F.count("*").alias("vehicle_count"), F.sum("asked_n").alias("asked_n")
        )
    else:
        cells = rows.groupBy("i", "j").agg(
            F.count("*").alias("point_count"),
            F.lit(None).cast("long").alias("vehicle_count"),
            F.count_if("asked").alias("asked_n"),
        )
    west, east = F.col("i") * cell_m, (F.col("i") + 1) * cell_m
    south, north = F.col("j") * cell_m, (F.col("j") + 1) * cell_m
    found = with_totals(cells, total_points=F.sum("asked_n"))
    if max_cells is not None:
        found = found.orderBy(F.col("point_count").desc(), "i", "j").limit(max_cells)
    return (
        found.select(
            "i",
            "j",
            "point_count",
            "vehicle_count",
            "total_points",
            geo.mercator_lon(west).alias("min_lon"),
            geo.mercator_lat(south).alias("min_lat"),
            geo.mercator_lon(east).alias("max_lon"),
            geo.mercator_lat(north).alias("max_lat"),
            ((geo.mercator_lon(west) + geo.mercator_lon(east)) / 2.0).alias("center_lon"),
            ((geo.mercator_lat(south) + geo.mercator_lat(north)) / 2.0).alias("center_lat"),
        )
    )


def density_per_km2(cells: DataFrame) -> DataFrame:
    area = geo.cell_area_km2()
    return cells.withColumn("area_km2", area).withColumn("density_km2", F.col("point_count") / F.col("area_km2"))


def hex_density(points: DataFrame, start: datetime, end: datetime, box: geo.Box, resolution: int = 9) -> DataFrame:
    """Points per hexagon."""
    cell = hexgrid.hex_cell(F.col("lon"), F.col("lat"), resolution)
    return (
        filter_points(points, start, end, None, box)
        .groupBy(cell.alias("cell"))
        .agg(F.count("*").alias("point_count"))
        .select(hexgrid.hex_id(F.col("cell"), resolution).alias("hex_id"), "cell", "point_count")
    )


def hex_rollup(cells: DataFrame, base_resolution: int, resolution: int) -> DataFrame:
    """Sum base cells into the coarser hexagon that holds their centre, densest first."""
    if resolution > base_resolution:
        raise ValueError("a rollup cannot refine")
    centre = hexgrid.hex_centre(F.col("cell"), base_resolution)
    # A centre can lie exactly on a border; a fraction of a millimetre settles it.
    parent = (
        F.col("cell")
        if resolution == base_resolution
        else hexgrid.hex_cell(centre["lon"] + 1e-9, centre["lat"] + 1e-9, resolution)
    )
    return (
        cells.select(parent.alias("cell"), "point_count")
        .groupBy("cell")
        .agg(F.sum("point_count").alias("point_count"))
        .select(
            hexgrid.hex_id(F.col("cell"), resolution).alias("hex_id"),
            "cell",
            "point_count",
            hexgrid.hex_centre(F.col("cell"), resolution).alias("center"),
            hexgrid.hex_boundary(F.col("cell"), resolution).alias("boundary"),
        )
        .orderBy(F.col("point_count").desc(), "hex_id")
    )


QUANTILE_BREAKS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
HEAT_QUANTILES = (0.4, 0.6, 0.8, 0.95)


def rank_quantiles(cells: DataFrame, value: str, shares: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """Exact order statistics at floor((n-1)·share) of the positive values.

    Works on the value histogram: a running count over distinct values finds each rank,
    so no group of equal values is ever expanded or sorted row by row.
    """
    by = by or []
    histogram = cells.filter(F.col(value) > 0).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumn("_upto", F.sum("_n").over(upto)).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*by))
    )
    picks = [
        F.min(F.when(F.col("_upto") > F.floor((F.col("_total") - 1) * share), F.col(value))).alias(f"q{round(share * 100)}")
        for share in shares
    ]
    return ranked.groupBy(*by).agg(*picks) if by else ranked.agg(*picks)


def class_breaks(cells: DataFrame, value: str, method: str = "quantile", by: list[str] | None = None) -> DataFrame:
    """Six class limits b0..b5 by rank or by equal width."""
    by = by or []
    if method == "quantile":
        picked = rank_quantiles(cells, value, QUANTILE_BREAKS, by)
        return picked.select(*by, *[F.col(f"q{20 * n}").cast("double").alias(f"b{n}") for n in range(6)])
    if method != "equal":
        raise ValueError("method is quantile or equal")
    positive = cells.filter(F.col(value) > 0)
    low, high = F.min(value), F.max(value)
    limits = [(low + (high - low) / 5.0 * n).cast("double").alias(f"b{n}") for n in range(5)]
    limits.append(high.cast("double").alias("b5"))
    return positive.groupBy(*by).agg(*limits) if by else positive.agg(*limits)


def assign_levels(cells: DataFrame, breaks: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Level 0 (highest) … 4 of each value; above the top limit is 0, anything else left is 4."""
    v = F.col(value)
    level = F.when(v.between(F.col("b4"), F.col("b5")), 0)
    for n in (3, 2, 1, 0):
        level = level.when(v.between(F.col(f"b{n}"), F.col(f"b{n + 1}")), 4 - n)
    level = level.when(v > F.col("b5"), 0).otherwise(4)
    joined = cells.join(F.broadcast(breaks), by) if by else cells.crossJoin(F.broadcast(breaks))
    return joined.withColumn("level", level).drop(*[f"b{n}" for n in range(6)])


def clipped_maximum(cells: DataFrame, value: str) -> DataFrame:
    """Heat-map scale: rank quantiles and the 95 % value, at least one, as the top."""
    picked = rank_quantiles(cells, value, HEAT_QUANTILES)
    return picked.withColumn("clipped_max", F.greatest(F.lit(1.0), F.col("q95").cast("double")))


# --- A/B flow ----------------------------------------------------------------


def transition_threshold(
    pairs: DataFrame,
    slow_mps: float = 2.8,
    winding: float = 1.6,
    minimum_s: int = 600,
    maximum_s: int = 7200,
) -> DataFrame:
    """Longest plausible travel time for A/B box pairs (columns a_min_lon … b_max_lat)."""
    if minimum_s > maximum_s:
        raise ValueError("minimum exceeds maximum")
    a_lon, a_lat = geo.box_centre("a_")
    b_lon, b_lat = geo.box_centre("b_")
    metres = geo.haversine_m(a_lon, a_lat, b_lon, b_lat)
    raw = metres / slow_mps * winding
    clamped = F.greatest(F.lit(float(minimum_s)), F.least(F.lit(float(maximum_s)), raw))
    seconds = F.least(F.lit(maximum_s), F.ceil(clamped / 60.0) * 60).cast("int")
    return pairs.select(
        "*",
        metres.alias("distance_meters"),
        raw.alias("raw_seconds"),
        seconds.alias("recommended_seconds"),
        F.floor(seconds / 60).cast("int").alias("recommended_minutes"),
    )


def tag_areas(
    points: DataFrame, start: datetime, end: datetime, area_a: geo.Box, area_b: geo.Box, buffer_m: float = 30
) -> DataFrame:
    """Points in A (which wins) or B; everything else is dropped."""
    lon, lat = F.col("lon"), F.col("lat")
    coarse = geo.in_box(lon, lat, area_a.grown(buffer_m)) | geo.in_box(lon, lat, area_b.grown(buffer_m))
    area = F.when(geo.near_box(lon, lat, area_a, buffer_m), "A").when(geo.near_box(lon, lat, area_b, buffer_m), "B")
    return (
        points.filter(time_window(start, end) & coarse)
        .select(*TRIP, "gps_time", "id", area.alias("area"))
        .filter("area IS NOT NULL")
    )


def area_changes(tagged: DataFrame, chunk_seconds: int | None = CHUNK_SECONDS) -> DataFrame:
    """First point of every stay in an area, in trip order."""
    paired = neighbour(tagged, TRIP, ["gps_time", "id"], ["area"], "prev", "gps_time", -1, chunk_seconds)
    return paired.filter(F.col("prev").isNull() | (F.col("prev.area") != F.col("area"))).drop("prev")


def area_transitions(
    changes: DataFrame, max_transition_s: int = 1800, chunk_seconds: int | None = CHUNK_SECONDS
) -> DataFrame:
    """Consecutive stays joined to moves A→B or B→A within the time limit."""
    paired = neighbour(changes, TRIP, ["gps_time", "id"], ["area", "gps_time"], "next", "gps_time", 1, chunk_seconds)
    seconds = seconds_between(F.col("gps_time"), F.col("next.gps_time"))
    return paired.filter((F.col("next.area") != F.col("area")) & seconds.between(0, max_transition_s)).select(
        *TRIP,
        F.col("gps_time").alias("leave_time"),
        F.when(F.col("area") == "A", "A_TO_B").otherwise("B_TO_A").alias("direction"),
        (seconds / 60.0).alias("duration_min"),
    )


def _directional(direction: str, value: Column | None = None) -> Column:
    is_it = F.col("direction") == direction
    return F.count_if(is_it) if value is None else F.avg(F.when(is_it, value))


def ab_flow(transitions: DataFrame, granularity: str = "hour") -> DataFrame:
    """Moves and mean durations per time bucket."""
    minutes = F.col("duration_min")
    return (
        transitions.groupBy(bucket(F.col("leave_time"), granularity).alias("time_bucket"))
        .agg(
            _directional("A_TO_B").alias("a_to_b"),
            _directional("B_TO_A").alias("b_to_a"),
            _directional("A_TO_B", minutes).alias("a_to_b_avg_duration_min"),
            _directional("B_TO_A", minutes).alias("b_to_a_avg_duration_min"),
        )
        .withColumn("total", F.col("a_to_b") + F.col("b_to_a"))
        .withColumn("net_flow", F.col("a_to_b") - F.col("b_to_a"))
    )


def ab_flow_summary(flow: DataFrame) -> DataFrame:
    """Totals and count-weighted mean durations over all buckets."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    def weighted(name: str) -> Column:
        mean = F.col(f"{name}_avg_duration_min")
        return F.try_divide(F.sum(mean * F.col(name)), F.sum(F.when(mean.isNotNull(), F.col(name))))

    net = total("a_to_b") - total("b_to_a")
    return flow.agg(
        total("a_to_b").alias("a_to_b_total"),
        total("b_to_a").alias("b_to_a_total"),
        (total("a_to_b") + total("b_to_a")).alias("total"),
        net.alias("net_flow"),
        F.when(net > 0, "A_TO_B").when(net < 0, "B_TO_A").otherwise("BALANCED").alias("dominant_direction"),
        weighted("a_to_b").alias("a_to_b_avg_duration_min"),
        weighted("b_to_a").alias("b_to_a_avg_duration_min"),
    )


# --- radiation flow ----------------------------------------------------------

DIRECTIONS = {"outbound": ["outbound"], "inbound": ["inbound"], "both": ["outbound", "inbound"]}


def _wanted(events: dict[str, DataFrame], direction: str) -> DataFrame:
    if direction not in DIRECTIONS:
        raise ValueError("direction is outbound, inbound or both")
    chosen = [events[name] for name in DIRECTIONS[direction]]
    return chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])


def radiation_strict(
    od: DataFrame,
    core: geo.Box,
    start: datetime,
    end: datetime,
    buffer_m: float = 30,
    direction: str = "both",
    granularity: str = "hour",
) -> DataFrame:
    """Trips that begin in the core and end outside, or the reverse."""
    starts_in = geo.near_box(F.col("start_lon"), F.col("start_lat"), core, buffer_m)
    ends_in = geo.near_box(F.col("end_lon"), F.col("end_lat"), core, buffer_m)

    def side(name: str, keep: Column, at: str, far: str) -> DataFrame:
        return od.filter(time_window(start, end, at) & keep).select(
            *TRIP,
            bucket(F.col(at), granularity).alias("time_bucket"),
            F.col(at).alias("event_time"),
            F.lit(name).alias("direction"),
            F.col(f"{far}_lon").alias("external_lon"),
            F.col(f"{far}_lat").alias("external_lat"),
            (F.col("duration_seconds") / 60.0).alias("duration_min"),
        )

    return _wanted(
        {
            "outbound": side("outbound", starts_in & ~ends_in, "start_time", "end"),
            "inbound": side("inbound", ends_in & ~starts_in, "end_time", "start"),
        },
        direction,
    )


def radiation_through(
    points: DataFrame,
    core: geo.Box,
    start: datetime,
    end: datetime,
    buffer_m: float = 30,
    max_transition_s: int = 3600,
    direction: str = "both",
    granularity: str = "hour",
    order: tuple[str, ...] = ("gps_time", "id"),
    cell_step: float | None = None,
) -> DataFrame:
    """Nearest outside point after the last, and before the first, core visit of a trip.

    One join of the core visits to the points of the same trips and two ``min_by`` /
    ``max_by`` aggregates replace a per-row lookup. With ``cell_step`` the points carry a
    grid key, which prunes the search for core visits; ``order`` is then
    ``("gps_time", "point_seq")``.
    """
    lon, lat = F.col("lon"), F.col("lat")
    inside = geo.near_box(lon, lat, core, buffer_m)
    window = points.filter(time_window(start, end))
    visits = window.filter(inside)
    if cell_step is not None:
        visits = visits.filter(F.col("grid_key").isin(geo.box_cell_keys(core.grown(buffer_m), cell_step)))
    core_times = visits.groupBy(*TRIP).agg(F.min("gps_time").alias("first_core"), F.max("gps_time").alias("last_core"))
    outside = window.filter(~inside).select(*TRIP, *order, "lon", "lat")
    paired = outside.join(core_times, TRIP)
    after = seconds_between(F.col("last_core"), F.col("gps_time"))
    before = seconds_between(F.col("gps_time"), F.col("first_core"))
    place, key = F.struct("gps_time", "lon", "lat"), F.struct(*order)
    found = paired.groupBy(*TRIP, "first_core", "last_core").agg(
        F.min_by(place, F.when((after > 0) & (after <= max_transition_s), key)).alias("next"),
        F.max_by(place, F.when((before > 0) & (before <= max_transition_s), key)).alias("prev"),
    )

    def side(name: str, at: str, far: str) -> DataFrame:
        seconds = F.abs(seconds_between(F.col(at), F.col(f"{far}.gps_time")))
        return found.filter(F.col(far).isNotNull()).select(
            *TRIP,
            bucket(F.col(at), granularity).alias("time_bucket"),
            F.col(at).alias("event_time"),
            F.lit(name).alias("direction"),
            F.col(f"{far}.lon").alias("external_lon"),
            F.col(f"{far}.lat").alias("external_lat"),
            (seconds / 60.0).alias("duration_min"),
        )

    return _wanted(
        {"outbound": side("outbound", "last_core", "next"), "inbound": side("inbound", "first_core", "prev")}, direction
    )


def _flows(suffix: str = "") -> list[Column]:
    return [
        F.count_if(F.col("direction") == "outbound").alias(f"outbound{suffix}"),
        F.count_if(F.col("direction") == "inbound").alias(f"inbound{suffix}"),
        F.count("*").alias("total"),
    ]


def radiation_regions(events: DataFrame, resolution: int = 8) -> DataFrame:
    """Flow totals per hexagon of the outside end."""
    cell = hexgrid.hex_cell(F.col("external_lon"), F.col("external_lat"), resolution)
    return (
        events.groupBy(cell.alias("cell"))
        .agg(*_flows("_total"), F.sum("duration_min").alias("duration_sum"))
        .select(
            hexgrid.hex_id(F.col("cell"), resolution).alias("region_id"),
            "cell",
            "outbound_total",
            "inbound_total",
            "total",
            (F.col("outbound_total") - F.col("inbound_total")).alias("net_flow"),
            (F.col("duration_sum") / F.col("total")).alias("avg_duration_min"),
            "duration_sum",
        )
    )


def top_regions(regions: DataFrame, top_k: int = 30, resolution: int | None = None) -> DataFrame:
    """Strongest regions; with a resolution their centre and boundary are added."""
    top = regions.orderBy(F.col("total").desc(), "region_id").limit(top_k)
    if resolution is not None:
        top = top.withColumn("center", hexgrid.hex_centre(F.col("cell"), resolution)).withColumn(
            "boundary", hexgrid.hex_boundary(F.col("cell"), resolution)
        )
    return top


def radiation_summary(regions: DataFrame, top_k: int = 30) -> DataFrame:
    """Totals over all regions plus the share held by the strongest ones."""
    top = regions.select("region_id", "total").orderBy(F.col("total").desc(), "region_id").limit(top_k)
    top_flow = top.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("top_k_flow"))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    net = total("outbound_total") - total("inbound_total")
    whole = regions.agg(
        total("outbound_total").alias("total_outbound"),
        total("inbound_total").alias("total_inbound"),
        total("total").alias("total_flow"),
        net.alias("net_flow"),
        F.when(net > 0, "outbound").when(net < 0, "inbound").otherwise("balanced").alias("dominant_direction"),
        F.try_divide(F.sum("duration_sum"), F.sum("total")).alias("avg_duration_min"),
        F.count("*").alias("external_region_count"),
    )
    return whole.crossJoin(F.broadcast(top_flow)).withColumn(
        "top_k_ratio", F.coalesce(F.try_divide(F.col("top_k_flow"), F.col("total_flow")), F.lit(0.0))
    )


def radiation_series(events: DataFrame, resolution: int = 8, top_k: int = 30) -> DataFrame:
    """Flow per bucket for the strongest regions."""
    cell = hexgrid.hex_cell(F.col("external_lon"), F.col("external_lat"), resolution)
    per_bucket = events.groupBy("time_bucket", hexgrid.hex_id(cell, resolution).alias("region_id")).agg(*_flows())
    ranking = per_bucket.groupBy("region_id").agg(F.sum("total").alias("all"))
    top = ranking.orderBy(F.col("all").desc(), "region_id").limit(top_k)
    # At most top_k (<= 100 by the interface) ids are broadcast.
    return (
        per_bucket.join(F.broadcast(top.select("region_id")), "region_id", "left_semi")
        .withColumn("net_flow", F.col("outbound") - F.col("inbound"))
        .orderBy("time_bucket", F.col("total").desc(), "region_id")
    )


