"""Frequent road corridors: edge statistics, components, backbones, ranking, drill-down."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import geo, names
from wayloom.functions.geo import EARTH_RADIUS_M
from wayloom.operators.graph import connected_components
from wayloom.operators.regions import with_totals
from wayloom.operators.roads import segment_length
from wayloom.operators.trips import TRIP, ntz
from wayloom.session import cut_lineage
from wayloom.sources.tables import oneway_mode

# Fixed values of the corridor rules.
#: Cells in which lines of one road meet.
CLUSTER_CELL_DEG = 0.002
CLUSTER_EPS_DEG = 0.00018
STITCH_GAP_M = 120.0
LONG_GAP_M = 260.0
LONG_SEGMENT_M = 1200.0
LONG_ANGLE_LIMIT = 0.22
FRAGMENT_PENALTY = 0.14
MIN_CONFIDENCE = 0.18

CORRIDOR = ["road_group_key", "direction"]


def keyed_roads(roads: DataFrame, box: geo.Box | None = None) -> DataFrame:
    """Segments with corridor attributes, optionally only those whose box meets the area."""
    rows = roads.select(
        F.col("edge_uid").alias("road_uid"),
        F.col("id").alias("road_id"),
        "u",
        "v",
        names.group_key(F.col("name"), F.col("id")).alias("road_group_key"),
        F.nullif(F.col("highway"), F.lit("")).alias("highway"),
        (oneway_mode(F.col("oneway")) != "both").alias("has_oneway_segment"),
        segment_length(F.col("length"), F.col("coords")).alias("segment_length_m"),
        "coords",
        *[c.alias("r_" + n) for c, n in zip(geo.line_box(F.col("coords")), ("min_lon", "min_lat", "max_lon", "max_lat"))],
    )
    if box is not None:
        rows = rows.filter(
            (F.col("r_min_lon") <= box.max_lon)
            & (F.col("r_max_lon") >= box.min_lon)
            & (F.col("r_min_lat") <= box.max_lat)
            & (F.col("r_max_lat") >= box.min_lat)
        )
    return rows.drop("r_min_lon", "r_min_lat", "r_max_lon", "r_max_lat")


def overlapping(passes: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Passes of trips whose time span meets the window."""
    return passes.filter((F.col("start_time") <= ntz(end)) & (F.col("end_time") >= ntz(start)))


def _described(stats: DataFrame, roads: DataFrame) -> DataFrame:
    return stats.join(roads, "road_uid").withColumnRenamed("segment_length_m", "matched_segment_length_m").withColumn(
        "road_name", F.col("road_group_key")
    )


def exact_edge_stats(passes: DataFrame, roads: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Exact trips and vehicles per segment and direction (``roads`` from :func:`keyed_roads`)."""
    per_trip = overlapping(passes, start, end).groupBy("road_uid", "direction", *TRIP).agg(F.count("*").alias("n"))
    per_taxi = per_trip.groupBy("road_uid", "direction", "taxi_id").agg(
        F.count("*").alias("trips"), F.sum("n").alias("n")
    )
    stats = per_taxi.groupBy("road_uid", "direction").agg(
        F.sum("trips").alias("trip_count"), F.count("*").alias("vehicle_count"), F.sum("n").alias("edge_pass_weight")
    )
    return _described(stats, roads)


def _hours(hourly: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Whole hours from the first to the last touched one, both included."""
    floor = lambda t: t.replace(minute=0, second=0, microsecond=0)
    return hourly.filter(F.col("hour_bucket").between(ntz(floor(start)), ntz(floor(end))))


def rollup_edge_stats(hourly: DataFrame, roads: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Sums of hourly counts; vehicles are the sum of hourly distinct vehicles."""
    stats = _hours(hourly, start, end).groupBy("road_uid", "direction").agg(
        F.sum("trip_count").alias("trip_count"),
        F.sum("vehicle_count").alias("vehicle_count"),
        F.sum("trip_count").alias("edge_pass_weight"),
    )
    return _described(stats, roads)


# --- candidates --------------------------------------------------------------


def _highways(column: str = "highway") -> Column:
    """Distinct road classes as text (a handful per road)."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(column)), ", "), F.lit(""))


def _ordering(sort_mode: str) -> list[Column]:
    if sort_mode not in ("frequency", "length_weighted"):
        raise ValueError("sort mode is frequency or length_weighted")
    trips, length = F.col("trip_count"), F.col("group_length_m")
    first = [(trips * F.greatest(length, F.lit(1.0))).desc()] if sort_mode == "length_weighted" else []
    return [*first, trips.desc(), F.col("edge_pass_weight").desc(), length.desc(), F.col("road_group_key"), F.col("direction")]


def group_candidates(
    group_hourly: DataFrame,
    roads: DataFrame,
    start: datetime,
    end: datetime,
    min_group_length_m: float = 300,
) -> DataFrame:
    """(group, direction) pairs that are long enough, with their hourly rollup."""
    flows = _hours(group_hourly, start, end).groupBy(*CORRIDOR).agg(
        *[F.sum(c).alias(c) for c in ("trip_count", "vehicle_count", "edge_pass_weight")]
    )
    lengths = (
        roads.groupBy("road_group_key")
        .agg(
            _highways().alias("highway"),
            F.bool_or("has_oneway_segment").alias("has_oneway_segment"),
            F.count_distinct("road_uid").alias("segment_count"),
            F.sum_distinct("segment_length_m").alias("matched_segment_length_m"),
            F.sum("segment_length_m").alias("group_length_m"),
        )
        .filter(F.col("group_length_m") >= min_group_length_m)
    )
    return flows.join(lengths, "road_group_key")


def corridor_families(candidates: DataFrame, sort_mode: str = "frequency") -> DataFrame:
    """Candidates with their family and rank inside it; ring roads share a family."""
    family = F.coalesce(names.corridor_family(F.col("road_group_key")), F.col("road_group_key"))
    order = Window.partitionBy("family", "direction").orderBy(*_ordering(sort_mode))
    return candidates.withColumn("family", family).withColumn("family_rank", F.row_number().over(order))


def family_totals(families: DataFrame) -> DataFrame:
    """Family metrics, summed over all member groups."""
    words = F.array_sort(
        F.array_distinct(F.flatten(F.collect_list(F.transform(F.split("highway", ","), lambda w: F.trim(w)))))
    )
    sums = ["segment_count", "trip_count", "vehicle_count", "edge_pass_weight", "matched_segment_length_m", "group_length_m"]
    return (
        families.groupBy("family", "direction")
        .agg(
            F.array_join(words, ", ").alias("highway"),
            F.bool_or("has_oneway_segment").alias("has_oneway_segment"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .withColumnRenamed("family", "road_group_key")
        .withColumn("road_name", F.col("road_group_key"))
    )


# --- components and backbones ------------------------------------------------


def orient(stats: DataFrame) -> DataFrame:
    """Turn segments into travel direction and score them."""
    back = F.col("direction") < 0
    return stats.select(
        *[c for c in stats.columns if c not in ("coords", "u", "v")],
        F.when(back, F.reverse("coords")).otherwise(F.col("coords")).alias("coords"),
        F.when(back, F.col("v")).otherwise(F.col("u")).alias("from_node"),
        F.when(back, F.col("u")).otherwise(F.col("v")).alias("to_node"),
        (F.col("edge_pass_weight") + F.col("trip_count")).cast("double").alias("score"),
        F.concat_ws(":", "road_uid", "direction").alias("id"),
    )


def _is_long() -> Column:
    words = F.transform(F.split(F.lower(F.coalesce("highway", F.lit(""))), ","), lambda w: F.trim(w))
    return (
        (F.col("matched_segment_length_m") >= LONG_SEGMENT_M)
        | F.arrays_overlap(words, F.array(*[F.lit(c) for c in names.CORRIDOR_CLASSES]))
        | names.is_ring(F.col("road_name"))
    )


def _tips() -> list[Column]:
    line = F.col("coords")
    return [
        F.element_at(line, 1).alias("p0"),
        F.element_at(line, 2).alias("p1"),
        F.element_at(line, -2).alias("q1"),
        F.element_at(line, -1).alias("q0"),
    ]


# Cells at least LONG_GAP_M wide up to 75 degrees latitude.
GAP_CELL_LAT = LONG_GAP_M / 110540.0
GAP_CELL_LON = LONG_GAP_M / (111320.0 * 0.2588)


def component_links(oriented: DataFrame) -> DataFrame:
    """Links between segments of a corridor that share a node or almost touch.

    Segments at one node are all linked to the node's first segment, never to each other.
    Near misses are found through end-point cells.
    """
    at_node = oriented.select(*CORRIDOR, "id", F.explode(F.array("from_node", "to_node")).alias("node")).filter("node IS NOT NULL")
    hub = at_node.groupBy(*CORRIDOR, "node").agg(F.min("id").alias("dst"))
    shared = at_node.join(hub, [*CORRIDOR, "node"]).select(F.col("id").alias("src"), "dst")
    ends = oriented.select(*CORRIDOR, "id", _is_long().alias("long"), *_tips()).withColumn(
        "tip", F.explode(F.array("p0", "q0"))
    )

    def cell(axis: str, size: float) -> Column:
        return F.floor(F.col(f"tip.{axis}") / size).cast("int")

    placed = ends.withColumn("cx", cell("lon", GAP_CELL_LON)).withColumn("cy", cell("lat", GAP_CELL_LAT))
    around = F.expr("sequence(-1, 1)")
    spread = placed.withColumn("cx", F.explode(F.transform(around, lambda d: F.col("cx") + d))).withColumn(
        "cy", F.explode(F.transform(around, lambda d: F.col("cy") + d))
    )
    a, b = spread.alias("a"), placed.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*CORRIDOR, "cx", "cy")]
    gap = geo.haversine_m(F.col("a.tip.lon"), F.col("a.tip.lat"), F.col("b.tip.lon"), F.col("b.tip.lat"))
    both_long = F.col("a.long") & F.col("b.long")
    bend = F.least(
        geo.turn_penalty(F.col("a.q1"), F.col("a.q0"), F.col("b.p0"), F.col("b.p1")),
        geo.turn_penalty(F.col("a.p1"), F.col("a.p0"), F.col("b.q0"), F.col("b.q1")),
    )
    touching = F.when(both_long, (gap <= LONG_GAP_M) & (bend <= LONG_ANGLE_LIMIT)).otherwise(gap <= STITCH_GAP_M)
    near = (
        a.join(b, [*same, F.col("a.id") < F.col("b.id")])
        .filter(touching)
        .select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    )
    return shared.unionByName(near).distinct()


def components(oriented: DataFrame) -> DataFrame:
    """Oriented segments with their component, numbered by length within the corridor."""
    labels = connected_components(oriented.select("id"), component_links(oriented))
    joined = oriented.join(labels, "id")
    sizes = joined.groupBy(*CORRIDOR, "component").agg(
        F.sum("matched_segment_length_m").alias("_len"), F.min("road_uid").alias("_first")
    )
    order = Window.partitionBy(*CORRIDOR).orderBy(F.round("_len", 6).desc(), "_first")
    numbered = sizes.select(
        *CORRIDOR,
        "component",
        F.row_number().over(order).alias("component_id"),
        F.count("*").over(Window.partitionBy(*CORRIDOR)).alias("fragment_count"),
    )
    return joined.join(numbered, [*CORRIDOR, "component"]).drop("component")


def _angle(u: np.ndarray, v: np.ndarray) -> float:
    norm = float(np.hypot(*u) * np.hypot(*v))
    return 0.0 if norm <= 0 else (1.0 - max(-1.0, min(1.0, float(u @ v) / norm))) * 0.35


def _gaps(tips: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Smallest distance between two tips and the tips of other segments, in metres."""
    a, b = np.radians(tips)[None, :, None, :], np.radians(others)[:, None, :, :]
    half = (b - a) / 2.0
    h = np.sin(half[..., 1]) ** 2 + np.cos(a[..., 1]) * np.cos(b[..., 1]) * np.sin(half[..., 0]) ** 2
    return (2.0 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))).min(axis=(1, 2))


def backbone(part: pd.DataFrame) -> list[int]:
    """Row positions of the main chain of one component, in travel order.

    Starts at the strongest segment, then grows the tail and the head: first along shared nodes,
    else across small gaps, always taking the strongest and straightest continuation.
    """
    n = len(part)
    uid, score = part["road_uid"].to_numpy(), part["score"].to_numpy(dtype=float)
    length, is_long = part["matched_segment_length_m"].to_numpy(dtype=float), part["long"].to_numpy()
    first, second, last_but, last = (np.array([[p["lon"], p["lat"]] for p in part[c]], dtype=float) for c in ("p0", "p1", "q1", "q0"))
    tips = np.stack([first, last], axis=1)
    starts, ends = part["from_node"].to_numpy(), part["to_node"].to_numpy()
    used = np.zeros(n, dtype=bool)

    def bend(k: int, m: int, forward: bool) -> float:
        if forward:
            return _angle(last[k] - last_but[k], second[m] - first[m])
        return _angle(first[k] - second[k], last_but[m] - last[m])

    def across_gap(k: int) -> list[int]:
        near = _gaps(tips[k], tips)
        out = []
        for m in np.flatnonzero(~used & (near <= LONG_GAP_M)).tolist():
            if is_long[k] and is_long[m]:
                if min(bend(k, m, True), bend(k, m, False)) <= LONG_ANGLE_LIMIT:
                    out.append(m)
            elif near[m] <= STITCH_GAP_M:
                out.append(m)
        return out

    seed = max(range(n), key=lambda k: (score[k], length[k], -uid[k]))
    used[seed] = True
    chain = [seed]
    for forward in (True, False):
        while True:
            edge = chain[-1] if forward else chain[0]
            joint, far = (ends[edge], starts) if forward else (starts[edge], ends)
            options = np.flatnonzero(~used & (far == joint)).tolist() or across_gap(edge)
            if not options:
                break
            pick = max(options, key=lambda m: (score[m] * (1.0 - bend(edge, m, forward)), length[m], -uid[m]))
            used[pick] = True
            chain.append(pick) if forward else chain.insert(0, pick)
    return chain


BACKBONE = "road_group_key string, direction smallint, component_id int, road_uid long, position int"


def _backbone_rows(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    ordered = part.sort_values("road_uid").reset_index(drop=True)
    place = {k: n for n, k in enumerate(backbone(ordered))}
    return pd.DataFrame(
        {
            "road_group_key": key[0],
            "direction": key[1],
            "component_id": key[2],
            "road_uid": ordered["road_uid"],
            "position": pd.array([place.get(k) for k in range(len(ordered))], dtype="Int32"),
        }
    )


def backbones(parts: DataFrame) -> DataFrame:
    """Components with the place of each segment in the backbone (null on a branch).

    A component is part of one road of the network, so groups are bounded by it.
    """
    narrow = parts.select(
        F.col("road_group_key"),
        F.col("direction").cast("smallint").alias("direction"),
        "component_id",
        "road_uid",
        "from_node",
        "to_node",
        "score",
        "matched_segment_length_m",
        _is_long().alias("long"),
        *_tips(),
    )
    places = narrow.groupBy(*CORRIDOR, "component_id").applyInPandas(_backbone_rows, BACKBONE)
    return parts.join(places, [*CORRIDOR, "component_id", "road_uid"])


def _chain_line() -> Column:
    """Backbone coordinates in order, joints written once."""
    rows = F.array_sort(
        F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "coords")))
    )
    points = F.flatten(F.transform(rows, lambda r: r["coords"]))
    return F.filter(points, lambda p, n: (n == 0) | (p != F.element_at(points, F.greatest(n, F.lit(1)))))


def component_rows(placed: DataFrame, min_group_length_m: float = 300, members: DataFrame | None = None) -> DataFrame:
    """One row per component. ``members`` (road_uid, direction, taxi, trip) gives exact distinct counts."""
    keys = [*CORRIDOR, "component_id"]
    on_chain = F.col("position").isNotNull()
    weight = F.sum("edge_pass_weight")
    rows = (
        placed.groupBy(*keys)
        .agg(
            F.min("road_name").alias("road_name"),
            _highways().alias("highway"),
            F.bool_or("has_oneway_segment").alias("has_oneway_segment"),
            F.count_distinct("road_uid").alias("segment_count"),
            F.sum("trip_count").alias("trip_sum"),
            F.sum("vehicle_count").alias("vehicle_sum"),
            weight.alias("edge_pass_weight"),
            F.sum("matched_segment_length_m").alias("group_length_m"),
            F.max("fragment_count").alias("fragment_count"),
            F.count_if(~on_chain).alias("branch_count"),
            F.count_if(on_chain).alias("backbone_segment_count"),
            F.coalesce(F.try_divide(F.sum(F.when(on_chain, F.col("edge_pass_weight"))), weight), F.lit(0.0)).alias(
                "corridor_confidence"
            ),
            _chain_line().alias("backbone"),
            F.collect_list(F.when(~on_chain, F.col("coords"))).alias("branches"),
        )
        .filter(F.col("group_length_m") >= min_group_length_m)
        .withColumn("matched_segment_length_m", F.col("group_length_m"))
        .withColumn("is_fragmented", F.col("fragment_count") > 1)
    )
    return _with_counts(rows, keys, placed, members)


def _with_counts(rows: DataFrame, keys: list[str], placed: DataFrame, members: DataFrame | None) -> DataFrame:
    if members is None:
        return rows.withColumnRenamed("trip_sum", "trip_count").withColumnRenamed("vehicle_sum", "vehicle_count")
    joined = members.join(placed.select(*keys, "road_uid"), ["road_uid", "direction"])
    per_trip = joined.groupBy(*keys, *TRIP).agg(F.lit(1).alias("one"))
    per_taxi = per_trip.groupBy(*keys, "taxi_id").agg(F.count("*").alias("trips"))
    exact = per_taxi.groupBy(*keys).agg(F.sum("trips").alias("trip_count"), F.count("*").alias("vehicle_count"))
    return rows.drop("trip_sum", "vehicle_sum").join(exact, keys)


def merge_components(rows: DataFrame, placed: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row per corridor from its kept components."""
    weight = F.sum("edge_pass_weight")
    merged = rows.withColumnRenamed("trip_count", "trip_c").withColumnRenamed("vehicle_count", "vehicle_c").groupBy(*CORRIDOR).agg(
        F.min("road_name").alias("road_name"),
        _highways().alias("highway"),
        F.bool_or("has_oneway_segment").alias("has_oneway_segment"),
        F.array_sort(F.collect_list("component_id")).alias("component_ids"),
        F.sum("segment_count").alias("segment_count"),
        F.sum("trip_c").alias("trip_sum"),
        F.sum("vehicle_c").alias("vehicle_sum"),
        weight.alias("edge_pass_weight"),
        F.sum("group_length_m").alias("group_length_m"),
        F.sum("matched_segment_length_m").alias("matched_segment_length_m"),
        ((F.count("*") > 1) | F.bool_or("is_fragmented")).alias("is_fragmented"),
        F.count("*").alias("fragment_count"),
        F.sum("branch_count").alias("branch_count"),
        F.sum("backbone_segment_count").alias("backbone_segment_count"),
        F.coalesce(F.try_divide(F.sum(F.col("edge_pass_weight") * F.col("corridor_confidence")), weight), F.lit(0.0)).alias(
            "corridor_confidence"
        ),
        F.transform(
            F.array_sort(F.collect_list(F.struct("component_id", "backbone"))), lambda r: r["backbone"]
        ).alias("backbones"),
        F.flatten(F.collect_list("branches")).alias("branches"),
    )
    kept = placed.join(rows.select(*CORRIDOR, "component_id"), [*CORRIDOR, "component_id"], "left_semi")
    return _with_counts(merged, CORRIDOR, kept, members)


def continuity_score(sort_mode: str = "frequency") -> Column:
    """Support weighted by how continuous the corridor is."""
    trips = F.col("trip_count").cast("double")
    support = trips * F.greatest(F.col("group_length_m"), F.lit(1.0)) if sort_mode == "length_weighted" else trips
    score = support * F.greatest(F.col("corridor_confidence"), F.lit(MIN_CONFIDENCE)) + F.col("edge_pass_weight") * 0.18
    fragments = F.greatest(F.lit(0.45), F.lit(1.0) - (F.col("fragment_count") - 1) * FRAGMENT_PENALTY)
    branches = F.greatest(F.lit(0.72), F.lit(1.0) - F.least(F.col("branch_count"), F.lit(6)) * 0.035)
    return score * fragments * branches


def rank_corridors(rows: DataFrame, top_k: int, sort_mode: str = "frequency", totals: DataFrame | None = None) -> DataFrame:
    """Top corridors with rank, direction label, grand totals and the share of the top."""
    trips, length = F.col("trip_count"), F.col("group_length_m")
    second = trips * F.greatest(length, F.lit(1.0)) if sort_mode == "length_weighted" else trips
    order = [
        F.round("continuity", 6).desc(),
        second.desc(),
        F.col("edge_pass_weight").desc(),
        F.col("corridor_confidence").desc(),
        length.desc(),
        F.col("road_group_key"),
        F.col("direction"),
    ]
    if "component_id" in rows.columns:
        order.append(F.col("component_id"))
    scored = rows.withColumn("continuity", continuity_score(sort_mode))
    base = (totals if totals is not None else rows).agg(
        F.coalesce(F.sum("trip_count"), F.lit(0)).alias("total_ranked_trip_count"),
        F.coalesce(F.sum("edge_pass_weight"), F.lit(0)).alias("total_edge_pass_weight"),
        F.count("*").alias("total_path_count"),
    )
    # The window only sees the top_k rows left by the limit.
    top = scored.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    label = F.when(F.col("direction") > 0, "forward").when(F.col("direction") < 0, "reverse").otherwise("unknown")
    return top.crossJoin(F.broadcast(base)).withColumn("direction_label", label)


def corridor_summary(ranked: DataFrame) -> DataFrame:
    """Totals of a ranked answer."""
    return ranked.agg(
        F.count("*").alias("path_count"),
        F.coalesce(F.max("total_path_count"), F.lit(0)).alias("total_path_count_before_top_k"),
        F.coalesce(F.sum("trip_count"), F.lit(0)).alias("top_k_trip_count"),
        F.coalesce(F.max("total_ranked_trip_count"), F.lit(0)).alias("total_ranked_trip_count"),
        F.coalesce(F.try_divide(F.sum("trip_count"), F.max("total_ranked_trip_count")), F.lit(0.0)).alias("top_k_ratio"),
        F.coalesce(F.max("trip_count"), F.lit(0)).alias("max_trip_count"),
        F.coalesce(F.max("vehicle_count"), F.lit(0)).alias("max_vehicle_count"),
        F.coalesce(F.sum("edge_pass_weight"), F.lit(0)).alias("top_k_edge_pass_weight"),
    )


def _built(stats: DataFrame) -> DataFrame:
    return cut_lineage(backbones(components(cut_lineage(orient(stats)))))


def corridors_exact(
    passes: DataFrame,
    roads: DataFrame,
    start: datetime,
    end: datetime,
    top_k: int = 50,
    min_group_length_m: float = 300,
    sort_mode: str = "frequency",
    box: geo.Box | None = None,
) -> DataFrame:
    """Frequent corridors with exact distinct trips and vehicles."""
    keyed = keyed_roads(roads, box)
    placed = _built(exact_edge_stats(passes, keyed, start, end))
    members = overlapping(passes, start, end).select("road_uid", "direction", *TRIP)
    rows = component_rows(placed, min_group_length_m)
    return rank_corridors(merge_components(rows, placed, members), top_k, sort_mode)


def corridors_hourly(
    hourly: DataFrame,
    roads: DataFrame,
    start: datetime,
    end: datetime,
    top_k: int = 50,
    min_group_length_m: float = 300,
    sort_mode: str = "frequency",
    box: geo.Box | None = None,
) -> DataFrame:
    """Frequent corridors straight from the hourly segment counts."""
    placed = _built(rollup_edge_stats(hourly, keyed_roads(roads, box), start, end))
    rows = component_rows(placed, min_group_length_m)
    return rank_corridors(merge_components(rows, placed), top_k, sort_mode)


def corridors_rollup(
    group_hourly: DataFrame,
    hourly: DataFrame,
    roads: DataFrame,
    start: datetime,
    end: datetime,
    top_k: int = 50,
    min_group_length_m: float = 300,
    sort_mode: str = "frequency",
    box: geo.Box | None = None,
) -> DataFrame:
    """Two stages: rank road groups by rollup, then build shapes for the finalists only."""
    keyed = keyed_roads(roads, box)
    families = cut_lineage(
        corridor_families(group_candidates(group_hourly, keyed, start, end, min_group_length_m), sort_mode)
    )
    flat = family_totals(families).select("*", F.lit(MIN_CONFIDENCE).alias("corridor_confidence"), F.lit(1).alias("fragment_count"), F.lit(0).alias("branch_count"))
    finalists = cut_lineage(rank_corridors(flat, top_k, sort_mode).select(*flat.columns))
    pairs = families.join(
        finalists.select(F.col("road_group_key").alias("family"), "direction"), ["family", "direction"], "left_semi"
    )
    stats = rollup_edge_stats(hourly, keyed, start, end).join(pairs.select(*CORRIDOR, "family"), CORRIDOR)
    stats = stats.withColumn("road_group_key", F.col("family")).withColumn("road_name", F.col("family")).drop("family")
    placed = _built(stats)
    shapes = merge_components(component_rows(placed, min_group_length_m), placed)
    metrics = finalists.select(
        *CORRIDOR, "highway", "has_oneway_segment", "segment_count", "trip_count", "vehicle_count", "edge_pass_weight", "group_length_m"
    )
    shaped = shapes.drop(*[c for c in metrics.columns if c not in CORRIDOR]).join(metrics, CORRIDOR)
    ordered = finalists.withColumn("continuity", continuity_score(sort_mode))
    place = Window.orderBy(F.round("continuity", 6).desc(), *_ordering(sort_mode))
    positions = ordered.select(*CORRIDOR, F.row_number().over(place).alias("stage_rank"))
    joined = shaped.join(positions, CORRIDOR)
    final = joined.withColumn("rank", F.row_number().over(Window.orderBy("stage_rank"))).drop("stage_rank")
    base = flat.agg(
        F.sum("trip_count").alias("total_ranked_trip_count"),
        F.sum("edge_pass_weight").alias("total_edge_pass_weight"),
        F.count("*").alias("total_path_count"),
    )
    label = F.when(F.col("direction") > 0, "forward").when(F.col("direction") < 0, "reverse").otherwise("unknown")
    return final.crossJoin(F.broadcast(base)).withColumn("direction_label", label)


def corridors_from_edges(
    edges: DataFrame,
    od: DataFrame,
    roads: DataFrame,
    start: datetime,
    end: datetime,
    top_k: int = 50,
    min_group_length_m: float = 300,
    max_trips: int | None = None,
    sort_mode: str = "frequency",
    box: geo.Box | None = None,
) -> DataFrame:
    """Answer from raw edge sequences when no rollup exists; with ``max_trips`` of the earliest trips only."""
    keyed = keyed_roads(roads, box)
    lengths = keyed.groupBy("road_group_key").agg(F.sum("segment_length_m").alias("group_length_m"))
    eligible = keyed.drop("u", "v", "coords").join(
        lengths.filter(F.col("group_length_m") >= min_group_length_m), "road_group_key"
    )
    window = overlapping(od.select(*TRIP, "start_time", "end_time"), start, end)
    on_road = edges.join(eligible.select("road_uid"), "road_uid", "left_semi")
    trips = window.select(*TRIP)
    if max_trips is not None:
        trips = window.join(on_road.select(*TRIP).distinct(), TRIP, "left_semi").orderBy("start_time", *TRIP).limit(max_trips).select(*TRIP)
    segments = (
        on_road.join(trips, TRIP, "left_semi").select(*TRIP, "road_uid", "direction").distinct().join(eligible, "road_uid")
    )
    per_trip = segments.groupBy(*CORRIDOR, *TRIP).agg(F.lit(1).alias("one"))
    per_taxi = per_trip.groupBy(*CORRIDOR, "taxi_id").agg(F.count("*").alias("n"))
    flows = per_taxi.groupBy(*CORRIDOR).agg(F.sum("n").alias("trip_count"), F.count("*").alias("vehicle_count"))
    unique = segments.groupBy(*CORRIDOR, "road_uid", "highway", "has_oneway_segment", "segment_length_m", "group_length_m").agg(
        F.lit(1).alias("one")
    )
    grouped = unique.groupBy(*CORRIDOR).agg(
        _highways().alias("highway"),
        F.bool_or("has_oneway_segment").alias("has_oneway_segment"),
        F.count("*").alias("segment_count"),
        F.sum("segment_length_m").alias("matched_segment_length_m"),
        F.max("group_length_m").alias("group_length_m"),
    )
    rows = grouped.join(flows, CORRIDOR)
    weighted = [(F.col("trip_count") * F.greatest("group_length_m", F.lit(1.0))).desc()] if sort_mode == "length_weighted" else []
    order = [*weighted, F.col("trip_count").desc(), F.col("vehicle_count").desc(), F.col("group_length_m").desc(), "road_group_key", "direction"]
    return with_totals(
        rows, total_ranked_trip_count=F.sum("trip_count"), total_path_count=F.count("*")
    ).orderBy(*order).limit(top_k)


# --- drill-down --------------------------------------------------------------


def line_pieces(segments: DataFrame, cell_deg: float, margin_deg: float) -> DataFrame:
    """(road_group_key, road_uid, x1, y1, x2, y2, cx, cy): straight pieces of at most a cell's length, once for every cell within ``margin_deg``."""
    n = F.size("coords")
    ends = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.struct(F.element_at("coords", i).alias("a"), F.element_at("coords", F.least(i + 1, n)).alias("b")),
    )
    straight = segments.filter(n > 0).select("road_group_key", "road_uid", F.explode(ends).alias("e")).select("road_group_key", "road_uid", "e.a", "e.b")
    dx, dy = F.col("b.lon") - F.col("a.lon"), F.col("b.lat") - F.col("a.lat")
    parts = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / cell_deg).cast("int"))
    cut = straight.withColumn("n", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def at(k: Column) -> tuple[Column, Column]:
        return F.col("a.lon") + dx * k / F.col("n"), F.col("a.lat") + dy * k / F.col("n")

    (x1, y1), (x2, y2) = at(F.col("k")), at(F.col("k") + 1)
    pieces = cut.select("road_group_key", "road_uid", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    for name, u, v in (("cx", "x1", "x2"), ("cy", "y1", "y2")):
        low, high = F.least(u, v) - margin_deg, F.greatest(u, v) + margin_deg
        pieces = pieces.withColumn(name, F.explode(F.sequence(F.floor(low / cell_deg), F.floor(high / cell_deg))))
    return pieces


def squared_gap(a: str, b: str) -> Column:
    """Squared distance of two aliased straight pieces, in degrees."""

    def at(side: str, end: int) -> tuple[Column, Column]:
        return F.col(f"{side}.x{end}"), F.col(f"{side}.y{end}")

    def off(p: tuple[Column, Column], q: tuple[Column, Column], r: tuple[Column, Column]) -> Column:
        """Of a point p from the piece q–r."""
        ux, uy = r[0] - q[0], r[1] - q[1]
        along = F.coalesce(F.try_divide((p[0] - q[0]) * ux + (p[1] - q[1]) * uy, ux * ux + uy * uy), F.lit(0.0))
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        dx, dy = p[0] - q[0] - along * ux, p[1] - q[1] - along * uy
        return dx * dx + dy * dy

    def side(p: tuple[Column, Column], q: tuple[Column, Column], r: tuple[Column, Column]) -> Column:
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    p, q, r, t = at(a, 1), at(a, 2), at(b, 1), at(b, 2)
    cross = (side(p, q, r) * side(p, q, t) < 0) & (side(r, t, p) * side(r, t, q) < 0)
    return F.when(cross, 0.0).otherwise(F.least(off(p, r, t), off(q, r, t), off(r, p, q), off(t, p, q)))


def near_components(segments: DataFrame, eps_deg: float = CLUSTER_EPS_DEG, cell_deg: float = CLUSTER_CELL_DEG) -> DataFrame:
    """Number (from 1) the parts of each road group whose lines come as close as eps.

    Lines meet in cells: when two are eps apart or less, the cell half-way between them lies within half of that of both.
    """
    pieces = line_pieces(segments, max(cell_deg, eps_deg), eps_deg / 2 * (1 + 1e-9))
    a, b = pieces.alias("a"), pieces.alias("b")
    links = (
        a.join(
            b,
            [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("road_group_key", "cx", "cy")]
            + [F.col("a.road_uid") < F.col("b.road_uid")],
        )
        .filter(squared_gap("a", "b") <= eps_deg * eps_deg)
        .select(F.col("a.road_uid").alias("src"), F.col("b.road_uid").alias("dst"))
        .distinct()
    )
    labels = connected_components(segments.select(F.col("road_uid").alias("id")).distinct(), links)
    joined = segments.join(labels.withColumnRenamed("id", "road_uid"), "road_uid")
    # Dense numbers from one row per component.
    order = Window.partitionBy("road_group_key").orderBy("component")
    numbers = joined.select("road_group_key", "component").distinct().withColumn("component_id", F.row_number().over(order))
    return joined.join(numbers, ["road_group_key", "component"]).drop("component")


def road_detail(
    counts: DataFrame, roads: DataFrame, road_group_key: str, direction: int, box: geo.Box, component_id: int | None = None
) -> DataFrame:
    """Segments of one road and direction along its main axis, with flow rank and totals.

    ``counts`` holds road_uid, trip_count, edge_pass_weight and vehicle_count of that direction.
    """
    segments = keyed_roads(roads, box).filter(F.col("road_group_key") == road_group_key)
    centre = geo.line_centroid(F.col("coords"))
    located = segments.select(
        "*", geo.line_length_m(F.col("coords")).alias("length_m"), centre["lon"].alias("center_x"), centre["lat"].alias("center_y")
    )
    axis = located.agg(
        F.coalesce(
            (F.max("center_x") - F.min("center_x")) >= (F.max("center_y") - F.min("center_y")), F.lit(True)
        ).alias("by_lon")
    )
    if component_id is not None:
        chosen = near_components(located.select("road_group_key", "road_uid", "coords")).filter(F.col("component_id") == component_id)
        located = located.join(chosen.select("road_uid"), "road_uid", "left_semi")
    stats = located.join(counts, "road_uid").crossJoin(F.broadcast(axis))
    along = F.when(F.col("by_lon"), F.col("center_x")).otherwise(F.col("center_y"))
    sign = 1 if direction >= 0 else -1
    # One road's segments inside a checked box: a bounded set, so plain rank windows do.
    flow = Window.partitionBy("road_group_key").orderBy(
        F.col("trip_count").desc(), F.col("edge_pass_weight").desc(), F.round("length_m", 6).desc(), "road_uid"
    )
    profile = Window.partitionBy("road_group_key").orderBy(F.round(along * sign, 9).asc_nulls_last(), "road_uid")
    ranked = stats.select(
        "road_group_key",
        "road_uid",
        "road_id",
        "highway",
        "length_m",
        "trip_count",
        "edge_pass_weight",
        "vehicle_count",
        F.row_number().over(flow).alias("flow_rank"),
        F.row_number().over(profile).alias("profile_order"),
        "coords",
    )
    return with_totals(
        ranked,
        total_segment_count=F.count("*"),
        total_trip_count=F.sum("trip_count"),
        total_edge_pass_weight=F.sum("edge_pass_weight"),
        max_trip_count=F.max("trip_count"),
        max_edge_pass_weight=F.max("edge_pass_weight"),
    ).orderBy("profile_order")


def detail_counts_exact(passes: DataFrame, road_group_key: str, direction: int, start: datetime, end: datetime) -> DataFrame:
    rows = overlapping(passes, start, end).filter(
        (F.col("road_group_key") == road_group_key) & (F.col("direction") == direction)
    )
    return rows.groupBy("road_uid").agg(
        F.count("*").alias("trip_count"), F.count("*").alias("edge_pass_weight"), F.lit(None).cast("long").alias("vehicle_count")
    )


def detail_counts_rollup(hourly: DataFrame, direction: int, start: datetime, end: datetime) -> DataFrame:
    return (
        _hours(hourly, start, end)
        .filter(F.col("direction") == direction)
        .groupBy("road_uid")
        .agg(
            F.sum("trip_count").alias("trip_count"),
            F.sum("trip_count").alias("edge_pass_weight"),
            F.max("vehicle_count").alias("vehicle_count"),
        )
    )
