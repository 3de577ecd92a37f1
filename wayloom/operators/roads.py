"""Road facts: edge sequences, passes, rollups and token sequences of matched trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geo, names
from wayloom.operators.regions import bucket
from wayloom.operators.trips import TRIP
from wayloom.sources.tables import oneway_mode


def segment_length(roads_length: Column, coords: Column) -> Column:
    """Stored length when positive, measured length otherwise."""
    return F.when(roads_length > 0, roads_length).otherwise(geo.line_length_m(coords))


def road_features(roads: DataFrame) -> DataFrame:
    """What later steps need to know of a segment: class, name key, length and box."""
    return roads.select(
        F.col("edge_uid").alias("road_uid"),
        F.coalesce(F.trim("highway"), F.lit("")).alias("highway_class"),
        names.normal_name(F.col("name")).alias("road_group_key"),
        segment_length(F.col("length"), F.col("coords")).alias("segment_length_m"),
        *geo.line_box(F.col("coords")),
    )


def with_node_ids(matched: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node ids from exact vertex coordinates, for lines that came without them."""
    vertices = matched.select(*TRIP, F.posexplode("coords").alias("n", "p")).select(*TRIP, "n", "p.lon", "p.lat")
    found = vertices.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), ["lon", "lat"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("n", "node")))
    ids = found.groupBy(*TRIP).agg(F.transform(ordered, lambda r: r["node"]).alias("node_ids"))
    return matched.drop("node_ids").join(ids, TRIP)


def edge_sequence(matched: DataFrame, roads: DataFrame, carried: Sequence[str] = (), repeats: bool = False) -> DataFrame:
    """Road segments in travel order, with the columns ``carried`` of their trips.

    A line's vertices sit in one row, so consecutive nodes are paired without a window;
    both travel directions of a segment are rows of one lookup, so the either-way match is
    a single equi-join. Trips listed twice give every edge once unless ``repeats`` are left
    to a reader that groups the edges anyway.
    """
    keys = [*TRIP, *carried]
    numbered = F.transform("node_ids", lambda node, n: F.struct((n + 1).alias("seq"), node.alias("node")))
    known = F.filter(numbered, lambda s: s["node"].isNotNull())
    gap = F.exists("node_ids", lambda node: node.isNull())
    n = F.greatest(F.size("node_ids") - 1, F.lit(0))
    # Lines without gaps, nearly all, are paired by whole arrays: no value is looked at one by one.
    whole = (
        F.slice("node_ids", F.lit(1), n).alias("from"),
        F.slice("node_ids", F.lit(2), n).alias("to"),
        F.slice(F.sequence(F.lit(2), n + 2), F.lit(1), n).alias("edge_seq"),
    )
    m = F.greatest(F.size("known") - 1, F.lit(0))
    steps = F.zip_with(
        F.slice("known", F.lit(1), m),
        F.slice("known", F.lit(2), m),
        lambda a, b: F.struct(a["node"].alias("from"), b["node"].alias("to"), b["seq"].alias("edge_seq")),
    )
    paired = matched.select(*keys, F.when(gap, known).alias("known"), *whole).select(
        *keys, F.when(F.col("known").isNull(), F.arrays_zip("from", "to", "edge_seq")).otherwise(steps).alias("s")
    )
    walked = (
        # The outer form, as a filter inferred from the plain one would repeat the whole derivation of the pairs.
        paired.select(*keys, F.explode_outer("s").alias("s"))
        .select(*keys, F.col("s.from").alias("from"), F.col("s.to").alias("to"), F.col("s.edge_seq").alias("edge_seq"))
        .filter(F.col("from") != F.col("to"))
    )
    segment = roads.filter("u IS NOT NULL AND v IS NOT NULL").select(
        F.col("edge_uid").alias("road_uid"), F.col("id").alias("road_id"), "u", "v"
    )
    both_ways = segment.select(
        "road_uid",
        "road_id",
        F.explode(
            F.array(
                F.struct(F.col("u").alias("from"), F.col("v").alias("to"), F.lit(1).cast("short").alias("direction")),
                F.struct(F.col("v").alias("from"), F.col("u").alias("to"), F.lit(-1).cast("short").alias("direction")),
            )
        ).alias("d"),
    ).select("road_uid", "road_id", "d.from", "d.to", "d.direction")
    found = walked.join(both_ways, ["from", "to"]).select(*keys, "edge_seq", "road_uid", "road_id", "direction")
    return found if repeats else found.distinct()


def _is_oneway(mark: Column) -> Column:
    return oneway_mode(mark) != "both"


def road_groups(roads: DataFrame) -> DataFrame:
    """One row per segment and group key with its attributes."""
    keyed = roads.select(
        F.col("edge_uid").alias("road_uid"),
        "id",
        names.group_key(F.col("name"), F.col("id")).alias("road_group_key"),
        F.nullif(F.col("highway"), F.lit("")).alias("highway"),
        _is_oneway(F.col("oneway")).alias("oneway"),
        geo.line_length_m(F.col("coords")).alias("length_m"),
    )
    return keyed.groupBy("road_uid", "road_group_key").agg(
        F.min("id").alias("road_id"),
        F.expr("listagg(DISTINCT highway, ', ') WITHIN GROUP (ORDER BY highway)").alias("highway"),
        F.bool_or("oneway").alias("has_oneway_segment"),
        F.max("length_m").alias("segment_length_m"),
    )


def road_passes(edges: DataFrame, roads: DataFrame, od: DataFrame | None = None, sum_distinct_lengths: bool = False, digits: int | None = None) -> DataFrame:
    """One row per trip, segment and direction, with road attributes and trip times.

    ``digits`` rounds the lengths, once a road instead of once a pass. The times are those of ``od``; without it the edges carry them, and a filter on them
    reaches the trips before they are expanded.

    The length of a road group adds up its travelled segments once each over the whole
    data set; ``sum_distinct_lengths`` adds each distinct length value once instead.
    """
    groups = road_groups(roads)
    travelled = groups.join(edges.select("road_uid").distinct(), "road_uid", "left_semi")
    total = F.sum_distinct("segment_length_m") if sum_distinct_lengths else F.sum("segment_length_m")
    lengths = travelled.groupBy("road_group_key").agg(total.alias("group_length_m"))
    # Every road of a pass is travelled, so none is lost or added; readers without need of the length spare the look at all edges.
    attributes = groups.join(lengths, "road_group_key", "left")
    times = ["start_time", "end_time"]
    if digits is not None:
        attributes = attributes.withColumns({c: F.round(c, digits) for c in ("group_length_m", "segment_length_m")})
    once = edges.select(*TRIP, *(times if od is None else []), "road_uid", "direction").distinct().withColumn("segment_count", F.lit(1))
    timed = once if od is None else once.join(od.select(*TRIP, *times), TRIP)
    return (
        timed.join(attributes, "road_uid")
        .select(
            *TRIP,
            "road_uid",
            "road_id",
            "road_group_key",
            "direction",
            F.col("road_group_key").alias("road_name"),
            "highway",
            "has_oneway_segment",
            "segment_count",
            "group_length_m",
            F.col("segment_length_m").alias("matched_segment_length_m"),
            "start_time",
            "end_time",
        )
    )


def road_hourly_counts(passes: DataFrame) -> DataFrame:
    """Trips and vehicles per segment, direction and hour of departure.

    Counting per vehicle first spreads a busy street's passes over many small groups.
    """
    per_taxi = passes.groupBy(
        "road_uid", "direction", bucket(F.col("start_time"), "hour").alias("hour_bucket"), "taxi_id"
    ).agg(F.count("*").alias("n"))
    return per_taxi.groupBy("road_uid", "direction", "hour_bucket").agg(
        F.sum("n").alias("trip_count"), F.count("*").alias("vehicle_count")
    )


def road_group_hourly_counts(passes: DataFrame) -> DataFrame:
    """Trips, vehicles and segment passes per road group, direction and hour."""
    hour = bucket(F.col("start_time"), "hour").alias("hour_bucket")
    per_trip = passes.groupBy("road_group_key", "direction", hour, *TRIP).agg(F.count("*").alias("weight"))
    per_taxi = per_trip.groupBy("road_group_key", "direction", "hour_bucket", "taxi_id").agg(
        F.count("*").alias("n"), F.sum("weight").alias("weight")
    )
    return per_taxi.groupBy("road_group_key", "direction", "hour_bucket").agg(
        F.sum("n").alias("trip_count"),
        F.count("*").alias("vehicle_count"),
        F.sum("weight").alias("edge_pass_weight"),
    )


def _ordered(*fields: str) -> Column:
    """Edges of a trip in travel order, as one array value."""
    return F.array_sort(F.collect_list(F.struct("edge_seq", "road_uid", *fields)))


def edge_arrays(edges: DataFrame) -> DataFrame:
    """Ordered segment ids per trip."""
    return edges.groupBy(*TRIP).agg(_ordered().alias("e")).select(
        *TRIP, F.size("e").alias("edge_count"), F.transform("e", lambda r: r["road_uid"]).alias("road_uid_array")
    )


def trip_tokens(edges: DataFrame, roads: DataFrame, od: DataFrame, min_m: float = 20.0, major_m: float = 200.0) -> DataFrame:
    """Road tokens of each trip: ordered without repeats, and distinct by first use."""
    features = road_features(roads).select(
        "road_uid",
        "segment_length_m",
        names.road_token(
            F.col("road_group_key"), F.col("road_uid"), F.col("highway_class"), F.col("segment_length_m"), min_m, major_m
        ).alias("token"),
    )
    per_trip = (
        edges.join(features, "road_uid")
        .groupBy(*TRIP)
        .agg(
            F.count("*").cast("int").alias("raw_edge_count"),
            F.sum("segment_length_m").alias("route_length_m"),
            F.array_sort(
                F.collect_list(F.when(F.col("token").isNotNull(), F.struct("edge_seq", "road_uid", "token")))
            ).alias("e"),
        )
        .withColumn("tokens", F.transform("e", lambda r: r["token"]))
    )
    return per_trip.join(od.select(*TRIP, "start_time", "end_time", "duration_seconds"), TRIP).select(
        *TRIP,
        "start_time",
        "end_time",
        "duration_seconds",
        "route_length_m",
        "raw_edge_count",
        F.array_distinct("tokens").alias("vector_token_array"),
        names.without_repeats(F.col("tokens")).alias("sequence_token_array"),
    )
