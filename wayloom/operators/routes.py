"""Frequent A→B routes: candidates, sub-paths, similarity clusters, representatives, top routes.

A question looks at all its trips unless ``max_candidates`` names a number. Clusters, branches, representatives and
figures are joins and aggregations; folding and the final pick are in :mod:`wayloom.operators.answers`.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import geo, names
from wayloom.operators.answers import merge_corridors, pick_routes
from wayloom.operators.graph import connected_components
from wayloom.operators.regions import with_totals
from wayloom.operators.roads import road_features
from wayloom.operators.sequence import bucket_pairs, numbered, seconds_between
from wayloom.operators.trips import GRID_STEP, TRIP, ntz
from wayloom.session import counted, cut_lineage, kept, large

RADIUS = 6371008.8
# Fixed values of the route rules.
THRESHOLDS = (0.78, 0.70, 0.62, 0.55, 0.48, 0.42)
STOP_SHARE = 0.9
SKELETON_SHARE = 0.35


@dataclass(frozen=True)
class RouteQuery:
    """One question: which ways do vehicles take from A to B?"""

    start: datetime
    end: datetime
    area_a: geo.Box
    area_b: geo.Box
    top_k: int = 5
    mode: str = "pass_through"
    buffer_m: float = 30.0
    min_support: int = 3
    min_edge_m: float = 20.0
    min_route_m: float = 500.0
    max_candidates: int | None = None
    hours: tuple[int, ...] | None = None
    minutes: tuple[int, int] | None = None

    def __post_init__(self) -> None:
        if self.start >= self.end:
            raise ValueError("start must be earlier than end")
        if self.mode not in ("pass_through", "strict_od"):
            raise ValueError("mode is pass_through or strict_od")
        if self.max_candidates is not None and self.max_candidates < 1:
            raise ValueError("max_candidates must be positive")

    @property
    def a(self) -> geo.Box:
        return self.area_a.grown(self.buffer_m)

    @property
    def b(self) -> geo.Box:
        return self.area_b.grown(self.buffer_m)


# --- candidates --------------------------------------------------------------


def window_trips(od: DataFrame, q: RouteQuery) -> DataFrame:
    """Trips inside the window; the hour filter also admits the hour before."""
    rows = od.filter((F.col("start_time") >= ntz(q.start)) & (F.col("end_time") <= ntz(q.end)) & (F.col("duration_seconds") > 0))
    if q.hours:
        wide = sorted({h % 24 for hour in q.hours for h in (hour, hour - 1)})
        rows = rows.filter(F.hour("start_time").isin(wide))
    return rows.select(*TRIP, "start_time")


def grid_hits(index: DataFrame, trips: DataFrame, q: RouteQuery) -> DataFrame:
    """Trips touching a cell of A and later a cell of B."""
    a_keys, b_keys = geo.box_cell_keys(q.a, GRID_STEP), geo.box_cell_keys(q.b, GRID_STEP)
    touched = index.filter(F.col("grid_key").isin(a_keys + b_keys)).join(large(trips), TRIP)
    first_a = touched.filter(F.col("grid_key").isin(a_keys)).groupBy(*TRIP, "start_time").agg(F.min("first_point_seq").alias("a_seq"))
    return (
        touched.filter(F.col("grid_key").isin(b_keys))
        .join(first_a.select(*TRIP, "a_seq"), TRIP)
        .filter(F.col("first_point_seq") > F.col("a_seq"))
        .select(*TRIP, "start_time")
        .distinct()
    )


def passage_times(points: DataFrame, trips: DataFrame, q: RouteQuery) -> DataFrame:
    """Last point in A before the first point in B that follows any point in A."""
    keys = geo.box_cell_keys(q.a, GRID_STEP) + geo.box_cell_keys(q.b, GRID_STEP)
    lon, lat = F.col("lon"), F.col("lat")
    near = (
        points.filter(F.col("grid_key").isin(keys))
        .select(
            *TRIP, "point_seq", "gps_time", geo.in_box(lon, lat, q.a).alias("in_a"), geo.in_box(lon, lat, q.b).alias("in_b")
        )
        .filter("in_a OR in_b")
        .join(trips, TRIP)
    )
    trip = [*TRIP, "start_time"]
    first_a = near.filter("in_a").groupBy(*trip).agg(F.min("point_seq").alias("a1"), F.min("gps_time").alias("t1"))
    first_b = (
        near.filter("in_b")
        .join(first_a, trip)
        .filter((F.col("point_seq") > F.col("a1")) & (F.col("gps_time") > F.col("t1")))
        .groupBy(*trip)
        .agg(F.min("point_seq").alias("b_seq"), F.min("gps_time").alias("b_enter_time"))
    )
    return (
        near.filter("in_a")
        .join(first_b, trip)
        .filter((F.col("point_seq") < F.col("b_seq")) & (F.col("gps_time") < F.col("b_enter_time")))
        .groupBy(*trip, "b_enter_time")
        .agg(F.max("gps_time").alias("a_enter_time"))
        .withColumn("duration_seconds", seconds_between(F.col("a_enter_time"), F.col("b_enter_time")))
    )


def strict_times(od: DataFrame, q: RouteQuery) -> DataFrame:
    """Trips that start in A and end in B; the whole trip is the passage."""
    inside = geo.in_box(F.col("start_lon"), F.col("start_lat"), q.a) & geo.in_box(F.col("end_lon"), F.col("end_lat"), q.b)
    chosen = window_trips(od.filter(inside), q).select(*TRIP)
    return od.join(large(chosen), TRIP, "left_semi").select(
        *TRIP,
        "start_time",
        F.col("start_time").alias("a_enter_time"),
        F.col("end_time").alias("b_enter_time"),
        "duration_seconds",
    )


def unindexed_times(points: DataFrame, od: DataFrame, q: RouteQuery) -> DataFrame:
    """Pass-through trips without a spatial index: first A point, then first B point after it."""
    lon, lat = F.col("lon"), F.col("lat")
    near = points.filter(F.col("gps_time").between(ntz(q.start), ntz(q.end))).select(
        *TRIP, "gps_time", geo.in_box(lon, lat, q.a).alias("in_a"), geo.in_box(lon, lat, q.b).alias("in_b")
    )
    near = near.filter("in_a OR in_b").join(large(window_trips(od, q)), TRIP)
    first = near.filter("in_a").groupBy(*TRIP).agg(F.min("gps_time").alias("a_enter_time"))
    return (
        near.filter("in_b")
        .join(first, TRIP)
        .filter(F.col("gps_time") > F.col("a_enter_time"))
        .groupBy(*TRIP, "start_time", "a_enter_time")
        .agg(F.min("gps_time").alias("b_enter_time"))
        .withColumn("duration_seconds", seconds_between(F.col("a_enter_time"), F.col("b_enter_time")))
    )


def departure_filter(rows: DataFrame, q: RouteQuery) -> DataFrame:
    """Hour and minute-of-day limits on the A time; a minute range may cross midnight."""
    if q.hours:
        rows = rows.filter(F.hour("a_enter_time").isin(list(q.hours)))
    if q.minutes:
        low, high = q.minutes
        minute = F.hour("a_enter_time") * 60 + F.minute("a_enter_time")
        rows = rows.filter(minute.between(low, high) if low <= high else (minute >= low) | (minute <= high))
    return rows


def candidates(
    od: DataFrame, index: DataFrame, grid_points: DataFrame, edges: DataFrame, q: RouteQuery
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Candidate passages, all of them unless the query names a number, and the frames of every stage for its counters."""
    stages: dict[str, DataFrame] = {"window": window_trips(od, q)}
    if q.mode == "pass_through":
        stages["grid"] = grid_hits(index, stages["window"], q)
        stages["precise"] = passage_times(grid_points, stages["grid"], q).filter(F.col("b_enter_time") > F.col("a_enter_time"))
    else:
        stages["precise"] = strict_times(od, q)
    stages["departure"] = departure_filter(stages["precise"], q)
    stages["matched"] = stages["departure"].join(large(edges.select(*TRIP)), TRIP, "left_semi")
    chosen = stages["matched"]
    if q.max_candidates is not None:
        chosen = chosen.orderBy("start_time", *TRIP).limit(q.max_candidates)
    return chosen.select(*TRIP, "start_time", "a_enter_time", "b_enter_time", "duration_seconds"), stages


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Trips left after every stage."""
    parts = [f.select(*TRIP).distinct().agg(F.count("*").alias("trips")).select(F.lit(n).alias("stage"), "trips") for n, f in stages.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- sub-paths and tokens ----------------------------------------------------


def route_features(roads: DataFrame, q: RouteQuery) -> DataFrame:
    """Per segment: A/B contact, length, sequence token and set tokens."""
    major = max(200.0, q.min_edge_m)
    rows = roads.select(F.col("edge_uid").alias("road_uid"), "coords").join(road_features(roads), "road_uid")

    def meets(area: geo.Box) -> Column:
        overlap = (
            (F.col("max_lon") >= area.min_lon)
            & (F.col("min_lon") <= area.max_lon)
            & (F.col("max_lat") >= area.min_lat)
            & (F.col("min_lat") <= area.max_lat)
        )
        return overlap & geo.line_meets_box(F.col("coords"), area.columns())

    key, kind = F.col("road_group_key"), F.lower("highway_class")
    token = names.road_token(key, F.col("road_uid"), kind, F.col("segment_length_m"), max(q.min_edge_m, 20.0), major)
    fine, coarse = geo.centre_token("", 0.01), geo.centre_token("", 0.02)
    named = F.col("token").startswith("road:")
    extra = F.when(named, F.concat(F.array(F.concat(F.lit("alias:"), F.col("fine"))), F.col("aliases"))).otherwise(
        F.expr("CAST(array() AS array<string>)")
    )
    none = F.expr("CAST(array() AS array<string>)")
    return (
        rows.withColumn("in_a", meets(q.a))
        .withColumn("in_b", meets(q.b))
        .withColumn("token", token)
        .withColumn("fine", fine)
        .withColumn("aliases", names.alias_tokens(key, kind, coarse))
        .select(
            "road_uid",
            "in_a",
            "in_b",
            "segment_length_m",
            "token",
            F.when(F.col("token").isNotNull(), F.concat(F.array("token", "fine"), extra)).otherwise(none).alias("set_tokens"),
        )
    )


def sampled_trips(chosen: DataFrame, edges: DataFrame, features: DataFrame, q: RouteQuery) -> DataFrame:
    """Passages with their A→B edge slice, length and tokens; numbered in candidate order."""
    walked = edges.join(large(chosen.select(*TRIP)), TRIP, "left_semi").join(features, "road_uid")
    whole = Window.partitionBy(*TRIP)
    ordered = whole.orderBy("edge_seq", "road_uid")
    seq = F.col("edge_seq")
    cut = (
        walked.withColumn("a0", F.min(F.when(F.col("in_a"), seq)).over(whole))
        .withColumn("b_seq", F.min(F.when(F.col("in_b") & (seq > F.col("a0")), seq)).over(whole))
        .withColumn("a_seq", F.max(F.when(F.col("in_a") & (seq < F.col("b_seq")), seq)).over(whole))
        .filter(seq.between(F.col("a_seq"), F.col("b_seq")))
        .withColumn("k", F.row_number().over(ordered))
        .withColumn("n", F.count("*").over(whole))
    )
    told_of = [F.count("*").cast("int").alias("n"), F.sum("segment_length_m").alias("route_length_m"), F.count("token").alias("tokens")]
    fit = (F.col("route_length_m") >= q.min_route_m) & (F.col("tokens") > 0)
    # Numbers are given to bare keys, so that the lists of tokens are made once, where the edges lie, and never dealt out.
    fitting = cut.groupBy(*TRIP).agg(*told_of).filter(fit).select(*TRIP)
    places = kept(numbered(fitting.join(large(chosen), TRIP), ["start_time", *TRIP], "trip_index"))
    uid = F.col("road_uid").cast("string")
    steps = F.array_compact(
        F.array(
            F.when(F.col("k") <= 3, F.concat(F.lit("anchor:start:"), uid)),
            F.when(F.col("k") > F.col("n") - 3, F.concat(F.lit("anchor:end:"), uid)),
            F.col("token"),
        )
    )

    def in_order(field: str) -> Column:
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", field))), lambda r: r[field]))

    trips = (
        cut.withColumn("steps", steps)
        .groupBy(*TRIP, "a_seq", "b_seq")
        .agg(
            *told_of,
            F.array_distinct(in_order("set_tokens")).alias("vector_tokens"),
            in_order("steps").alias("raw_steps"),
        )
        .filter(fit)
        .withColumn("sequence_tokens", names.without_repeats(F.col("raw_steps")))
    )
    return trips.join(large(places), TRIP).select(
        "trip_index",
        *TRIP,
        F.col("a_enter_time").alias("start_time"),
        F.col("b_enter_time").alias("end_time"),
        "duration_seconds",
        "route_length_m",
        F.col("n").alias("raw_edge_count"),
        "a_seq",
        "b_seq",
        "vector_tokens",
        "sequence_tokens",
    )


def drop_slow(trips: DataFrame, min_support: int) -> DataFrame:
    """Remove extreme durations when enough trips remain without them."""
    half = F.expr("percentile(CASE WHEN duration_seconds > 0 THEN duration_seconds END, 0.5)")
    cut = trips.agg(F.greatest(half * 3.0, F.lit(1800.0)).alias("cutoff"), F.count("*").alias("n"))
    ok = (F.col("duration_seconds") > 0) & (F.col("duration_seconds") <= F.col("cutoff"))
    judged = trips.crossJoin(F.broadcast(cut)).withColumn("ok", F.coalesce(ok, F.lit(False)))
    enough = judged.agg(F.count_if("ok").alias("kept"))
    apply = (F.col("n") >= 20) & (F.col("kept") >= max(1, min_support))
    return judged.crossJoin(F.broadcast(enough)).filter(~apply | F.col("ok")).select(*trips.columns, "cutoff")


def drop_stop_tokens(trips: DataFrame) -> DataFrame:
    """Ignore set tokens carried by nearly every trip, unless a trip has nothing else."""
    total = trips.agg(F.greatest(F.lit(2), F.ceil(F.count("*") * STOP_SHARE)).alias("max_df"))
    df = trips.select(F.explode("vector_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    # Each stands in nine of ten trips, so there are hardly more of them than tokens of one trip.
    stop = df.crossJoin(F.broadcast(total)).filter("df > max_df").agg(F.collect_list("token").alias("_stop"))
    rest = F.filter("vector_tokens", lambda t: ~F.array_contains("_stop", t))
    return trips.crossJoin(F.broadcast(stop)).select(
        *trips.columns, F.array_sort(F.when(F.size(rest) > 0, rest).otherwise(F.col("vector_tokens"))).alias("token_set")
    )


# --- similarity and clusters -------------------------------------------------


def token_sets(trips: DataFrame) -> DataFrame:
    """Distinct token sets with the number and first of their trips."""
    return trips.groupBy("token_set").agg(F.count("*").alias("trips"), F.min("trip_index").alias("set_id"))


def similar_sets(sets: DataFrame, floor: float = THRESHOLDS[-1]) -> DataFrame:
    """Pairs of sets with Jaccard similarity of at least ``floor``.

    Two such sets must share one of the rarest tokens of each, so only those prefixes
    are joined, in tiles where many sets share a token, and only sets of compatible size.
    """
    tokens = sets.select("set_id", F.explode("token_set").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = (
        tokens.join(df, "token")
        .groupBy("set_id")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
        .withColumn("size", F.size("r"))
    )
    keep = F.greatest(F.lit(1), F.col("size") - F.ceil(F.col("size") * floor) + 1).cast("int")
    prefix = ranked.select("set_id", "size", F.explode(F.slice("r", F.lit(1), keep)).alias("t")).select(
        "set_id", "size", F.col("t.token").alias("token")
    )
    small, large = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    wanted = (F.col("a.set_id") < F.col("b.set_id")) & (small >= F.ceil(large * floor))
    found = bucket_pairs(prefix, ["token"], "set_id", wanted).select(F.col("a.set_id").alias("src"), F.col("b.set_id").alias("dst")).distinct()
    left = sets.select(F.col("set_id").alias("src"), F.col("token_set").alias("x"))
    right = sets.select(F.col("set_id").alias("dst"), F.col("token_set").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        found.join(left, "src")
        .join(right, "dst")
        .withColumn("similarity", shared / (F.size("x") + F.size("y") - shared))
        .filter(F.col("similarity") >= floor)
        .select("src", "dst", "similarity")
    )


def ladder_labels(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(level, set_id, trips, cluster): the clusters at every threshold, all found in one run of components.

    A vertex is a set at a level; pairs link their sets at every level whose threshold they reach.
    """
    width = len(THRESHOLDS)
    levels = F.array(*[F.when(F.col("similarity") >= t, F.lit(n)) for n, t in enumerate(THRESHOLDS)])
    links = pairs.select("src", "dst", F.explode(F.array_compact(levels)).alias("level"))
    at = [(F.col(c) * width + F.col("level")).alias(c) for c in ("src", "dst")]
    vertices = sets.select("set_id", "trips", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("level")).withColumn("id", F.col("set_id") * width + F.col("level"))
    found = connected_components(vertices.select("id"), links.select(*at))
    return vertices.join(found, "id").select("level", "set_id", "trips", F.floor(F.col("component") / width).cast("long").alias("cluster"))


def threshold_clusters(sets: DataFrame, pairs: DataFrame, min_support: int, top_k: int) -> tuple[DataFrame, float]:
    """Set → cluster labels at the threshold whose ``top_k`` largest clusters hold most trips.

    A step to a looser threshold must win half a trip; at equal scores more clusters win, then the stricter threshold.
    """
    labels = kept(ladder_labels(sets, pairs))
    sizes = cut_lineage(labels.groupBy("level", "cluster").agg(F.sum("trips").alias("n")).filter(F.col("n") >= min_support))
    order = Window.partitionBy("level").orderBy(F.desc("n"), "cluster")
    top = sizes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_k).groupBy("level").agg(F.sum("n").alias("s"))
    # One row per threshold.
    rows = {r["level"]: (r["s"] - r["level"] * 0.5, r["c"], -r["level"]) for r in sizes.groupBy("level").agg(F.count("*").alias("c")).join(top, "level").collect()}
    level = -max((rows.get(n, (-n * 0.5, 0, -n)) for n in range(len(THRESHOLDS))))[2]
    at = F.col("level") == level
    return labels.filter(at).join(sizes.filter(at).select("cluster"), "cluster", "left_semi").select("set_id", "trips", "cluster"), THRESHOLDS[level]


def cluster_members(trips: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Trips with their cluster."""
    return (
        trips.join(sets.select("token_set", "set_id"), "token_set")
        .join(labels.select("set_id", "cluster"), "set_id")
        .select(*trips.columns, F.col("cluster").cast("string").alias("cluster_id"))
    )


def medoid_candidates(members: DataFrame) -> DataFrame:
    """Trips of each cluster, the most central first, with the parts of their score."""
    size = members.groupBy("cluster_id").agg(
        F.count("*").alias("size"),
        F.expr("percentile(CASE WHEN duration_seconds > 0 THEN duration_seconds END, 0.5)").alias("duration_p50"),
        F.expr("percentile(CASE WHEN route_length_m > 0 THEN route_length_m END, 0.5)").alias("route_p50"),
    )
    tokens = members.select("cluster_id", "trip_index", F.explode("token_set").alias("token"))
    freq = tokens.groupBy("cluster_id", "token").agg(F.count("*").alias("f")).join(size.select("cluster_id", "size"), "cluster_id")
    common = F.col("f") >= F.greatest(F.lit(2), F.ceil(F.col("size") * 0.18))
    weighted = counted(
        freq.select(
            "cluster_id", "token", "f", F.log10(F.col("f") + 1.0).alias("w"), F.when(common, F.log10(F.col("f") + 1.0)).otherwise(0.0).alias("hw")
        )
    )
    heavy = weighted.groupBy("cluster_id").agg(F.sum("hw").alias("hw_total"))
    raw = kept(
        tokens.join(weighted, ["cluster_id", "token"])
        .groupBy("cluster_id", "trip_index")
        .agg(F.sum("f").alias("raw"), F.sum("w").alias("soft"), F.sum("hw").alias("high"))
    )
    peak = raw.groupBy("cluster_id").agg(F.max("raw").alias("raw_max"), F.max("soft").alias("soft_max"))

    def off(value: str, centre: str, factor: float) -> Column:
        gap = F.abs(F.col(value) - F.col(centre)) / F.col(centre) * factor
        return F.when(F.col(centre) > 0, F.least(F.lit(0.35), gap)).otherwise(0.0)

    scored = (
        raw.join(counted(peak.join(heavy, "cluster_id").join(size, "cluster_id")), "cluster_id")
        .join(large(members.select("trip_index", "duration_seconds", "route_length_m")), "trip_index")
        .withColumn("soft_center", F.coalesce(F.try_divide(F.col("soft"), F.col("soft_max")), F.lit(0.0)))
        .withColumn(
            "high_recall",
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("high") / F.when(F.col("hw_total") > 0, F.col("hw_total")).otherwise(1.0))),
        )
        .withColumn("centrality", F.coalesce(F.try_divide(F.col("raw"), F.col("raw_max")), F.lit(0.0)))
        .withColumn(
            "score",
            (F.col("soft_center") * 0.62 + F.col("high_recall") * 0.38)
            * (1.0 - off("duration_seconds", "duration_p50", 0.18))
            * (1.0 - off("route_length_m", "route_p50", 0.22)),
        )
    )
    order = Window.partitionBy("cluster_id").orderBy(F.round("score", 12).desc(), "trip_index")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .select(
            "cluster_id", "size", "duration_p50", "route_p50", "trip_index", "rank", "score", "soft_center", "high_recall", "centrality"
        )
    )


def cluster_order(medoids: DataFrame) -> DataFrame:
    """Clusters from the largest, ties by medoid score and index."""
    best = medoids.filter("rank = 1").select("cluster_id", "size", F.col("score").alias("medoid_score"), F.col("trip_index").alias("medoid_index"))
    keyed = best.withColumn("_size", -F.col("size")).withColumn("_score", -F.round("medoid_score", 12))
    return numbered(keyed, ["_size", "_score", "medoid_index"], "cluster_rank").drop("_size", "_score")


# --- branch split ------------------------------------------------------------


def signature_features(signature: tuple[str, ...]) -> set[tuple]:
    """Tokens, ends and neighbouring runs of two and three as one comparable set."""
    runs = {(n, signature[k : k + n]) for n in (1, 2, 3) for k in range(len(signature) - n + 1)}
    return runs | {("first", signature[0]), ("last", signature[-1])}


def common_order(left: tuple[str, ...], right: tuple[str, ...]) -> float:
    """Longest common subsequence over the shorter length."""
    row = np.zeros(len(left) + 1, dtype=int)
    for token in right:
        match = np.array([0] + [row[k] + 1 if t == token else 0 for k, t in enumerate(left)])
        row = np.maximum.accumulate(np.maximum(row, match))
    return float(row[-1]) / max(1, min(len(left), len(right)))


def signature_similarity(left: tuple[str, ...], right: tuple[str, ...]) -> float:
    if not left or not right:
        return 0.0
    a, b = signature_features(left), signature_features(right)
    jaccard = len(a & b) / len(a | b)
    return max(jaccard, 0.45 * jaccard + 0.55 * common_order(left, right))


def split_branches(part: pd.DataFrame, min_support: int, branch_limit: int | None = None) -> dict[tuple[str, ...], int]:
    """Branch number of each signature of one cluster; absent means main line.

    ``part`` has one row per distinct signature with its trip count and first trip.
    """
    counts = {tuple(s): int(n) for s, n in zip(part["signature"], part["n"])}
    first = {tuple(s): int(k) for s, k in zip(part["signature"], part["first_trip"])}
    total = sum(counts.values())
    strong = sorted((s for s, n in counts.items() if s and n >= min_support), key=lambda s: (-counts[s], len(s), s))
    if total < max(min_support * 4, 40) or len(strong) <= 1:
        return {}
    main, seeds = strong[0], []
    for signature in strong[1:]:
        if branch_limit is not None and len(seeds) >= branch_limit:
            break
        if signature_similarity(signature, main) < 0.55 and all(signature_similarity(signature, s) < 0.72 for s in seeds):
            seeds.append(signature)
    owned: dict[tuple[str, ...], list[tuple[str, ...]]] = {s: [] for s in seeds}
    for signature in counts:
        if not signature or not seeds:
            continue
        to_main = signature_similarity(signature, main)
        close = [(signature_similarity(signature, s), -k, s) for k, s in enumerate(seeds)]
        best = max(close, key=lambda c: c[:2])
        if best[0] > to_main and best[0] >= 0.30 and best[0] >= to_main + 0.05:
            owned[best[2]].append(signature)
    branches = [b for b in owned.values() if sum(counts[s] for s in b) >= min_support]
    if not branches or total - sum(counts[s] for b in branches for s in b) < min_support:
        return {}
    branches.sort(key=lambda b: (-sum(counts[s] for s in b), min(first[s] for s in b)))
    return {s: k for k, b in enumerate(branches, start=1) for s in b}


SPLIT = "cluster_id string, signature array<string>, branch int"


def split_clusters(members: DataFrame, order: DataFrame, q: RouteQuery) -> DataFrame:
    """Re-label members of large mixed clusters by entry/exit branch.

    Every member keeps exactly one label: a branch or the main line of its parent.
    """
    def anchors(prefix: str) -> Column:
        return F.filter("sequence_tokens", lambda t: t.startswith(prefix))

    starts, ends = anchors("anchor:start:"), anchors("anchor:end:")
    signature = F.concat(F.slice(starts, 1, 3), F.slice(ends, F.greatest(F.size(ends) - 2, F.lit(1)), F.lit(3)))
    signed = members.withColumn("signature", signature)
    total = members.agg(F.count("*").alias("total"))
    sized = order.crossJoin(F.broadcast(total))
    general = F.greatest(F.lit(q.min_support), F.least(F.lit(30), F.greatest(F.lit(2), F.ceil(F.col("total") * 0.006))))
    support = F.greatest(F.lit(q.min_support), F.least(general, F.greatest(F.lit(2), F.ceil(F.col("size") * 0.008))))
    big = F.col("size") >= F.greatest(support * 4, F.lit(120), F.ceil(F.col("total") * 0.08))
    leading = (F.col("cluster_rank") <= max(q.top_k, 3)) | (F.col("size") >= F.greatest(F.lit(50), F.ceil(F.col("total") * 0.20)))
    worth = sized.filter(big & leading).select("cluster_id", support.cast("int").alias("support"))
    distinct = (
        signed.join(F.broadcast(worth), "cluster_id")
        .groupBy("cluster_id", "support", "signature")
        .agg(F.count("*").alias("n"), F.min("trip_index").alias("first_trip"))
    )

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = split_branches(part, int(key[1]))
        rows = [(key[0], list(s), found.get(tuple(s), 0)) for s in part["signature"]] if found else []
        return pd.DataFrame(rows, columns=["cluster_id", "signature", "branch"])

    # Distinct signatures of one cluster: at most its trips.
    branches = counted(distinct.groupBy("cluster_id", "support").applyInPandas(run, SPLIT))
    joined = signed.join(branches, ["cluster_id", "signature"], "left")
    ranks = counted(order.select("cluster_id", "cluster_rank", F.col("size").alias("parent_size")))
    name = F.when(F.col("branch") == 0, "Default_Mainline").otherwise(F.concat(F.lit("Branch_"), F.col("branch").cast("string")))
    return joined.join(ranks, "cluster_id").select(
        *[c for c in members.columns if c != "cluster_id"],
        F.concat(F.lit("c"), F.col("cluster_rank").cast("string")).alias("parent_cluster_id"),
        F.when(F.col("branch").isNull(), F.concat(F.lit("c"), F.col("cluster_rank").cast("string")))
        .otherwise(F.concat(F.lit("c"), F.col("cluster_rank").cast("string"), F.lit("."), name))
        .alias("cluster_id"),
        F.when(F.col("branch").isNull(), "jaccard_parent")
        .when(F.col("branch") == 0, "anchor_default_mainline")
        .otherwise("anchor_branch_variant")
        .alias("split_mode"),
        "parent_size",
    )


# --- representatives ---------------------------------------------------------


def representative_lines(picked: DataFrame, trips: DataFrame, edges: DataFrame, roads: DataFrame, features: DataFrame) -> DataFrame:
    """Stitched A→B line of the given trips with its checks and shape measures."""
    slices = picked.select("trip_index").distinct().join(large(trips.select("trip_index", *TRIP, "a_seq", "b_seq")), "trip_index")
    shape = counted(roads.select(F.col("edge_uid").alias("road_uid"), "coords").join(features.select("road_uid", "in_a", "in_b"), "road_uid"))
    part = (
        edges.join(large(slices), TRIP)
        .filter(F.col("edge_seq").between(F.col("a_seq"), F.col("b_seq")))
        .join(shape, "road_uid")
        .withColumn("line", F.when(F.col("direction") < 0, F.reverse("coords")).otherwise(F.col("coords")))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("edge_seq", "road_uid", "line"))), lambda r: r["line"])
    nothing = F.expr(f"CAST(array() AS {geo.LINE})")

    def tail(line: Column) -> Column:
        return F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0)))

    def attach(done: Column, line: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = F.reverse(line)
        return (
            F.when(F.size(line) < 2, done)
            .when(F.size(done) == 0, line)
            .when(last == F.element_at(line, 1), F.concat(done, tail(line)))
            .when(last == F.element_at(line, -1), F.concat(done, tail(back)))
            .otherwise(F.concat(done, line))
        )

    # Edges are placed by trip and stay there.
    lines = part.groupBy(*TRIP, "trip_index").agg(
        F.aggregate(ordered, nothing, attach).alias("coords"),
        F.min(F.when(F.col("in_a"), F.col("edge_seq"))).alias("first_a"),
        F.min(F.when(F.col("in_b"), F.col("edge_seq"))).alias("first_b"),
        F.count_if("in_a").alias("a_hits"),
        F.count_if("in_b").alias("b_hits"),
        (F.count("*") - F.size(F.array_distinct(F.collect_list("road_uid")))).alias("repeated_edges"),
        F.count("*").alias("edge_count"),
    )
    good = lines.filter((F.col("first_b") > F.col("first_a")) & (F.size("coords") >= 2))
    line = F.col("coords")
    first, last = geo.line_start(line), geo.line_end(line)
    distinct = F.size(F.array_distinct(F.transform(line, lambda p: geo.point(F.bround(p["lon"], 5), F.bround(p["lat"], 5)))))
    measured = good.withColumn("length_m", geo.line_length_m(line, RADIUS)).withColumn(
        "direct_m", geo.haversine_m(first["lon"], first["lat"], last["lon"], last["lat"], RADIUS)
    )
    return measured.select(
        "trip_index",
        "coords",
        "a_hits",
        "b_hits",
        "repeated_edges",
        "edge_count",
        F.round("length_m", 2).alias("geometry_length_m"),
        F.round("direct_m", 2).alias("direct_distance_m"),
        F.when(F.col("direct_m") > 1, F.round(F.col("length_m") / F.col("direct_m"), 3)).alias("directness"),
        F.round(F.greatest(F.lit(0.0), F.lit(1.0) - distinct / F.size(line)), 4).alias("repeat_ratio"),
    )


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def directness_score(d: Column) -> Column:
    """Piecewise reward of direct lines."""
    score = (
        F.when(d.isNull(), 0.25)
        .when(d <= 1.3, 1.0)
        .when(d <= 1.6, 1.0 - (d - 1.3) / 0.3 * 0.18)
        .when(d <= 2.2, 0.82 - (d - 1.6) / 0.6 * 0.47)
        .when(d <= 3.5, 0.35 - (d - 2.2) / 1.3 * 0.25)
        .otherwise(0.05)
    )
    return F.greatest(F.lit(0.02), F.least(F.lit(1.0), score))


def scored_representatives(medoids: DataFrame, lines: DataFrame, trips: DataFrame) -> DataFrame:
    """Quality of every representative candidate that has a valid line."""
    top = medoids.groupBy("cluster_id").agg(F.max("score").alias("top_score"))
    rows = (
        medoids.join(top, "cluster_id")
        .join(large(trips.select("trip_index", *TRIP, "duration_seconds", "route_length_m")), "trip_index")
        .join(large(lines), "trip_index")
        .withColumn("fallback_rank", F.col("rank") - 1)
    )

    def off(value: str, centre: str) -> Column:
        return F.when(F.col(centre) > 0, F.least(F.lit(1.0), F.abs(F.col(value) - F.col(centre)) / F.col(centre))).otherwise(0.0)

    d, repeat = F.col("directness"), F.col("repeat_ratio")
    revisits = F.greatest(F.col("a_hits") - 3, F.lit(0)) + F.greatest(F.col("b_hits") - 3, F.lit(0))
    centre = F.col("soft_center") * 0.58 + F.col("high_recall") * 0.28 + F.col("centrality") * 0.14
    physical = (
        directness_score(d) * 0.72
        + _unit(F.lit(1.0) - repeat * 6.0) * 0.16
        + _unit(F.lit(1.0) - F.col("repeated_edges") / F.greatest(F.lit(1), F.col("edge_count")) * 2.2) * 0.08
        + _unit(F.lit(1.0) - revisits / 7.0) * 0.04
    )
    quality = _unit(
        centre * 0.32
        + physical * 0.68
        - off("duration_seconds", "duration_p50") * 0.08
        - off("route_length_m", "route_p50") * 0.10
        - F.least(F.lit(0.08), F.col("fallback_rank") * 0.003)
    )
    shape_cap = F.when(d > 3.5, 0.32).when(d > 2.2, 0.52).when(d > 1.6, 0.72).otherwise(1.0)
    repeat_cap = F.when(repeat > 0.18, 0.42).when(repeat > 0.12, 0.62).otherwise(1.0)
    return rows.withColumn("quality", F.least(quality, shape_cap, repeat_cap))


def choose_representatives(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("cluster_id").orderBy(
        F.round("quality", 12).desc(), F.coalesce("directness", F.lit(999.0)), "fallback_rank", F.col("score").desc()
    )
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


# --- corridor records --------------------------------------------------------


def token_label(token: Column) -> Column:
    """Readable form of a token."""
    tail = F.substring_index(token, ":", -1)
    return (
        F.when(token.startswith("road:"), F.substring(token, 6, 10_000))
        .when(token.startswith("edge:"), F.concat(F.lit("edge#"), F.substring(token, 6, 10_000)))
        .when(token.startswith("anchor:start:"), F.concat(F.lit("start-anchor#"), tail))
        .when(token.startswith("anchor:end:"), F.concat(F.lit("end-anchor#"), tail))
        .otherwise(token)
    )


def skeletons(members: DataFrame) -> DataFrame:
    """Tokens most members share, in mean travel order; the eight commonest when none qualifies."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    tokens = members.select("cluster_id", F.posexplode(F.array_distinct("sequence_tokens")).alias("pos", "token"))
    stats = (
        tokens.groupBy("cluster_id", "token")
        .agg(F.count("*").alias("n"), F.avg("pos").alias("mean_pos"))
        .join(sizes, "cluster_id")
        .withColumn("shared", F.col("n") >= F.greatest(F.lit(1), F.ceil(F.col("size") * SKELETON_SHARE)))
    )
    strong = F.array_sort(
        F.collect_list(F.when(F.col("shared"), F.struct("mean_pos", (-F.col("n")).alias("neg"), "token")))
    )
    order = Window.partitionBy("cluster_id").orderBy(F.col("n").desc(), "mean_pos", "token")
    weak = F.array_sort(F.collect_list(F.when(F.col("place") <= 8, F.struct("place", "token"))))
    both = stats.withColumn("place", F.row_number().over(order)).groupBy("cluster_id").agg(strong.alias("s"), weak.alias("w"))
    labelled = F.when(F.size("s") > 0, F.transform("s", lambda r: r["token"])).otherwise(F.transform("w", lambda r: r["token"]))
    return both.select("cluster_id", F.transform(labelled, token_label).alias("signature_array"))


def duration_stats(members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Volume and duration figures per group, with hourly means, counts and (minutes, n) histograms as maps."""
    minutes = F.col("duration_seconds") / 60.0
    rows = members.withColumn("minutes", minutes)
    total = rows.agg(F.count("*").alias("_all"))
    base = rows.groupBy(key).agg(
        F.count("*").alias("trip_count"),
        F.count_distinct("taxi_id").alias("vehicle_count"),
        F.avg("minutes").alias("avg_duration_min"),
        *[F.expr(f"percentile(minutes, {p})").alias(f"p{round(p * 100)}_duration_min") for p in (0.2, 0.5, 0.9)],
        F.avg("route_length_m").alias("avg_route_length_m"),
    )
    # Durations as a histogram: equal minutes are one entry, added up before anything is listed.
    hours = (
        rows.groupBy(key, F.date_format("start_time", "HH").alias("hour"), F.round("minutes", 4).alias("at"))
        .agg(F.sum("minutes").alias("sum"), F.count("*").alias("n"))
        .groupBy(key, "hour")
        .agg(F.round(F.sum("sum") / F.sum("n"), 2).alias("mean"), F.array_sort(F.collect_list(F.struct(F.col("at").alias("minutes"), "n"))).alias("samples"), F.sum("n").alias("n"))
        .groupBy(key)
        .agg(
            *[
                F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour", c)))).alias(name)
                for c, name in (("mean", "durations_by_hour"), ("n", "trip_count_by_hour"), ("samples", "duration_samples_by_hour"))
            ]
        )
    )
    tail = F.when(F.col("p50_duration_min") > 1, F.col("p90_duration_min") / F.col("p50_duration_min"))
    return (
        base.join(hours, key)
        .crossJoin(F.broadcast(total))
        .withColumn("share_of_candidates", F.col("trip_count") / F.col("_all"))
        .withColumn("duration_tail_ratio", tail)
        .drop("_all")
    )


def variants(members: DataFrame, key: str = "cluster_id", keep: int | None = None) -> DataFrame:
    """The exact token sequences of each group, the most frequent first; all of them unless ``keep`` is given."""
    named = members.withColumn("variant_signature", F.array_join(F.transform("sequence_tokens", token_label), " > ")).withColumn(
        "minutes", F.col("duration_seconds") / 60.0
    )
    sizes = members.groupBy(key).agg(F.count("*").alias("size"))
    stats = named.groupBy(key, "variant_signature").agg(
        F.count("*").alias("trip_count"),
        F.count_distinct("taxi_id").alias("vehicle_count"),
        F.round(F.avg("minutes"), 2).alias("avg_duration_min"),
        F.expr("percentile(minutes, 0.5)").alias("p50_duration_min"),
        F.expr("percentile(minutes, 0.9)").alias("p90_duration_min"),
    )
    order = Window.partitionBy(key).orderBy(F.col("trip_count").desc(), "variant_signature")
    ranked = stats.withColumn("variant_rank", F.row_number().over(order))
    return (
        (ranked if keep is None else ranked.filter(F.col("variant_rank") <= keep))
        .join(sizes, key)
        .withColumn("share_within_corridor", F.col("trip_count") / F.col("size"))
        .drop("size")
    )


def _reasons(rules: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]), lambda r: r.isNotNull())


def _c(name: str, default: float) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def warnings_of() -> Column:
    """Why a corridor is shown with low confidence."""
    q, d, r, t = F.col("quality"), _c("directness", 0.0), F.col("repeat_ratio"), _c("duration_tail_ratio", 0.0)
    return _reasons(
        [
            (q < 0.35, "low_quality_score"),
            ((F.col("fallback_rank") >= 6) & (q < 0.72), "deep_fallback_low_quality"),
            ((d > 3.0) & (q < 0.82), "high_detour_low_quality"),
            (~((d > 3.0) & (q < 0.82)) & (d > 2.2) & (q < 0.68), "moderate_detour_low_quality"),
            ((r > 0.15) & (q < 0.75), "high_repeat_low_quality"),
            ((t > 3.0) & (q < 0.70), "long_duration_tail_low_quality"),
        ]
    )


def fatal_reasons() -> Column:
    """Why a corridor is not shown at all."""
    q, d, r, t = F.col("quality"), _c("directness", 0.0), F.col("repeat_ratio"), _c("duration_tail_ratio", 0.0)
    return _reasons(
        [
            (q < 0.25, "fatal_low_quality_score"),
            ((d > 5.0) & (q < 0.65), "fatal_extreme_detour"),
            ((r > 0.22) & (q < 0.65), "fatal_extreme_repeat"),
            ((t > 5.0) & (q < 0.55), "fatal_extreme_duration_tail"),
        ]
    )


def display_tiers() -> list[Column]:
    """Which display rounds would accept a corridor."""
    q, r, share = F.col("quality"), F.col("repeat_ratio"), F.col("share_of_candidates")
    d, t, known = _c("directness", 0.0), _c("duration_tail_ratio", 0.0), F.col("directness").isNotNull()
    back = F.col("fallback_rank")
    clean = known & (d <= 1.8) & (r <= 0.05) & (share >= 0.10) & (q >= 0.42)
    safe = clean | (
        (q >= 0.58)
        & ~((d > 3.2) | ((d > 2.6) & (q < 0.72)) | ((d > 2.2) & (q < 0.68)))
        & ~((r > 0.12) & (q < 0.75))
        & ~((back >= 6) & (q < 0.72))
        & ~((t > 4.0) & (q < 0.72))
    )
    rescue = known & (d <= 2.0) & (r <= 0.06) & (share >= 0.03) & (q >= 0.30)
    marginal = (
        ((q >= 0.40) | rescue)
        & ~((d > 3.4) | ((d > 3.0) & (q < 0.52)))
        & (r <= 0.16)
        & ~((back >= 12) & (q < 0.58))
        & ~((t > 4.8) & (q < 0.58))
    )
    shapely = known & (d <= 2.4) & (r <= 0.08) & (share >= 0.01) & (q >= 0.25)
    diagnostic = shapely | ((q >= 0.30) & (d <= 4.2) & (r <= 0.20) & ~((t > 6.0) & (q < 0.50)))
    support = (q >= 0.28) & (d <= 3.0) & (r <= 0.18) & ~((t > 5.2) & (q < 0.52))
    return [safe.alias("is_safe"), marginal.alias("is_marginal"), diagnostic.alias("is_diagnostic"), support.alias("is_support")]


def base_ranking() -> Column:
    """Quality times support with penalties; the display tier is applied when tiers are known."""
    d, r, t = _c("directness", 0.0), F.col("repeat_ratio"), _c("duration_tail_ratio", 0.0)
    detour = F.when(d > 2.2, F.greatest(F.lit(0.58), F.lit(1.0) - F.least(F.lit(0.35), (d - 2.2) * 0.12))).otherwise(1.0)
    repeat = F.when(r > 0.10, F.greatest(F.lit(0.72), F.lit(1.0) - F.least(F.lit(0.22), (r - 0.10) * 1.2))).otherwise(1.0)
    slow = F.when(t > 3.0, 0.82).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.col("quality")) * F.log10(F.col("trip_count") + 1.0) * detour * repeat * slow


def _shape_columns() -> list[Column]:
    grid = geo.grid_signature(F.col("coords"))
    return [
        F.transform(grid, lambda p: p["lon"]).alias("grid_lon"),
        F.transform(grid, lambda p: p["lat"]).alias("grid_lat"),
        *geo.line_box(F.col("coords")),
    ]


def single_trip_rows(scored: DataFrame, trips: DataFrame, order: DataFrame, valid: DataFrame, limit: int) -> DataFrame:
    """Single trips that may fill an answer with too few corridors, in cluster and rank order."""
    ok = (F.col("quality") >= 0.20) & (_c("directness", 0.0) <= 5.0) & (F.col("repeat_ratio") <= 0.22)
    tokens = F.filter("sequence_tokens", lambda t: ~t.rlike("^(grid:|alias:(?!route:|ring:|express:))"))
    rows = (
        scored.filter(ok)
        .select("cluster_id", "rank", "trip_index", "taxi_id", "trip_id", "quality", "directness", "repeat_ratio", "fallback_rank", "coords", "duration_seconds", "route_length_m")
        .join(order.select("cluster_id", "cluster_rank", "parent_cluster_id"), "cluster_id")
        .join(large(trips.select("trip_index", "sequence_tokens")), "trip_index")
        .withColumn("signature_array", F.transform(tokens, token_label))
        .withColumn("signature", F.array_join("signature_array", " > "))
        .filter("signature <> ''")
        # A signature is used once, by its best-placed trip.
        .withColumn("_n", F.row_number().over(Window.partitionBy("signature").orderBy("cluster_rank", "rank")))
        .filter("_n = 1")
        .drop("_n", "sequence_tokens")
    )
    # Rows are taken while there are fewer than top_k; each taken row can rule out two others, by signature and by trip.
    best = rows.orderBy("cluster_rank", "rank").limit(limit)
    return best.crossJoin(F.broadcast(valid)).withColumn("share_of_candidates", F.lit(1.0) / F.col("valid_trips"))


def frequent_routes(
    od: DataFrame,
    index: DataFrame,
    grid_points: DataFrame,
    edges: DataFrame,
    roads: DataFrame,
    q: RouteQuery,
) -> dict[str, DataFrame]:
    """Everything a question returns: routes, their variants, stage counts and a summary."""
    # Tables with a row a trip are kept in columns: their tokens and lines repeat, and most readers want few columns.
    chosen, stages = candidates(od, index, grid_points, edges, q)
    chosen = kept(chosen)
    features = counted(route_features(roads, q))
    valid = kept(sampled_trips(chosen, edges, features, q))
    trips = kept(drop_stop_tokens(drop_slow(valid, q.min_support)))
    sets = kept(token_sets(trips))
    pairs = kept(similar_sets(sets))
    labels, threshold = threshold_clusters(sets, pairs, q.min_support, q.top_k)
    parents = kept(cluster_members(trips, sets, labels))
    members = kept(split_clusters(parents, cluster_order(medoid_candidates(parents)), q))
    medoids = kept(medoid_candidates(members))
    homes = members.groupBy("cluster_id").agg(
        F.first("parent_cluster_id").alias("parent_cluster_id"),
        F.first("split_mode").alias("split_mode"),
        (F.count("*") / F.first("parent_size")).alias("share_of_parent_cluster"),
    )
    order = cluster_order(medoids).join(homes, "cluster_id")
    order = counted(order)
    lines = kept(representative_lines(medoids, trips, edges, roads, features))
    scored = kept(scored_representatives(medoids, lines, trips))
    reps = choose_representatives(scored)
    stats = duration_stats(members)
    records = (
        reps.drop("size", "duration_p50", "route_p50", "rank", "score", "top_score")
        .join(order.select("cluster_id", "cluster_rank", "parent_cluster_id", "split_mode", "share_of_parent_cluster"), "cluster_id")
        .join(skeletons(members), "cluster_id")
        .join(stats.select("cluster_id", "duration_tail_ratio"), "cluster_id")
        .withColumn("signature", F.array_join("signature_array", " > "))
        .filter(F.size(fatal_reasons()) == 0)
        .withColumn("warnings", warnings_of())
        .withColumn("query_id", F.lit(1))
        .select("*", *_shape_columns())
    )
    records = cut_lineage(records)
    folded = counted(merge_corridors(records))
    total = trips.agg(F.count("*").alias("valid_trips"))
    pooled = members.join(folded.drop("query_id"), "cluster_id")
    figures = duration_stats(pooled, "corridor_id").drop("share_of_candidates", "duration_tail_ratio")
    corridors = (
        records.withColumnRenamed("cluster_id", "corridor_id")
        .join(figures, "corridor_id")
        .crossJoin(F.broadcast(total))
        .withColumn("share_of_candidates", F.col("trip_count") / F.col("valid_trips"))
        .select(
            "*",
            F.col("corridor_id").alias("row_id"),
            F.col("cluster_rank").cast("long").alias("row_order"),
            F.lit("cluster").alias("kind"),
            F.concat_ws(":", "taxi_id", "trip_id").alias("representative"),
            base_ranking().alias("base_score"),
            *display_tiers(),
        )
    )
    corridors = cut_lineage(corridors)
    singles = single_trip_rows(scored, trips, order, total, q.top_k * 6 + 20)
    minutes = F.col("duration_seconds") / 60.0
    never = F.lit(False)
    fill = singles.select(
        F.lit(1).alias("query_id"),
        F.concat(F.lit("single:"), F.col("trip_index").cast("string")).alias("row_id"),
        ((F.col("cluster_rank").cast("long") + 1) * 1_000_000_000 + F.col("rank")).alias("row_order"),
        F.lit("single").alias("kind"),
        F.lit("single_trip_backfill").alias("split_mode"),
        "parent_cluster_id",
        F.concat_ws(":", "taxi_id", "trip_id").alias("representative"),
        F.lit(1).cast("long").alias("trip_count"),
        F.lit(1).cast("long").alias("vehicle_count"),
        "share_of_candidates",
        F.round(minutes, 2).alias("avg_duration_min"),
        *[F.round(minutes, 2).alias(f"p{p}_duration_min") for p in (20, 50, 90)],
        F.lit(1.0).alias("duration_tail_ratio"),
        F.round("route_length_m", 2).alias("avg_route_length_m"),
        "signature",
        "signature_array",
        "quality",
        "directness",
        "repeat_ratio",
        "fallback_rank",
        "coords",
        F.array(F.lit("single_trip_top_k_backfill")).alias("warnings"),
        *[never.alias(f) for f in ("is_safe", "is_marginal", "is_diagnostic", "is_support")],
        *_shape_columns(),
    ).withColumn("base_score", base_ranking())
    rows = corridors.select(*fill.columns).unionByName(fill)
    rows = cut_lineage(rows)
    picks = pick_routes(rows, q.top_k)
    routes = cut_lineage(rows.join(picks, ["query_id", "row_id"]).withColumn("similarity_threshold", F.lit(threshold)))
    shown = F.broadcast(routes.select(F.col("row_id").alias("corridor_id")))
    ways = variants(pooled, "corridor_id").join(shown, "corridor_id", "left_semi")
    summary = routes.agg(
        F.count("*").alias("route_count"), F.coalesce(F.sum("trip_count"), F.lit(0)).alias("top_k_trip_count")
    ).crossJoin(chosen.agg(F.count("*").alias("candidate_trip_count"))).crossJoin(
        valid.agg(F.count("*").alias("raw_valid_trip_count"))
    ).crossJoin(total.withColumnRenamed("valid_trips", "valid_ab_trip_count"))
    summary = summary.withColumn(
        "coverage_ratio", F.coalesce(F.try_divide(F.col("top_k_trip_count"), F.col("valid_ab_trip_count")), F.lit(0.0))
    ).withColumn("similarity_threshold", F.lit(threshold))
    return {"routes": routes, "variants": ways, "stages": stage_counts(stages), "summary": summary, "members": members}


# --- recommendation ----------------------------------------------------------

STRATEGIES = ("fastest", "stable", "frequent_fast")


def strategy_order(strategy: str) -> list[Column]:
    """Sort order of a strategy; missing or non-positive durations come last."""

    def minutes(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name))

    def last(value: Column) -> Column:
        return value.asc_nulls_last()

    p50, p90, avg, trips = minutes("p50_duration_min"), minutes("p90_duration_min"), minutes("avg_duration_min"), F.col("trip_count")
    if strategy == "fastest":
        return [last(p50), trips.desc()]
    if strategy == "stable":
        return [last(p90), last(p50)]
    if strategy == "frequent_fast":
        pace = F.least(F.coalesce(p50, F.lit(180.0)), F.lit(180.0)) * 0.65 + F.least(F.coalesce(avg, F.lit(180.0)), F.lit(180.0)) * 0.35
        return [(trips / F.greatest(F.lit(1), F.col("max_trip_count")) * 1.35 - pace / 180.0).desc()]
    raise ValueError(f"strategy is one of {STRATEGIES}")


def recommend(routes: DataFrame, strategy: str, tie: str = "route_rank") -> DataFrame:
    """Best route of one answer under a strategy."""
    known = with_totals(routes, max_trip_count=F.max("trip_count"))
    best = sort_routes(known, [*strategy_order(strategy), F.col(tie).asc()]).filter("position = 1")
    return best.drop("max_trip_count").withColumn("strategy", F.lit(strategy))


def sort_routes(routes: DataFrame, order: list[Column]) -> DataFrame:
    """Number the routes of one answer (at most top_k rows)."""
    return routes.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def sort_mode(mode: str) -> list[Column]:
    if mode == "frequency":
        return [F.col("trip_count").desc()]
    if mode in ("avg", "p50"):
        name = {"avg": "avg_duration_min", "p50": "p50_duration_min"}[mode]
        return [F.when(F.col(name) > 0, F.col(name)).asc_nulls_last(), F.col("trip_count").desc()]
    raise ValueError("mode is frequency, avg or p50")
