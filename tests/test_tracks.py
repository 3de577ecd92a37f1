"""Chunked windows, cleaning rules and line work on small frames."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators import cleaning, lines
from wayloom.operators import regions
from wayloom.operators.sequence import chunking, neighbour, row_numbers, running_sum

T0 = datetime(2008, 2, 2)


def points(spark, rows):
    """rows: (taxi, trip, seconds, lon, lat)"""
    data = [(n, a, b, T0 + timedelta(seconds=s), x, y) for n, (a, b, s, x, y) in enumerate(rows)]
    return spark.createDataFrame(
        data, "id long, taxi_id long, trip_id long, gps_time timestamp_ntz, lon double, lat double"
    )


def test_chunked_windows_equal_plain_ones(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), 1, rng.randrange(0, 400_000), rng.random(), rng.random()) for _ in range(600)]
    df = points(spark, rows)
    keys, order = ["taxi_id"], ["gps_time", "id"]
    plain = Window.partitionBy(*keys).orderBy(*order)
    for step in (-1, 1):
        found = neighbour(df, keys, order, ["id"], "near", "gps_time", step, 3600)
        move = F.lag if step < 0 else F.lead
        wrong = found.withColumn("want", move("id").over(plain)).filter(~F.col("want").eqNullSafe(F.col("near.id")))
        assert wrong.count() == 0
    total = running_sum(df, keys, order, F.col("id"), "total", "gps_time", 3600)
    want = F.sum("id").over(plain.rowsBetween(Window.unboundedPreceding, 0))
    assert total.withColumn("want", want).filter("want <> total").count() == 0
    numbered = row_numbers(df, keys, order, "n", "gps_time", 3600)
    assert numbered.withColumn("want", F.row_number().over(plain)).filter("want <> n").count() == 0
    assert chunking(df, keys, 1000) is None and chunking(df, keys, 100) is not None


def test_trip_gap_limit_is_exclusive(spark):
    df = points(spark, [(1, 0, 0, 116.0, 40.0), (1, 0, 1800, 116.0, 40.0), (1, 0, 3601, 116.0, 40.0)])
    out = cleaning.assign_trips(df.drop("trip_id"), 30).orderBy("gps_time").collect()
    assert [r["trip_id"] for r in out] == [1, 1, 2]


def test_speed_rounds_compare_with_survivors_and_skip_small_steps(spark):
    rows = [(1, 0, 0, 116.0, 40.0), (1, 0, 60, 117.0, 40.0), (1, 0, 120, 117.01, 40.0), (1, 0, 180, 116.01, 40.0), (2, 0, 0, 116.0, 40.0), (2, 0, 0, 117.0, 40.0)]
    df = points(spark, rows).drop("trip_id")
    out = {(r["taxi_id"], r["lon"]): r["removed_round"] for r in cleaning.flag_speed_outliers(df).collect()}
    assert out[(1, 117.0)] == 1 and out[(1, 116.01)] == 1
    assert out[(1, 117.01)] == 2 and out[(1, 116.0)] is None
    assert out[(2, 117.0)] is None


def test_overlapping_areas_prefer_a_and_outside_is_invisible(spark):
    a, b = geo.Box(116.0, 40.0, 116.2, 40.2), geo.Box(116.1, 40.0, 116.4, 40.2)
    df = points(spark, [(1, 1, 0, 116.15, 40.1), (1, 1, 60, 118.0, 41.0), (1, 1, 120, 116.05, 40.1), (1, 1, 180, 116.3, 40.1)])
    changes = regions.area_changes(regions.tag_areas(df, T0, T0 + timedelta(days=1), a, b))
    assert [r["area"] for r in changes.orderBy("gps_time").collect()] == ["A", "B"]
    moves = regions.area_transitions(changes).collect()
    assert len(moves) == 1 and moves[0]["direction"] == "A_TO_B" and moves[0]["duration_min"] == 3.0


def test_empty_input_gives_empty_answers(spark):
    df = points(spark, [(1, 1, 0, 116.0, 40.0)]).filter("id < 0")
    core = geo.Box(116.0, 40.0, 116.2, 40.2)
    events = regions.radiation_through(df, core, T0, T0 + timedelta(days=1))
    row = regions.radiation_summary(regions.radiation_regions(events)).first()
    assert row["total_flow"] == 0 and row["dominant_direction"] == "balanced"


def test_box_rules():
    with pytest.raises(ValueError):
        geo.Box(1, 1, 1, 2)
    assert geo.Box(0, 0, 1, 1).grown(0) == geo.Box(0, 0, 1, 1)


def test_simplify_keeps_ends_and_drops_straight_points():
    x, y = np.array([0.0, 1.0, 2.0, 3.0, 3.0]), np.array([0.0, 0.001, 0.0, 0.0, 2.0])
    assert lines.kept_vertices(x, y, 0.01) == [1, 4, 5]
    assert lines.kept_vertices(x[:2], y[:2], 9.0) == [1, 2]


def test_merge_and_stitch():
    parts = [np.array([[0.0, 0.0], [0.01, 0.0]]), np.array([[0.02, 0.0], [0.01, 0.0]]), np.array([[0.0205, 0.0], [0.03, 0.0]]), np.array([[1.0, 1.0], [1.0, 1.001]])]
    merged = lines.merge_touching(parts)
    assert len(merged) == 3
    chain = lines.stitch(merged, 120.0)
    assert chain[0].tolist() == [0.0, 0.0] and chain[-1].tolist() == [0.03, 0.0]
    assert len(lines.stitch(merged, None)) > len(chain)


def test_stitch_groups_runs_per_group(spark):
    line = [{"lon": 0.0, "lat": 0.0}, {"lon": 0.01, "lat": 0.0}]
    df = spark.createDataFrame([("r", line), ("s", line)], f"road string, coords {geo.LINE}")
    out = lines.stitch_groups(df, ["road"]).collect()
    assert {r["road"] for r in out} == {"r", "s"} and all(r["part_count"] == 1 for r in out)


def test_chunked_forms_equal_plain_windows_also_for_null_keys(spark):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from wayloom.operators import sequence

    start = datetime(2008, 2, 2)
    rows = [(taxi, start + timedelta(hours=3 * k + (taxi or 0)), k, k % 3 != 0) for taxi in (None, 1, 20000) for k in range(15)]
    df = spark.createDataFrame(rows, "taxi_id long, gps_time timestamp_ntz, id int, alive boolean")
    order = ["gps_time", "id"]

    def both(run):
        return [sorted(map(str, run(chunk).collect())) for chunk in (None, 6 * 3600)]

    for run in (
        lambda c: sequence.row_numbers(df, ["taxi_id"], order, "n", "gps_time", c),
        lambda c: sequence.neighbour(df, ["taxi_id"], order, ["id"], "prev", "gps_time", -1, c),
        lambda c: sequence.neighbour(df, ["taxi_id"], order, ["id"], "next", "gps_time", 1, c),
        lambda c: sequence.previous_where(df, ["taxi_id"], order, ["id"], "prev", "gps_time", F.col("alive"), c),
    ):
        plain, chunked = both(run)
        assert plain == chunked and len(plain) == len(rows)


def test_high_vehicle_ids_are_kept(spark):
    from datetime import datetime

    from wayloom.operators import regions

    points = spark.createDataFrame([(20000, 1, datetime(2008, 2, 2, 1), 116.25, 39.85)], "taxi_id long, trip_id long, gps_time timestamp_ntz, lon double, lat double")
    boxes = spark.createDataFrame([(1, 116.2, 39.8, 116.3, 39.9), (2, -170.0, -80.0, 170.0, 80.0), (3, 0.0, 0.0, 1.0, 1.0)], "box_index int, min_lon double, min_lat double, max_lon double, max_lat double")
    hits = regions.box_hits(points, boxes, datetime(2008, 2, 2), datetime(2008, 2, 3))
    assert sorted(r["box_index"] for r in hits.collect()) == [1, 2]
    assert regions.union_vehicles(hits).count() == 1 and regions.union_trips(hits).count() == 1
    assert regions.box_hits(points, boxes.limit(0), datetime(2008, 2, 2), datetime(2008, 2, 3)).count() == 0


def test_stitch_groups_starts_no_python_group_per_trip(spark):
    big = 2**60 + 1
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = [(big, line((0, 0), (1, 0))), (big, line((2, 0), (1, 0))), (None, line((5, 5), (6, 5))), (7, line((1, 1)))]
    df = spark.createDataFrame(rows, f"trip long, coords {geo.LINE}")
    found = lines.stitch_groups(df, ["trip"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsIn" not in plan
    got = {r["trip"]: ([(p["lon"], p["lat"]) for p in r["coords"]], r["part_count"]) for r in found.collect()}
    assert got == {big: ([(0, 0), (1, 0), (2, 0)], 2), None: ([(5, 5), (6, 5)], 1)}
