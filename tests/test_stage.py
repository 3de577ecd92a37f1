"""Derived tables keep the place of their trips: points and edges are neither shuffled nor written out."""

import io
from contextlib import redirect_stdout
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayloom import session
from wayloom.functions import geo
from wayloom.operators import matching, retrieval, roads, routes
from wayloom.plans import files, regions
from wayloom.plans import routes as plans
from wayloom.plans.answers import _rows
from wayloom.sources import lattice, tables


def shown(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_points_are_placed_before_they_are_expanded(spark, sf_dir):
    points = lattice.taxi_points(spark, sf_dir)
    plan = shown(points.groupBy("taxi_id", "trip_id").count())
    assert plan.count("Exchange hashpartitioning") == 1 and "taxi_points" not in plan
    assert points.rdd.getNumPartitions() == lattice.trip_buckets(spark, sf_dir)
    # The planner must not take a walk for a table as small as its orders.
    size = points._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) > 20 * int(str(orders))


def test_staged_tables_hold_one_file_a_bucket(spark, sf_dir):
    edges = lattice.trip_edges(spark, sf_dir)
    assert 0 < len(edges.inputFiles()) <= lattice.trip_buckets(spark, sf_dir)


@pytest.mark.parametrize("kind", ["cluster", "single"])
def test_request_rows_hold_the_first_trip_of_every_signature(spark, sf_dir, kind):
    rows = _rows(spark, sf_dir).filter(f"kind = '{kind}'").select("query_id", "row_id", "signature").collect()
    assert rows and len({(r[0], r[1]) for r in rows}) == len(rows)
    if kind == "single":
        assert len({(r[0], r[2]) for r in rows}) == len(rows)


def test_points_written_in_place_are_all_there(spark, sf_dir, tmp_path):
    points = lattice.taxi_points(spark, sf_dir)
    tables.write_points(points, str(tmp_path / "p"), in_place=True)
    back = spark.read.parquet(str(tmp_path / "p")).drop("day")
    assert back.count() == points.count() and back.exceptAll(points).isEmpty()


def test_documents_lie_in_the_folder_of_their_language(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_folder", lambda spark, name: str(tmp_path / name))
    n = sum(r["files"] for r in files.markdown_scan(spark, sf_dir).collect())
    folders = [p for p in (tmp_path / "markdown").rglob("*") if p.is_dir()]
    assert n == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and {p.parent.name for p in folders} == {"markdown"}


def test_retrieval_keeps_no_lists_of_tokens(spark, monkeypatch):
    kept_columns, keep = [], retrieval.cut_lineage
    monkeypatch.setattr(retrieval, "cut_lineage", lambda df: kept_columns.append(df.columns) or keep(df))
    chunks = spark.createDataFrame([("a#0", "a.md", "road", "part 1", "red bus lane"), ("a#1", "a.md", "road", "part 2", "blue car")], "id string, path string, title string, heading string, content string")
    questions = spark.createDataFrame([(1, "which bus")], "qid long, question string")
    assert [r["id"] for r in retrieval.top_chunks(questions, chunks, 1).collect()] == ["a#0"]
    assert kept_columns and not any("tokens" in c or "heading_tokens" in c for c in kept_columns)


def test_points_near_nodes_are_settled_where_they_are(spark, sf_dir, monkeypatch):
    def refuse(df):
        raise AssertionError(f"{df.columns} would be written")

    monkeypatch.setattr(matching, "cut_lineage", refuse)
    nodes = matching.graph_nodes(lattice.road_edges(spark))
    points = lattice.taxi_points(spark, sf_dir)
    snapped = matching.snap_points(points.select("id", "lon", "lat"), nodes, ["id"])
    assert "hashpartitioning(id" not in shown(snapped) and snapped.count() == points.count()
    steps = matching.downsample(points, chunk_seconds=None)
    found = matching.candidates(steps, nodes, radius_m=5.0)
    assert shown(found).count("Exchange hashpartitioning(taxi_id") == 1 and found.count() == points.count()


def test_trips_with_choices_far_points_and_no_roads_are_matched(spark, monkeypatch):
    written, keep = [], matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df: written.append(df.columns) or keep(df))
    start = datetime(2008, 2, 2)
    places = {1: [(116.2032, 39.8), (116.2131, 39.8), (116.2229, 39.8)], 2: [(116.14, 39.8), (116.2, 39.8), (116.21, 39.8)], 3: [(10.0, 50.0), (10.1, 50.0), (10.2, 50.0)]}
    rows = [(t * 100 + k, 1, t, start + timedelta(minutes=k), x, y) for t, line in places.items() for k, (x, y) in enumerate(line)]
    points = spark.createDataFrame(rows, "id long, taxi_id long, trip_id long, gps_time timestamp_ntz, lon double, lat double")
    lines, status = matching.match_trips(points, lattice.road_edges(spark).withColumn("oneway", F.lit(None).cast("string")), radius_m=900.0, chunk_seconds=None)
    assert {r["trip_id"]: r["node_ids"] for r in lines.collect()} == {1: [0, 1000, 2000], 2: [0, 1000]}
    assert {r["trip_id"]: r["reason"] for r in status.collect()} == {1: "matched", 2: "matched", 3: "no-road-edges"}
    # No step of a trip is checkpointed but those far from all nodes.
    assert not any("straight_m" in columns for columns in written)


def test_matched_trips_are_made_row_by_row(spark, sf_dir):
    matched = lattice.matched_trips(spark, sf_dir)
    plan = shown(matched)
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    size = matched._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) > 20 * int(str(orders))
    walked = lattice.walk(spark, sf_dir).groupBy("taxi_id", "trip_id").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("i") * 1000 + F.col("j")).cast("long").alias("node")))).alias("r"))
    grouped = walked.select("taxi_id", "trip_id", F.transform("r", lambda r: r["node"]).alias("node_ids"))
    assert matched.select("taxi_id", "trip_id", "node_ids").exceptAll(grouped).isEmpty() and matched.count() == grouped.count()


def test_tables_of_a_route_answer_with_a_row_a_trip_are_kept_in_columns(spark, sf_dir, monkeypatch):
    written, cut = [], routes.cut_lineage
    monkeypatch.setattr(routes, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    assert plans._answer(spark, sf_dir, plans.STRICT)["routes"].count() > 0
    assert written and not any("vector_tokens" in c or "token_set" in c or "soft" in c or "a_hits" in c and "cluster_rank" not in c for c in written)


def test_trips_of_a_route_are_never_broadcast(spark, sf_dir):
    od, edges = lattice.trip_od(spark, sf_dir), lattice.trip_edges(spark, sf_dir)
    chosen, _ = routes.candidates(od, None, None, edges, plans.STRICT)
    # Files of that size would be broadcast by their compressed size, whatever their rows take.
    assert "Broadcast" not in shown(chosen) and chosen.count() > 0
    features = session.counted(routes.route_features(lattice.road_edges(spark), plans.STRICT))
    plan = shown(routes.sampled_trips(chosen, edges, features, plans.STRICT))
    # Only the roads are, and lists of tokens are not dealt out.
    assert plan.count("BroadcastExchange") == 1 and "rangepartitioning" not in plan and "Exchange hashpartitioning(road_uid" not in plan


def test_small_tables_are_broadcast_by_their_rows(spark, monkeypatch):
    left, few = spark.range(2000).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in shown(left.join(session.counted(few), "k"))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    assert "SortMergeJoin" in shown(left.join(session.counted(few), "k"))


def test_stop_tokens_are_dropped_in_place(spark):
    lists = {n: ["all", f"own{n}", "half" if n % 2 else "other"] for n in range(40)} | {40: ["all"], 41: [], 42: None, 43: ["b", "all", "a"]}
    trips = spark.createDataFrame(list(lists.items()), "trip_index long, vector_tokens array<string>")
    found = routes.drop_stop_tokens(trips)
    got = {r["trip_index"]: r["token_set"] for r in found.collect()}
    # A trip that has nothing else keeps what all have.
    assert got == {n: w and (sorted(set(w) - {"all"}) or w) for n, w in lists.items()}
    assert "Exchange hashpartitioning(trip_index" not in shown(found)


def test_passes_are_neither_shuffled_nor_written(spark, sf_dir):
    passes = lattice.passes(spark, sf_dir)
    hours = roads.road_hourly_counts(passes)
    plan = shown(hours)
    # The orders are dealt out by trip once; after that only counts per segment, hour and taxi move. Nobody asks for lengths of roads.
    assert plan.count("Exchange hashpartitioning(taxi_id") == 1 and "Sort" not in plan and "group_length_m" not in plan
    assert "FileScan parquet spark_catalog" not in shown(passes)
    told = roads.road_passes(lattice.trip_edges(spark, sf_dir), lattice.road_edges(spark), lattice.trip_od(spark, sf_dir), digits=3)
    passes = lattice.passes(spark, sf_dir, digits=3)
    assert passes.count() == told.count() and passes.exceptAll(told).isEmpty()
    # A window of departure reaches the trips before they are expanded.
    early = shown(passes.filter("start_time < TIMESTAMP_NTZ '2008-02-03 00:00:00'").select("taxi_id", "trip_id", "road_uid"))
    assert early.index("2008-02-03") > early.rindex("Generate explode(s#")


def test_edges_of_lines_with_gaps_repeats_and_copies(spark):
    nodes = {1: [0, 1000, None, 2000, 2000, 1000], 2: [0, 1000, 1001], 3: [], 4: None, 5: [0], 6: [None, 0, 1], 7: [0, 2000]}
    matched = spark.createDataFrame([(1, t, n) for t, n in nodes.items()] + [(1, 2, [0, 1000, 1001])], "taxi_id long, trip_id long, node_ids array<long>")
    network = lattice.road_edges(spark)
    edges = roads.edge_sequence(matched, network)
    found = sorted((r["trip_id"], r["edge_seq"], r["road_uid"], r["direction"]) for r in edges.collect())
    assert found == [(1, 2, 0, 1), (1, 4, 2000, 1), (1, 6, 2000, -1), (2, 2, 0, 1), (2, 3, 2001, 1), (6, 3, 1, 1)]
    times = matched.withColumn("start_time", F.lit(datetime(2008, 2, 2))).withColumn("end_time", F.lit(datetime(2008, 2, 3)))
    carried = roads.edge_sequence(times, network.unionByName(network), ["start_time", "end_time"], repeats=True)
    passes = roads.road_passes(carried, network)
    assert sorted((r["trip_id"], r["road_uid"], r["direction"]) for r in passes.collect()) == sorted((t, u, d) for t, _, u, d in found)


def test_points_stay_where_they_are_when_they_meet_boxes(spark, sf_dir):
    hits = regions._hits(spark, sf_dir)
    plan = shown(hits)
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(_level" not in plan and hits.count() > 0


def test_pairs_of_questions_and_sections_are_added_up_where_the_sections_are(spark):
    weights = session.counted(spark.createDataFrame([(q, w, 9, 1.0 / (q + 1)) for q in range(3) for w in ("bus", "lane")], "qid long, token string, df long, w double"))
    counts = spark.createDataFrame([(f"a#{n}", w, 0.1 * n) for n in range(9) for w in ("bus", "lane")], "id string, token string, share double")
    more = spark.createDataFrame([(2, "b#0", 2.0, None), (1, "a#1", None, 6.0)], "qid long, id string, phrase double, bonus double")
    ask = spark.createDataFrame([(0, [], False), (1, ["f1"], False), (2, [], True)], "qid long, features array<string>, detail boolean")
    detailed = spark.createDataFrame([("a#2",)], "id string")
    pairs = retrieval.likely_pairs(weights, counts, more, ask, detailed, 2)
    plan = shown(pairs)
    # Only the best of each task are dealt out by question.
    assert plan.count("Exchange hashpartitioning(id") == 1 and plan.index("Exchange hashpartitioning(qid") < plan.rindex("WindowGroupLimit")
    assert {(r["qid"], r["id"]) for r in pairs.collect()} == {(0, "a#8"), (0, "a#7"), (1, "a#1"), (1, "a#8"), (2, "a#2"), (2, "b#0")}


def test_phrases_are_found_at_every_character(spark):
    sections = spark.createDataFrame([("a#0", "t", "h", "x\U0001f68c\U0001f68cbus 车站 lane\u2028end"), ("a#1", "t", "h", "?bus")], "id string, title string, heading string, content string")
    asked = [(1, "\U0001f68cbus车"), (2, "站lane\u2028end"), (3, "us"), (4, "\U0001f68c"), (5, "bus站"), (6, "h?bus")]
    found = retrieval.phrase_hits(spark.createDataFrame(asked, "qid long, phrase string"), sections)
    assert {(r["qid"], r["id"]) for r in found.collect()} == {(1, "a#0"), (2, "a#0"), (3, "a#0"), (3, "a#1"), (4, "a#0"), (6, "a#1")}


def test_common_parts_of_a_datum_shift_are_made_once(spark):
    points = spark.createDataFrame([(116.3, 39.9), (10.0, 50.0), (None, 39.9)], "lon double, lat double")
    moved = points.select("lon", "lat", geo.to_offset_datum(F.col("lon"), F.col("lat")).alias("s"))
    out = io.StringIO()
    with redirect_stdout(out):
        moved.select("s.lon", "s.lat").explain("codegen")
    # Ten waves and one of the latitude; with the shifts chosen by a condition there were 14.
    assert 0 < out.getvalue().count("Math.sin(") <= 11
    got = [(r["s"]["lon"], r["s"]["lat"]) for r in moved.collect()]
    assert got[1] == (10.0, 50.0) and got[2] == (None, None) and abs(got[0][0] - 116.306) < 0.001 and abs(got[0][1] - 39.901) < 0.001
