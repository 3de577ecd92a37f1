"""Registered queries against their SQL on the smallest data.

A cross-section runs by default; WAYLOOM_ALL=1 runs every query that has SQL.
"""

import os

import pytest

from wayloom.plans import ORACLES, QUERIES
from wayloom.plans.checks import compare, duck

SAMPLE = [
    "clean_speed_rounds",
    "load_numbered_points",
    "dataset_summary",
    "od_endpoints",
    "trip_grid_points",
    "polylines",
    "clip_lines_to_box",
    "playback_slices",
    "boxes_union_vehicles",
    "grid_density_vehicles",
    "hex_rollup",
    "class_levels_quantile",
    "ab_flow_hourly",
    "radiation_through_events",
    "radiation_summary",
    "matched_trip_edges",
    "road_passes",
    "trip_tokens",
    "merge_spatial_index",
    "candidate_fallback",
    "match_trips",
    "corridor_components",
    "corridors_exact",
    "road_detail_rollup",
    "route_candidates_evening",
    "route_subpaths",
    "retrieval_top_chunks",
    "raw_log_scan",
    "sink_resume",
    "markdown_scan",
    "trip_chains",
    "corridor_candidates_by_length",
    "request_candidates",
    "request_corridors",
    "request_routes",
    "route_token_sets",
    "route_threshold_ladder",
    "match_trips_oneway",
    "retrieval_phrases_and_codes",
    "road_parts_travelled",
]
NAMES = sorted(ORACLES) if os.environ.get("WAYLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, con, name):
    result = compare(spark, sf_dir, name, con)
    assert result["ok"], result
