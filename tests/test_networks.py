"""Components, decoding, routing, backbones and route helpers against brute force."""

import heapq
import itertools
import math
import random

import numpy as np
import pandas as pd
import plain_routes
import pytest

from wayloom.operators import matching, routes
from wayloom.operators.corridors import backbone, near_components
from wayloom.operators.graph import connected_components


def union_find(n, pairs):
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(n)]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(0, k) for k in range(1, 15)]
    vertices = spark.range(60).select("id")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(vertices, edges).collect()}
    assert [got[k] for k in range(60)] == union_find(60, pairs)


def test_components_without_edges(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    assert connected_components(spark.range(3).select("id"), edges).filter("id <> component").count() == 0


def test_decode_equals_exhaustive_search():
    rng = random.Random(11)
    for _ in range(30):
        steps = [[rng.randrange(100, 200) for _ in range(rng.randint(1, 3))] for _ in range(4)]
        steps = [list(dict.fromkeys(s)) for s in steps]
        emit = [[-rng.random() for _ in s] for s in steps]
        move = {(t, a, b): -rng.random() for t in range(1, 4) for a in steps[t - 1] for b in steps[t]}
        seq = np.array([t + 1 for t, s in enumerate(steps) for _ in s])
        node = np.array([n for s in steps for n in s])
        score = np.array([e for row in emit for e in row])
        keys = sorted(move)
        picks = matching.decode(
            seq, node, score, np.array([t + 1 for t, _, _ in keys]), np.array([a for _, a, _ in keys]), np.array([b for _, _, b in keys]), np.array([move[k] for k in keys])
        )

        def value(path):
            total = sum(emit[t][steps[t].index(n)] for t, n in enumerate(path))
            return total + sum(move[(t, path[t - 1], path[t])] for t in range(1, 4))

        best = max(itertools.product(*steps), key=value)
        assert value([node[k] for k in picks]) == pytest.approx(value(best))


def test_decode_survives_an_unreachable_step():
    empty = np.array([], dtype=int)
    picks = matching.decode(np.array([1, 2, 2]), np.array([5, 7, 8]), np.array([0.0, -1.0, -0.5]), empty, empty, empty, empty.astype(float))
    assert picks == [0, 1]


def test_routes_follow_one_way_streets(spark):
    def edge(uid, u, v, oneway, a, b):
        return (uid, uid, u, v, oneway, [{"lon": a[0], "lat": a[1]}, {"lon": b[0], "lat": b[1]}])

    p = {1: (116.0, 40.0), 2: (116.005, 40.0), 3: (116.005, 40.004), 4: (116.0, 40.004)}
    roads = spark.createDataFrame(
        [edge(1, 1, 2, "-1", p[1], p[2]), edge(2, 2, 3, None, p[2], p[3]), edge(3, 4, 3, "no", p[4], p[3]), edge(4, 1, 4, "TRUE", p[1], p[4])],
        "id long, edge_uid long, u long, v long, oneway string, coords array<struct<lon:double,lat:double>>",
    )
    pairs = spark.createDataFrame([(1, 2, *p[1], *p[2]), (2, 1, *p[2], *p[1])], "src long, dst long, src_lon double, src_lat double, dst_lon double, dst_lat double")
    ways = {(r["src"], r["dst"]): [w["node"] for w in r["way"]] for r in matching.route_pairs(pairs, matching.directed_edges(roads)).collect()}
    assert ways == {(1, 2): [1, 4, 3, 2], (2, 1): [2, 1]}


def segment(uid, a, b, score, start, end):
    return {"road_uid": uid, "from_node": a, "to_node": b, "score": float(score), "matched_segment_length_m": 100.0, "long": False, "p0": start, "p1": end, "q1": start, "q0": end}


def test_backbone_grows_both_ways_and_leaves_branches():
    at = lambda x, y=0.0: {"lon": 116.0 + x * 0.01, "lat": 40.0 + y * 0.01}
    part = pd.DataFrame(
        [segment(1, 1, 2, 5, at(0), at(1)), segment(2, 2, 3, 9, at(1), at(2)), segment(3, 3, 4, 4, at(2), at(3)), segment(4, 3, 5, 3, at(2), at(2, 1)), segment(5, 4, 6, 3, at(3), at(4))]
    )
    assert [part["road_uid"][k] for k in backbone(part)] == [1, 2, 3, 5]


def test_similar_sets_equal_all_pairs(spark):
    rng = random.Random(2)
    words = [chr(97 + k) for k in range(14)]
    sets = [sorted(rng.sample(words, rng.randint(1, 9))) for _ in range(40)]
    sets = [list(s) for s in dict.fromkeys(tuple(s) for s in sets)]
    df = spark.createDataFrame([(s, 1, n) for n, s in enumerate(sets)], "token_set array<string>, trips long, set_id long")
    got = {(r["src"], r["dst"]): round(r["similarity"], 9) for r in routes.similar_sets(df).collect()}
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        value = len(set(a) & set(b)) / len(set(a) | set(b))
        if value >= 0.42:
            want[(i, j)] = round(value, 9)
    assert got == want


def test_branch_split_conserves_members_and_separates_mixed_clusters():
    rows = [(["anchor:start:1", "anchor:end:9"], 100, 0), (["anchor:start:5", "anchor:end:6"], 40, 7), (["anchor:start:1", "anchor:end:8"], 5, 3), ([], 2, 9)]
    part = pd.DataFrame(rows, columns=["signature", "n", "first_trip"])
    assert routes.split_branches(part, 10, 3) == {("anchor:start:5", "anchor:end:6"): 1}
    assert routes.split_branches(part, 60, 3) == {}


def test_common_order_is_the_longest_common_subsequence():
    assert routes.common_order(tuple("abcd"), tuple("bxd")) == pytest.approx(2 / 3)
    assert routes.signature_similarity(tuple("ab"), tuple("ab")) == 1.0


def corridor(n, tokens, kind="cluster", parent="c1", score=1.0, safe=True):
    return {
        "row_order": n, "kind": kind, "split_mode": "jaccard_parent", "parent_cluster_id": parent, "representative": str(n), "trip_count": 10 - n,
        "base_score": score, "warnings": [], "is_safe": safe, "is_marginal": False, "is_diagnostic": False, "is_support": False,
        "signature": ">".join(tokens), "signature_array": tokens, "grid_lon": [float(n)], "grid_lat": [1.0], "min_lon": n, "min_lat": 0.0, "max_lon": n + 0.5, "max_lat": 1.0,
        "cluster_id": str(n), "cluster_rank": n,
    }


def test_top_routes_prefer_variety_and_fill_with_single_trips():
    rows = [corridor(0, ["a", "b"]), corridor(1, ["a", "b", "c"], score=0.95), corridor(2, ["x", "y"], parent="c2", score=0.9), corridor(3, ["q"], "single", "c3", 0.1, False)]
    rows[1].update(grid_lon=[0.0], min_lon=0, max_lon=0.5)
    picked = [n for n, _ in plain_routes.diverse_top(pd.DataFrame(rows), 2)]
    assert picked == [0, 2]
    filled = plain_routes.diverse_top(pd.DataFrame(rows), 4)
    assert (3, "single_trip_backfill") in filled and len(filled) == 4


def test_corridor_fold_joins_repeats():
    rows = [corridor(0, ["a", "b"]), corridor(1, ["a", "b"]), corridor(2, ["a", "b", "c"]), corridor(3, ["z"])]
    rows[2].update(grid_lon=[0.0], min_lon=0, max_lon=0.5)
    assert plain_routes.fold_corridors(pd.DataFrame(rows), 5) == [0, None, 0, 3]


def test_corridor_fold_keeps_late_clusters_and_repeats():
    rows = [corridor(n, [f"t{n}", "z"]) for n in range(60)] + [corridor(60, ["t59", "z"]), corridor(61, ["t50", "z", "more"])]
    rows[61].update(grid_lon=[50.0], min_lon=50, max_lon=50.5)
    part = pd.DataFrame(rows)
    assert plain_routes.fold_corridors(part, 5) == [*range(60), None, 50]
    assert plain_routes.corridor_members(part) == [*((str(n), str(n)) for n in range(60)), ("60", "59"), ("61", "50")]


def test_branch_split_finds_every_branch():
    rows = [([f"anchor:start:{n}", f"anchor:end:{n}"], 100 - n, n) for n in range(8)]
    part = pd.DataFrame(rows, columns=["signature", "n", "first_trip"])
    assert sorted(routes.split_branches(part, 10).values()) == list(range(1, 8))


def test_single_trips_compare_whole_signatures_at_any_rank(spark):
    same = [f"road:r{n}" for n in range(14)]
    tokens = {0: [*same, "road:x"], 1: [*same, "road:y"], 2: ["road:far"]}
    columns = "cluster_id string, rank int, trip_index long, taxi_id long, trip_id long, quality double, directness double, repeat_ratio double, fallback_rank int, coords array<double>, duration_seconds double, route_length_m double"
    scored = spark.createDataFrame([("c1", r, n, n, n, 0.9, 1.0, 0.0, r - 1, [], 60.0, 9.0) for n, r in ((0, 1), (1, 2), (2, 5000))], columns)
    order = spark.createDataFrame([("c1", 1, "c1")], "cluster_id string, cluster_rank int, parent_cluster_id string")
    trips = spark.createDataFrame(list(tokens.items()), "trip_index long, sequence_tokens array<string>")
    found = routes.single_trip_rows(scored, trips, order, spark.createDataFrame([(3,)], "valid_trips long"), 50)
    assert {r["trip_index"] for r in found.collect()} == {0, 1, 2}


def test_every_trip_of_a_cluster_can_represent_it(spark):
    rows = [("c1", n, 60.0, 900.0, ["a", "b"]) for n in range(1000)]
    members = spark.createDataFrame(rows, "cluster_id string, trip_index long, duration_seconds double, route_length_m double, token_set array<string>")
    assert routes.medoid_candidates(members).count() == 1000


def test_variants_of_a_corridor_are_all_reported(spark):
    rows = [("c1", n, 60.0, [f"road:r{n}"]) for n in range(12)]
    members = spark.createDataFrame(rows, "cluster_id string, taxi_id long, duration_seconds double, sequence_tokens array<string>")
    assert routes.variants(members).count() == 12 and routes.variants(members, keep=3).count() == 3


ROADS = "id long, edge_uid long, u long, v long, oneway string, coords array<struct<lon:double,lat:double>>"
PAIRS = "src long, dst long, src_lon double, src_lat double, dst_lon double, dst_lat double"


def town(rng, side, keep):
    """Streets of a grid, some missing, some one-way."""
    place = {i * side + j: (116.0 + 0.004 * i, 40.0 + 0.004 * j) for i in range(side) for j in range(side)}
    rows = []
    for a in place:
        i, j = divmod(a, side)
        for b in ([a + side] if i + 1 < side else []) + ([a + 1] if j + 1 < side else []):
            if rng.random() < keep:
                rows.append((len(rows), len(rows), a, b, rng.choice((None, None, "yes", "-1")), [dict(zip(("lon", "lat"), place[n], strict=True)) for n in (a, b)]))
    return place, rows


def plain_costs(links, start):
    cost = {start: 0.0}
    queue = [(0.0, start)]
    while queue:
        spent, node = heapq.heappop(queue)
        if spent > cost[node]:
            continue
        for other, weight in links.get(node, ()):
            if spent + weight < cost.get(other, float("inf")):
                cost[other] = spent + weight
                heapq.heappush(queue, (cost[other], other))
    return cost


def test_ways_are_the_shortest_of_the_whole_network(spark):
    rng = random.Random(9)
    place, rows = town(rng, 14, 0.8)
    links = matching.directed_edges(spark.createDataFrame(rows, ROADS))
    known = {}
    for r in links.collect():
        known.setdefault(r["src"], []).append((r["dst"], r["weight_m"]))
    wanted = [(rng.randrange(196), rng.randrange(196)) for _ in range(60)] + [(a, a + 1) for a in range(0, 190, 3)]
    pairs = spark.createDataFrame([(a, b, *place[a], *place[b]) for a, b in wanted], PAIRS)
    for options in ({}, {"padding_deg": 0.001}, {"widest_deg": 0.03}):
        got = {(r["src"], r["dst"]): r for r in matching.route_pairs(pairs, links, **options).collect()}
        for a, b in wanted:
            best = plain_costs(known, a).get(b)
            if a == b or best is None:
                assert (a, b) not in got
                continue
            assert got[a, b]["network_m"] == pytest.approx(best)
            way = [w["node"] for w in got[a, b]["way"]]
            assert way[0] == a and way[-1] == b
            assert sum(dict(known[x])[y] for x, y in itertools.pairwise(way)) == pytest.approx(best)


def test_detour_far_outside_the_pair_is_found(spark):
    far = [(116.0, 40.0), (116.02, 40.0), (116.02, 40.02), (116.001, 40.02), (116.001, 40.0)]
    rows = [(k, k, k, k + 1, "yes", [dict(zip(("lon", "lat"), p, strict=True)) for p in (far[k], far[k + 1])]) for k in range(4)]
    links = matching.directed_edges(spark.createDataFrame(rows, ROADS))
    got = matching.route_pairs(spark.createDataFrame([(0, 4, *far[0], *far[4])], PAIRS), links).collect()
    assert [w["node"] for w in got[0]["way"]] == [0, 1, 2, 3, 4]


def test_nearest_nodes_equal_all_distances(spark):
    rng = random.Random(4)
    nodes = [(n, 116.0 + rng.random(), 39.5 + rng.random()) for n in range(300)] + [(900, -70.0, -33.0)]
    points = [(1, n, 116.0 + 1.4 * rng.random(), 39.3 + 1.4 * rng.random()) for n in range(60)]
    points += [(2, n, lon, lat) for n, (lon, lat) in enumerate([(16.0, 40.0), (-179.9, 10.0), (179.9, -80.0), (116.5, 89.9), (-70.0, -33.0), (0.0, 0.0)])]
    n = spark.createDataFrame(nodes, "node long, node_lon double, node_lat double")
    p = spark.createDataFrame(points, "taxi_id long, seq long, lon double, lat double")
    for planar in (False, True):
        got = {(r["taxi_id"], r["seq"]): r for r in matching.nearest_node(p, n, ["taxi_id", "seq"], planar).collect()}
        assert len(got) == len(points)

        def away(lon, lat, x, y):
            if planar:
                return (lon - x) ** 2 + (lat - y) ** 2
            a, b = math.radians(lat), math.radians(y)
            h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(x - lon) / 2) ** 2
            return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, h)))

        for taxi, seq, lon, lat in points:
            best = min(nodes, key=lambda r: away(lon, lat, r[1], r[2]))
            assert got[taxi, seq]["d"] == pytest.approx(away(lon, lat, best[1], best[2]), rel=1e-6, abs=1e-6), (planar, lon, lat)


def test_parts_follow_whole_lines_not_vertices(spark):
    rng = random.Random(13)
    eps = 0.004

    def gap(a, b):
        def off(p, q, r):
            ux, uy = r[0] - q[0], r[1] - q[1]
            n = ux * ux + uy * uy
            t = max(0.0, min(1.0, ((p[0] - q[0]) * ux + (p[1] - q[1]) * uy) / n)) if n else 0.0
            return math.dist(p, (q[0] + t * ux, q[1] + t * uy))

        def side(p, q, r):
            return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

        best = math.inf
        for p, q in itertools.pairwise(a) if len(a) > 1 else [(a[0], a[0])]:
            for r, t in itertools.pairwise(b) if len(b) > 1 else [(b[0], b[0])]:
                if side(p, q, r) * side(p, q, t) < 0 and side(r, t, p) * side(r, t, q) < 0:
                    return 0.0
                best = min(best, off(p, r, t), off(q, r, t), off(r, p, q), off(t, p, q))
        return best

    lines = {}
    for uid in range(120):
        x, y = 116.0 + rng.random(), 40.0 + rng.random()
        lines[uid] = [(x, y)] + [(x + rng.uniform(-0.1, 0.1), y + rng.uniform(-0.1, 0.1)) for _ in range(rng.randrange(3))]
    lines[200], lines[201] = [(10.0, 10.0), (10.5, 10.5)], [(10.0, 10.5), (10.5, 10.0)]  # cross in mid-line
    group = {u: f"g{u % 3}" if u < 200 else "x" for u in lines}
    shape = "road_group_key string, road_uid long, coords array<struct<lon:double,lat:double>>"
    df = spark.createDataFrame([(group[u], u, [dict(zip(("lon", "lat"), p, strict=True)) for p in line]) for u, line in lines.items()], shape)
    got = {}
    for r in near_components(df, eps).collect():
        got.setdefault((r["road_group_key"], r["component_id"]), set()).add(r["road_uid"])
    pairs = [(a, b) for a, b in itertools.combinations(lines, 2) if group[a] == group[b] and gap(lines[a], lines[b]) <= eps]
    want = {}
    for u, root in enumerate(union_find(202, pairs)):
        if u in lines:
            want.setdefault(root, set()).add(u)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert {200, 201} in got.values()
