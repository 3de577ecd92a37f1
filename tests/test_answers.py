"""Folding and picking for many requests at once against the rules applied row after row."""

import random

import pandas as pd
import plain_routes
from wayloom.operators import answers
from wayloom.operators.sequence import bucket_pairs, numbered
from pyspark.sql import functions as F

ROW = """query_id int, cluster_id string, cluster_rank int, row_id string, row_order long, kind string, split_mode string, parent_cluster_id string, representative string,
trip_count long, base_score double, warnings array<string>, is_safe boolean, is_marginal boolean, is_diagnostic boolean, is_support boolean, signature string,
signature_array array<string>, grid_lon array<double>, grid_lat array<double>, min_lon double, min_lat double, max_lon double, max_lat double"""
NAMES = [part.split()[0] for part in ROW.replace("\n", " ").split(", ")]


def corridor(q, n, tokens, cells, *, kind="cluster", mode="jaccard_parent", parent="p0", trips=1, score=1.0, flags=(True, False, False, False), warnings=()):
    lon, lat = [float(x) for x, _ in cells], [float(y) for _, y in cells]
    box = (min(lon), min(lat), max(lon) + 1.0, max(lat) + 1.0) if cells else (0.0, 0.0, 1.0, 1.0)
    return (q, f"c{n}", n, f"{kind}{n}", n, kind, mode, parent, f"trip{n}", trips, score, list(warnings), *flags, " > ".join(tokens), tokens, lon, lat, *box)


def random_request(rng, q, n):
    themes = [[f"t{rng.randrange(30)}" for _ in range(rng.randrange(2, 9))] for _ in range(max(1, n // 4))]
    rows = []
    for k in range(n):
        tokens = list(rng.choice(themes))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            tokens[rng.randrange(len(tokens))] = f"t{rng.randrange(30)}"
        start = rng.randrange(6)
        cells = [(start + i, rng.randrange(2)) for i in range(rng.randrange(1, 6))]
        flags = [rng.random() < p for p in (0.25, 0.3, 0.4, 0.4)] if q % 3 else [False, rng.random() < 0.5, True, True]
        mode = rng.choice(("jaccard_parent", "jaccard_parent", "jaccard_parent", "anchor_branch_variant", "anchor_default_mainline"))
        kind = "single" if rng.random() < 0.3 else "cluster"
        score = rng.choice((0.0, 0.5, 0.8, round(rng.random(), 2), round(rng.random(), 2)))
        rows.append(
            corridor(q, k, tokens, cells, kind=kind, mode=mode, parent=f"p{rng.randrange(3)}", trips=rng.randrange(1, 6), score=score,
                     flags=flags if kind == "cluster" else [False] * 4, warnings=["w"] if rng.random() < 0.3 else [])
        )
    return rows


def test_fold_matches_the_rules_row_by_row(spark):
    rng = random.Random(7)
    rows = [r for q in range(12) for r in random_request(rng, q, 5 + 5 * q)]
    got = {(r["query_id"], r["cluster_id"]): r["corridor_id"] for r in answers.merge_corridors(spark.createDataFrame(rows, ROW)).collect()}
    want = {}
    for q, part in pd.DataFrame(rows, columns=NAMES).groupby("query_id"):
        want |= {(q, c): k for c, k in plain_routes.corridor_members(part.sort_values("cluster_rank").reset_index(drop=True))}
    assert got == want and len({k for k in want.values()}) < len(want)


def test_fold_of_equal_signatures_and_empty_tables(spark):
    rows = [corridor(1, n, ["a", "b"], [(0, 0)]) for n in range(40)] + [corridor(2, n, [], []) for n in range(3)] + [corridor(2, 9, ["a", "b"], [(0, 0)], mode="anchor_branch_variant")]
    df = spark.createDataFrame(rows, ROW)
    got = {(r["query_id"], r["cluster_id"]): r["corridor_id"] for r in answers.merge_corridors(df).collect()}
    assert got == {**{(1, f"c{n}"): "c0" for n in range(40)}, **{(2, f"c{n}"): "c0" for n in range(3)}, (2, "c9"): "c9"}
    assert answers.merge_corridors(df.limit(0)).collect() == [] == answers.pick_routes(df.limit(0), 5).collect()


def test_pick_matches_the_rules_row_by_row(spark):
    rng = random.Random(11)
    rows = [r for q in range(40) for r in random_request(rng, q, rng.randrange(1, 40))]
    # Single trips come with a signature and a trip of their own.
    seen = set()
    rows = [r for r in rows if r[5] == "cluster" or not ((r[0], r[16]) in seen or seen.add((r[0], r[16])))]
    df = spark.createDataFrame(rows, ROW)
    table = pd.DataFrame(rows, columns=NAMES)
    for top_k in (1, 4, 9):
        want = set()
        for q, part in table.groupby("query_id"):
            part = part.sort_values("row_order").reset_index(drop=True)
            want |= {(q, part["row_id"].iat[n], rank, tier) for rank, (n, tier) in enumerate(plain_routes.diverse_top(part, top_k), start=1)}
        assert {tuple(r) for r in answers.pick_routes(df, top_k).collect()} == want


def test_many_routes_of_one_parent_wait(spark):
    rows = [corridor(1, n, [f"t{n}"], [(10 * n, 0)], parent="p1", score=1.0 - n / 100) for n in range(12)] + [corridor(1, 20 + n, [f"u{n}"], [(500 + 10 * n, 0)], parent="p2", score=0.9 - n / 100) for n in range(2)]
    part = pd.DataFrame(rows, columns=NAMES)
    for top_k in (5, 8):
        want = [part["row_id"].iat[n] for n, _ in plain_routes.diverse_top(part, top_k)]
        got = answers.pick_routes(spark.createDataFrame(rows, ROW), top_k).orderBy("route_rank").collect()
        assert [r["row_id"] for r in got] == want


def test_bucket_pairs_make_each_pair_once_in_small_groups(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 250, "hot").otherwise("cold").alias("key"), "id")
    got = bucket_pairs(rows, ["key"], "id", F.col("a.id") < F.col("b.id"), tile=32).select(F.col("a.id"), F.col("b.id"), F.col("a._low"), F.col("a._high"))
    pairs = [(r[0], r[1]) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) == 250 * 249 // 2 + 50 * 49 // 2
    sizes = [r["count"] for r in got.groupBy("_low", "_high").count().collect()]
    assert max(sizes) < 5000


def test_numbers_follow_the_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice((None, rng.randrange(50))), n) for n in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = sorted((r["place"], r["a"], r["b"]) for r in numbered(df, ["a", "b"], "place").collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(n, *r) for n, r in enumerate(want, start=1)]
    assert numbered(df.limit(0), ["a"], "place").count() == 0
