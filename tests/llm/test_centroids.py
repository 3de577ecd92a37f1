import hashlib
import math

import numpy as np
from wayloom.llm import centroids as op

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def brute(rows, k, rounds):
    """Plain Lloyd rounds in whole numbers."""
    kept = []
    for key, vec in rows:
        if vec is None or len(vec) != 64 or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept.append((key, [math.floor(256 * float(np.float32(x))) for x in vec]))
    name = lambda key: hashlib.sha256(f"2:{'' if key is None else key}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[0] is not None, r[0] or 0, r[1]))[:k]]

    def assign(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        members = [assign(v)[0] for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), m in zip(kept, members, strict=True) if m == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(key, *assign(v)) for key, v in kept]
    total = sum(d for _, _, d in last)
    sums = {c: sum(d for _, m, d in last if m == c) for c in range(len(centres))}
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(str((key, c, d, sums[c], total, prints[c])) for key, c, d in last)


def found(df, **kw):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(str(tuple(r[n] for n in names)) for r in op.cluster_vectors(df, **kw).collect())


def test_clusters_match_plain_rounds(spark):
    rng = np.random.default_rng(5)
    vecs = np.concatenate([rng.normal(c, 0.2, (30, 64)) for c in (-0.5, 0.0, 0.4)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    bad = [(200, None), (201, [1.0] * 63), (202, [math.nan] + [0.0] * 63), (203, [math.inf] + [0.0] * 63), (204, [None] + [0.0] * 63), (205, [1e9] + [0.0] * 63)]
    ties = [(300 + i, [0.25] * 64) for i in range(20)] + [(None, [0.5] * 64), (7, [0.125] * 64), (7, [0.125] * 64)]
    df = spark.createDataFrame([(*r, "extra") for r in rows + bad + ties], SCHEMA).repartition(5)
    want = brute([r for r in rows + bad + ties if r[0] != 205], 6, 3)
    assert found(df, k=6, rounds=3) == want


def test_few_rows_and_empty(spark):
    rows = [(i, [0.1 * i] * 64) for i in range(3)]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert found(df) == brute(rows, 40, 5)
    assert op.cluster_vectors(df.limit(0)).collect() == []


def test_progressive_search_is_exact():
    rng = np.random.default_rng(1)
    for scale in (3, 300, op.LARGEST):
        rows, centres = rng.integers(-scale, scale, (300, 64)), rng.integers(-scale, scale, (9, 64))
        rows[:9], centres[4] = centres, centres[2]
        d = ((rows[:, None].astype(object) - centres[None].astype(object)) ** 2).sum(2)
        cluster, distance = op.nearest(op.transform(rows), op.transform(centres))
        assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert (op.restore(op.transform(rows)) == rows).all()
