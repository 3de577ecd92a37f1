"""Centroid clustering: Lloyd rounds whose assignment step is a Walsh-Hadamard progressive search.

Vectors and centroids are integers. Their Walsh-Hadamard transforms are integers, too, and keep distances up to the
factor ``DIM``: the squared distance of two transforms is ``DIM`` times that of the vectors. Coefficients are ordered by
sequency, coarse to fine, and differences are accumulated over 1, 2, 4, ... of them. After each step a centroid is
eliminated when it is strictly worse than one whose distance is known: when its accumulated part, plus the least that the
rest can add by the norms of both rests (whole numbers, rounded to the safe side), exceeds it. What survives is finished
over all coefficients, and the smallest number wins ties, so the result equals the plain search.

The transform is made once and kept as a table; each round is one pass over it. Tasks send one row of exact sums per
centroid, a round's result is ``k`` rows on the driver. Centroids (at most ``k`` vectors) are all that is broadcast.

Defined results: rows whose vector is null, has not ``DIM`` components, or holds a null or non-finite one are left out, and
so are vectors with an integer of more than ``LARGEST`` (components of 65,536 and more), for which sums could leave
64 bits. A null id hashes like an empty one; rows that repeat an id count each, and are ordered by their vector as first
centroids; fewer rows than ``k`` give as many centroids; equal centroids are told apart by their number (the later ones
stay as they are); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import drop_tables, keep_table

DIM = 64
K = 40
ROUNDS = 5
SCALE = 256
SEED = 2
LARGEST = 1 << 24
ROWS_AT_ONCE = 4096
#: Numbers of coefficients after which centroids are eliminated.
STEPS = (1, 2, 4, 8, 16, 32, DIM)


def sequency_order() -> np.ndarray:
    """Places of the transform's coefficients by their number of sign changes: entry i is where the i-th coarsest stands."""
    signs = hadamard(np.eye(DIM, dtype=np.int64))
    return np.argsort((np.diff(signs, axis=0) != 0).sum(axis=0), kind="stable")


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Exact integer Walsh-Hadamard transform of every row, in natural order; applied twice it multiplies by ``DIM``."""
    out = rows.astype(np.int64)
    half = 1
    while half < DIM:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), DIM)
        half *= 2
    return out


ORDER = sequency_order()


def transform(vectors: np.ndarray) -> np.ndarray:
    """Coefficients, coarse to fine."""
    return hadamard(vectors)[:, ORDER]


def restore(coefficients: np.ndarray) -> np.ndarray:
    """The vectors of coefficients; exact, also for sums of them."""
    natural = np.empty_like(coefficients)
    natural[:, ORDER] = coefficients
    return hadamard(natural) // DIM


def _rest_norms(coefficients: np.ndarray) -> np.ndarray:
    """Norm of what is left after each of ``STEPS``, rounded down to whole numbers (by less than two, as a float may err)."""
    energy = coefficients * coefficients
    total = energy.sum(axis=1)
    done = np.cumsum(energy, axis=1)
    return np.stack([np.floor(np.sqrt(total - done[:, s - 1])).astype(np.int64) for s in STEPS], axis=1)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (smallest number on ties) and squared distance of vectors, all given as coefficients."""
    n, k = len(rows), len(centroids)
    row_rests, centroid_rests = _rest_norms(rows), _rest_norms(centroids)
    who = np.repeat(np.arange(n), k)  # open pairs of a row and a centroid, by row, then by number
    which = np.tile(np.arange(k), n)
    part = np.zeros(n * k, np.int64)
    known: np.ndarray | None = None
    start = 0
    for step, stop in enumerate(STEPS):
        gap = rows[who, start:stop] - centroids[which, start:stop]
        part += np.einsum("ij,ij->i", gap, gap)
        start = stop
        if stop == DIM:
            break
        # Two units of slack for both roundings.
        slack = np.maximum(np.abs(row_rests[who, step] - centroid_rests[which, step]) - 2, 0)
        least = part + slack * slack
        if stop < 4:
            continue
        if known is None:
            # The most promising centroid of each row is finished at once: its distance is the one to beat.
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            low = np.minimum.reduceat(least, first)
            hits = np.flatnonzero(least == low[who])
            chosen = hits[np.concatenate([[True], who[hits][1:] != who[hits][:-1]])]
            gap = rows - centroids[which[chosen]]
            known = np.einsum("ij,ij->i", gap, gap)
        keep = least <= known[who]
        who, which, part = who[keep], which[keep], part[keep]
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    low = np.minimum.reduceat(part, first)
    hits = np.flatnonzero(part == low[who])
    chosen = hits[np.concatenate([[True], who[hits][1:] != who[hits][:-1]])]
    return which[chosen].astype(np.int32), part[chosen] // DIM


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, whole): the kept vectors as arrays of ``DIM`` integers."""
    doubles = F.transform(F.col(vec_col), lambda x: x.cast("double") * SCALE)
    fits = F.forall("d", lambda x: F.coalesce((x >= -LARGEST) & (x < LARGEST + 1), F.lit(False)))
    kept = vectors.select(F.col(id_col), doubles.alias("d")).filter((F.size("d") == DIM) & fits)
    return kept.select(id_col, F.transform("d", lambda x: F.floor(x).cast("int")).alias("whole"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIM)


def _transformed(vectors: DataFrame, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = transform(_matrix(batch.column(1))).astype(np.int32).ravel()
            offsets = np.arange(0, len(flat) + 1, DIM, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], [id_col, "coefficients"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.mapInArrow(run, f"`{id_col}` {kind}, coefficients array<int>")


def _blocks(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            yield part, _matrix(part.column(place))


def _round(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Coefficients of the next centroids."""
    shared = table.sparkSession.sparkContext.broadcast(centroids)
    sums = [f"s{i}" for i in range(DIM)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        total, count = np.zeros((len(now), DIM), np.int64), np.zeros(len(now), np.int64)
        for _, rows in _blocks(batches, 0):
            cluster, _ = nearest(rows, now)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            total[found] += np.add.reduceat(rows[order], first, axis=0)
            count += np.bincount(cluster, minlength=len(now))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(DIM))], ["cluster", "n", *sums])

    partial = table.select("coefficients").mapInArrow(add, "cluster int, n long, " + ", ".join(f"{s} long" for s in sums))
    moved = restore(centroids)
    for row in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums)).collect():  # at most k rows
        moved[row["cluster"]] = restore(np.array([[row[s] for s in sums]], np.int64))[0] // row["n"]
    return transform(moved)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per kept vector: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid."""
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, id_col, vec_col)
    # The order of the seeds is that of hash, id and vector: k rows on the driver.
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    seeds = whole.select(name.alias("name"), F.col(id_col), "whole").orderBy("name", id_col, "whole").limit(k).select("whole").collect()
    result = f"`{id_col}` {whole.schema[id_col].dataType.simpleString()}, cluster int, distance long"
    if not seeds:
        empty = spark.createDataFrame([], result)
        return empty.selectExpr("*", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256", "array(0L) AS centroid")
    table = keep_table(_transformed(whole, id_col))
    centroids = transform(np.array([row["whole"] for row in seeds], np.int64))
    for _ in range(rounds):
        centroids = _round(table, centroids)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _blocks(batches, 1):
            cluster, distance = nearest(rows, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], [id_col, "cluster", "distance"])

    assigned = keep_table(table.mapInArrow(assign, result))
    drop_tables(table)
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    final = restore(centroids).tolist()
    facts = [
        (c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, final[c])).encode()).hexdigest(), final[c]) for c in range(len(final))
    ]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return assigned.join(F.broadcast(about), "cluster").select(  # at most k rows
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )


def _oracle() -> str:
    parts = [
        """kept AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, v FROM (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64))""",
        "x AS (SELECT r, unnest(range(64)) AS i, unnest(v) AS v FROM kept)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, vec_id, v FROM kept) ORDER BY h, vec_id, v LIMIT {K})",
        "m0 AS (SELECT c, unnest(range(64)) AS i, unnest(v) AS v FROM c0)",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"d{n} AS (SELECT r, c, sum((x.v - m{n}.v) * (x.v - m{n}.v))::BIGINT AS d FROM x JOIN m{n} USING (i) GROUP BY r, c)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min((d, c))[1] AS d, min((d, c))[2] AS c FROM d{n} GROUP BY r)")
        if n < ROUNDS:
            parts.append(f"s{n} AS (SELECT c, i, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{n} USING (r) GROUP BY c, i)")
            parts.append(
                f"m{n + 1} AS MATERIALIZED (SELECT m{n}.c, m{n}.i, CASE WHEN s IS NULL THEN m{n}.v ELSE (s - ((s % n) + n) % n) // n END AS v FROM m{n} LEFT JOIN s{n} USING (c, i))"
            )
    body = ",\n".join(parts)
    return f"""
WITH {body},
h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS sha FROM m{ROUNDS} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN h USING (c)
"""


ORACLE = _oracle()
