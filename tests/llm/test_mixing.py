from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wayloom.llm import mixing as op


def weights(spark):
    return spark.createDataFrame([(4, 2.0)], "doc_id long, weight double")


def targets(sizes, total):
    """Share by weight, stop at three times the size, share the rest again."""
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    out, open_sources, left = {}, set(sizes), float(total)
    while open_sources:
        level = left / sum(w[s] for s in open_sources)
        full = {s for s in open_sources if w[s] * level > 3 * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_sources}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_sources -= full
    return out


def check(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = targets(sizes, sum(sizes.values()))
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        epochs = int(r["target"] // r["source_size"]) if r["source_size"] else 0
        assert epochs * r["size"] <= r["taken"] <= min(3, epochs + 1) * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1


def test_targets_and_reruns(spark, sf_docs):
    first = op.mix(sf_docs, weights(spark)).drop("text").collect()
    again = op.mix(sf_docs.repartition(7), weights(spark)).drop("text").collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == sf_docs.count()
    check(first)


def test_hard_rows(spark, hard_docs):
    rows = op.mix(hard_docs, weights(spark)).collect()
    assert len(rows) == hard_docs.count() and "score" in rows[0].asDict()
    check(rows)
    short = op.mix(hard_docs.select("doc_id", "source", "text"), weights(spark)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in short)
    assert op.mix(hard_docs.limit(0), weights(spark)).count() == 0


def test_quality_raises_the_chance(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.when(F.col("id") < 3000, "b").otherwise("a").alias("source"), F.lit("en").alias("lang"))
    good = spark.range(0, 3000, 2).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    rows = op.mix(docs, op.quality_weights(good)).filter("source = 'b'").collect()
    even = sum(r["taken"] for r in rows if r["doc_id"] % 2 == 0)
    assert sum(r["taken"] for r in rows) < 3000
    assert even > 1.3 * sum(r["taken"] for r in rows if r["doc_id"] % 2)


def test_columns_pass_and_rows_without_id_differ(spark):
    rows = [(None, f"{i} " * (1 + i % 3), "a", 7, True, "s", 3, 4, {"k": i}) for i in range(400)] + [(5, "x y", None, 8, False, "t", 5, 6, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int, _no boolean, _source string, key int, id int, row map<string,int>")
    got = op.mix(docs, weights(spark))
    assert got.columns == [*docs.columns, *op.RESULTS]
    out = got.collect()
    check(out)
    assert sorted(str(tuple(r)[:9]) for r in out) == sorted(map(str, rows))
    keys = docs.filter("doc_id is null").select(op.uniform(F.col("doc_id"), F.xxhash64("text"))).distinct().count()
    assert keys == 400
