"""Reading, writing and merging."""

from pyspark.sql import functions as F

from wayloom.operators import cleaning
from wayloom.sources import logs, tables


def test_csv_log_round_trip(spark, tmp_path):
    (tmp_path / "1.txt").write_text("1,2008-02-02 10:00:00,116.4,39.9\n1,broken,116.4,39.9\n")
    (tmp_path / "2.txt").write_text("2,2008-02-02 10:00:00,,39.9\n2,2008-02-02 10:01:00,116.5,39.9\n")
    raw = logs.read_raw_log(spark, str(tmp_path))
    assert raw.count() == 4 and logs.read_raw_log(spark, str(tmp_path), [2]).count() == 2
    clean = cleaning.clean_log(raw)
    assert sorted((r["taxi_id"], r["lon"]) for r in clean.collect()) == [(1, 116.4), (2, 116.5)]
    out = str(tmp_path / "points")
    tables.write_points(tables.number_points(clean), out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, 5, 5, 1), (2, 7, 7, 1)], "k int, lo int, hi int, n int")
    new = spark.createDataFrame([(1, 3, 9, 2)], "k int, lo int, hi int, n int")
    rows = tables.merge_rows(old, new, ["k"], {"lo": "min", "hi": "max", "n": "new"}).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, 3, 9, 2), (2, 7, 7, 1)]
    assert tables.not_done(old, new, ["k"]).count() == 1


def test_partition_overwrite_keeps_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "v int, day string")
    tables.overwrite_partitions(one, path, ["day"])
    tables.overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, day string"), path, ["day"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 9]


def test_oneway_spellings_and_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(m,) for m in ["Yes", "1", "T", "reverse", "-1", "no", None]], "m string")
    got = [r[0] for r in df.select(tables.oneway_mode(F.col("m"))).collect()]
    assert got == ["forward"] * 3 + ["reverse"] * 2 + ["both"] * 2
    tables.write_csv(df.withColumn("a", F.array(F.lit(1))), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 7


def test_markdown_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_text("﻿# T\nbody", encoding="utf-8")
    (tmp_path / "d" / "y.txt").write_text("no")
    rows = logs.read_markdown(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["content"].startswith("# T")
