"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every source has a token budget (its *target*): all words are shared out by source weight, no target exceeds
``max_epochs`` times its source's size, and the excess is reshared by weight. A source first gives its complete
epochs; the rest of its budget is filled by a weighted sample without replacement: each document draws an exponential
key with its quality weight as rate, documents are taken in key order, and a prefix sum of their sizes says how many
words of each still fit, so that the last document is taken in part.

The prefix sum needs no task that holds a source. Keys are mapped to (0, 1) by a fixed distribution function that
spreads them evenly, cut into about sqrt(rows) buckets a source, summed per bucket, and only the bucket sums are
accumulated over a source; rows are accumulated inside their bucket. A hot source thus becomes many small groups.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; rows that
repeat a doc_id draw the same key and are ordered by size, so equal rows are interchangeable; rows without an id draw
their key from their text; columns of any name pass through, but for those of the four results, which are replaced; an
empty table gives an empty result. The key depends on id (or text) and seed alone: reruns agree, whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.llm.common import packed, table, unpacked

SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
QUALITY_LOW, QUALITY_NONE, QUALITY_HIGH = 0.5, 1.0, 2.0
SEED = "mix"
RESULTS = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def uniform(doc_id: Column, code: Column) -> Column:
    """Number strictly between 0 and 1 from the md5 of seed and id, or of the text's code without id: 52 bits, the same in any engine."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), code.cast("string")))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): labelled good 2, labelled bad 0.5; a document without label weighs 1."""
    best = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).filter("doc_id is not null and q is not null")
    return best.select("doc_id", F.when(F.col("q") >= 1, QUALITY_HIGH).otherwise(QUALITY_LOW).alias("weight"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(no_source, source, source_size, target) of (no_source, source, source_size): one row per source.

    Water-filling in closed form: ordered by the level at which a source is full, sources are full as long as the
    level left to the others, (words left) / (weights left), is not below their own.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy("no_source", "source")
    ranked = sizes.withColumn("nth", (F.row_number().over(by_name) - 1) % len(SOURCE_WEIGHTS)).withColumn(
        "w", F.element_at(F.array(*map(F.lit, SOURCE_WEIGHTS)), (F.col("nth") + 1).cast("int"))
    )
    full_at = ranked.withColumn("cap", F.col("source_size") * float(MAX_EPOCHS)).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", "no_source", "source")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        full_at.withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("w").over(onward))
        .withColumn("level", F.min(F.when(F.col("level") < F.col("full_at"), F.struct(F.col("full_at"), F.col("no_source"), F.col("source"), F.col("level")))).over(every)["level"])
    )
    target = F.when(F.col("level").isNull() | (F.col("full_at") <= F.col("level")), F.col("cap")).otherwise(F.col("w") * F.col("level"))
    return levels.select("no_source", "source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``docs`` with size, source_size, target and taken in place of columns of these names.

    ``weights`` (doc_id, weight) holds at most one row per id; weights are held between 0.5 and 2, the range for
    which the buckets are even.
    """
    rows = docs.drop(*RESULTS)
    # Without an id the code of the text stands in; with one it is 0, so that rows of one id stay together.
    code = F.when(F.col("doc_id").isNull(), F.coalesce(F.xxhash64("text"), F.lit(0))).otherwise(F.lit(0))
    facts = [
        F.col("doc_id").alias("id"), code.alias("code"), F.col("source").isNull().alias("no"), F.coalesce(F.col("source"), F.lit("")).alias("source"),
        word_count(F.col("text")).alias("size"),
    ]
    who = ["id", "code", "no", "source", "size"]
    buckets = max(1, math.isqrt(docs.count()))
    light = (
        rows.select(*facts)
        .join(weights.select(F.col("doc_id").alias("id"), F.col("weight").alias("w")), "id", "left")
        .withColumn("w", F.least(F.greatest(F.coalesce("w", F.lit(QUALITY_NONE)), F.lit(QUALITY_LOW)), F.lit(QUALITY_HIGH)))
        .withColumn("key", -F.log(uniform(F.col("id"), F.col("code"))) / F.col("w"))
        .withColumn("spread", 1 - (F.exp(-F.col("key") / 2) + F.exp(-F.col("key")) + F.exp(-F.col("key") * 2)) / 3)
        .withColumn("bucket", F.least(F.floor(F.col("spread") * buckets), F.lit(buckets - 1)).cast("long"))
    )
    sums = light.groupBy("no", "source", "bucket").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("no", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    targets = source_targets(
        sums.groupBy("no", "source").agg(F.sum("sum").alias("source_size")).select(F.col("no").alias("no_source"), "source", "source_size")
    ).withColumnRenamed("no_source", "no")
    inside = Window.partitionBy("no", "source", "bucket").orderBy("key", "id", "code", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        light.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["no", "source", "bucket"])
        .join(targets, ["no", "source"])
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("before"))))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    )
    if set(rows.columns) <= {"doc_id", "source", "text"}:
        return placed.select(F.col("id").alias("doc_id"), *RESULTS)
    # Full rows: rows of equal id (or text), source and size share one figure, so the join loses and adds nothing.
    share = placed.groupBy(*who).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.collect_list("taken").alias("all"))
    nth = Window.partitionBy(*who).orderBy(F.xxhash64("row.text"))
    full = rows.select(packed(rows).alias("row"), *facts).withColumn("nth", F.row_number().over(nth)).alias("f")
    share = share.alias("s")
    same = F.col("f.id").eqNullSafe(F.col("s.id"))
    for name in who[1:]:
        same = same & (F.col(f"f.{name}") == F.col(f"s.{name}"))
    return full.join(share, same).select(
        *unpacked(rows, "f.row"), F.col("f.size").alias("size"), "source_size", "target", F.element_at(F.sort_array("all", False), F.col("nth")).alias("taken")
    )


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, quality_weights(table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS nos, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT nos, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY nos, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s0),
s2 AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS full_at FROM s1),
s3 AS (SELECT *, ((SELECT sum(source_size) FROM s0)::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY full_at, nos, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY full_at, nos, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT nos, source, source_size, w, cap, full_at,
    (SELECT level FROM s3 WHERE level < full_at ORDER BY full_at, nos, source LIMIT 1) AS level FROM s3),
s5 AS (SELECT nos, source, source_size, CASE WHEN level IS NULL OR full_at <= level THEN cap ELSE w * level END AS target FROM s4),
q AS (SELECT doc_id, CASE WHEN max(quality) >= 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS qw FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, source_size, target, -ln((CAST('0x' || substr(md5('mix:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE + 0.5)
    / 4503599627370496.0::DOUBLE) / coalesce(qw, 1.0) AS key FROM d JOIN s5 USING (nos, source) LEFT JOIN q ON q.doc_id = d.doc_id),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY nos, source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM p
"""
