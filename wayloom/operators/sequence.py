"""Ordered operations along a track that never put one track into one task.

A plain ``lag`` over a vehicle ships all of its points to a single task, which fails
when one vehicle holds a large share of the data. Here a track is cut into fixed time
chunks. Rows are windowed inside (key, chunk); what crosses a chunk border is carried by
one summary row per chunk, and only these summaries are windowed over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.session import cut_lineage

CHUNK = "_chunk"
CHUNK_SECONDS = 6 * 3600
LONGEST_PLAIN_TRACK = 1_000_000


def chunking(points: DataFrame, keys: Sequence[str], limit: int = LONGEST_PLAIN_TRACK) -> int | None:
    """Chunk length for tracks of a table: none when the longest track is known to be short.

    One count per key decides. On a table bucketed by the key it needs no shuffle, and
    short tracks then use plain windows on the same bucketing. The answer also holds for
    any subset of the points.
    """
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n"))
    longest = sizes.agg(F.max("n").alias("n")).first()["n"]
    return None if (longest or 0) <= limit else CHUNK_SECONDS


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def chunk_of(time: Column, seconds: int = CHUNK_SECONDS) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def _renames(names: Sequence[str]) -> dict[str, str]:
    return {n: f"_of_{n}" for n in names}


def _renamed(names: Sequence[str]) -> list[str]:
    return list(_renames(names).values())


def _same(right: DataFrame, names: Sequence[str]) -> Column:
    """Equality of the keys with nulls being equal, as windows see them."""
    condition = F.lit(True)
    for name, other in _renames(names).items():
        condition = condition & F.col(name).eqNullSafe(right[other])
    return condition


def _fields(names: Sequence[str]) -> Column:
    return F.struct(*names)


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    out: str,
    time: str,
    step: int = -1,
    chunk_seconds: int | None = CHUNK_SECONDS,
) -> DataFrame:
    """Add struct ``out`` holding ``fields`` of the previous (or next) row of the key.

    ``order`` must start with ``time`` so that chunks are contiguous in the order.
    Without ``chunk_seconds`` (see :func:`chunking`) a plain window is used.
    """
    if order[0] != time:
        raise ValueError("the order must begin with the chunked time")
    if chunk_seconds is None:
        move = F.lag if step < 0 else F.lead
        return df.withColumn(out, move(_fields(fields)).over(Window.partitionBy(*keys).orderBy(*order)))
    chunked = df.withColumn(CHUNK, chunk_of(F.col(time), chunk_seconds))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    shift, edge = (F.lag, F.max_by) if step < 0 else (F.lead, F.min_by)
    borders = (
        chunked.groupBy(*keys, CHUNK)
        .agg(edge(_fields(fields), F.struct(*order)).alias("_edge"))
        .select(*keys, CHUNK, shift("_edge").over(across).alias("_across"))
        .filter(F.col("_across").isNotNull())
        .withColumnsRenamed(_renames([*keys, CHUNK]))
    )
    return (
        chunked.withColumn("_inside", shift(_fields(fields)).over(inside))
        .join(borders, _same(borders, [*keys, CHUNK]), "left")
        .withColumn(out, F.coalesce("_inside", "_across"))
        .drop("_inside", "_across", CHUNK, *_renamed([*keys, CHUNK]))
    )


def previous_where(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    out: str,
    time: str,
    where: Column,
    chunk_seconds: int | None = CHUNK_SECONDS,
) -> DataFrame:
    """Add struct ``out`` holding ``fields`` of the last earlier row of the key for which ``where`` holds."""
    if order[0] != time:
        raise ValueError("the order must begin with the chunked time")
    earlier = (Window.unboundedPreceding, -1)
    taken = F.when(where, _fields(fields))
    if chunk_seconds is None:
        return df.withColumn(out, F.last(taken, True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*earlier)))
    chunked = df.withColumn("_taken", taken).withColumn(CHUNK, chunk_of(F.col(time), chunk_seconds))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(*earlier)
    across = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(*earlier)
    borders = (
        chunked.groupBy(*keys, CHUNK)
        .agg(F.max(F.when(F.col("_taken").isNotNull(), F.struct(F.struct(*order).alias("at"), F.col("_taken").alias("row")))).alias("_edge"))
        .select(*keys, CHUNK, F.last("_edge", True).over(across)["row"].alias("_across"))
        .filter(F.col("_across").isNotNull())
        .withColumnsRenamed(_renames([*keys, CHUNK]))
    )
    return (
        chunked.withColumn("_inside", F.last("_taken", True).over(inside))
        .join(borders, _same(borders, [*keys, CHUNK]), "left")
        .withColumn(out, F.coalesce("_inside", "_across"))
        .drop("_taken", "_inside", "_across", CHUNK, *_renamed([*keys, CHUNK]))
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    time: str,
    chunk_seconds: int | None = CHUNK_SECONDS,
) -> DataFrame:
    """Running total of ``value`` along a key, current row included."""
    if order[0] != time:
        raise ValueError("the order must begin with the chunked time")
    if chunk_seconds is None:
        plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(plain))
    chunked = df.withColumn("_value", value).withColumn(CHUNK, chunk_of(F.col(time), chunk_seconds))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, CHUNK)
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, CHUNK, F.sum("_total").over(before).alias("_before"))
        .filter(F.col("_before").isNotNull())
        .withColumnsRenamed(_renames([*keys, CHUNK]))
    )
    return (
        chunked.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, _same(offsets, [*keys, CHUNK]), "left")
        .withColumn(out, F.col("_inside") + F.coalesce("_before", F.lit(0)))
        .drop("_value", "_inside", "_before", CHUNK, *_renamed([*keys, CHUNK]))
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    time: str,
    chunk_seconds: int | None = CHUNK_SECONDS,
) -> DataFrame:
    """1-based position of each row along its key."""
    return running_sum(df, keys, order, F.lit(1), out, time, chunk_seconds)


def running_total(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before them in ascending order of the columns ``order``.

    Rows are dealt out by ranges and summed inside them; only the ranges' sums are added up in one task. Rows that
    agree in ``order`` come in any order among themselves. The dealt rows are checkpointed, as their places must not
    change when a part is computed again.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    dealt = cut_lineage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    placed = dealt.withColumn("_part", F.shiftright("_at", 33))
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    total = (F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias(name)
    return placed.join(F.broadcast(starts), "_part").select(*rows.columns, total)  # one row per range


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their place (from 1) in ascending order of the columns ``order``, see :func:`running_total`."""
    return running_total(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).drop("_one").withColumn(name, F.col(name) + 1)


def bucket_pairs(rows: DataFrame, keys: Sequence[str], identity: str, wanted: Column, tile: int = 512) -> DataFrame:
    """Pairs (aliases a and b) of rows with equal ``keys`` that meet ``wanted``, in tiles of about ``tile`` × ``tile`` pairs.

    A bucket of m rows is cut into m / tile parts by a hash of ``identity``; every pair of parts is a group of its own, so that one
    key that all rows share is spread over as many tasks as its pairs need.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_m")).filter("_m > 1").select(*keys, F.ceil(F.col("_m") / tile).cast("int").alias("_parts"))
    placed = rows.join(counts, list(keys)).withColumn("_part", F.pmod(F.xxhash64(identity), F.col("_parts")).cast("int"))
    spread = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_low", F.least("_part", "_other")).withColumn(
        "_high", F.greatest("_part", "_other")
    )
    group = [*keys, "_low", "_high"]
    a, b = spread.alias("a"), spread.alias("b")
    same = F.lit(True)
    for column in group:
        same = same & (F.col(f"a.{column}") == F.col(f"b.{column}"))
    # A pair of one part is made in that part's own group only.
    once = (F.col("a._low") == F.col("a._high")) | (F.col("a._part") != F.col("b._part"))
    return a.join(b, same & once & wanted)
