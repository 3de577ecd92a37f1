"""Flat, rounded outputs, so results compare cell by cell with any SQL engine."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = datetime(2008, 2, 2)
END = datetime(2008, 2, 10)
START_SQL, END_SQL = "TIMESTAMP '2008-02-02 00:00:00'", "TIMESTAMP '2008-02-10 00:00:00'"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields]
    )


def vertices(df: DataFrame, coords: str = "coords", digits: int = 6) -> DataFrame:
    """One row per line vertex in place of the line column."""
    rest = [c for c in df.columns if c != coords]
    return df.select(*rest, F.posexplode(coords).alias("n", "p")).select(
        *rest, (F.col("n") + 1).alias("n"), F.round("p.lon", digits).alias("lon"), F.round("p.lat", digits).alias("lat")
    )


def joined(values: Column) -> Column:
    """Array as comma-separated text."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")
