"""Side-by-side run of registered queries on Spark and DuckDB."""

from __future__ import annotations

import math
import time
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import SparkSession

from wayloom.plans import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    """Comparable form: floats by nine significant digits, nested values as tuples."""
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (float, Decimal)):
        value = float(value)
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple((str(k), normal(v)) for k, v in sorted(value.items(), key=lambda kv: str(kv[0])))
    if hasattr(value, "asDict"):
        return normal(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    out = [tuple(normal(r[n]) for n in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark: SparkSession, sf_dir: str, name: str, con=None) -> dict:
    """Result of one query: row counts, column agreement and value agreement."""
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - started
    result = {"query": name, "rows": len(got), "seconds": round(spent, 2), "columns": sorted(df.columns)}
    if name not in ORACLES:
        return {**result, "ok": None}
    con = con or duck(sf_dir)
    started = time.time()
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    result["oracle_seconds"] = round(time.time() - started, 2)
    result["oracle_rows"] = len(want)
    result["oracle_columns"] = sorted(names)
    result["ok"] = sorted(names) == sorted(df.columns) and got == want
    if not result["ok"]:
        result["sample"] = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return result
