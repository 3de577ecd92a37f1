"""Helpers shared by the corpus operators: tables in the shared folder, words, row identity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.session import checkpoint_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Byte table: A-Z become a-z, every other ASCII byte that is no digit or letter becomes a space. Bytes over 127 stay,
#: so splitting at spaces gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a UTF-8 text.
PLAIN_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words of digits, letters and non-ASCII characters."""
    return (text or "").encode().translate(PLAIN_WORDS).split()


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space; ``bytes`` methods know ASCII only, as wanted."""
    return (text or "").encode().lower().split()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """All columns as one struct, so that names an operator uses itself cannot clash with the caller's."""
    return F.struct(*(quoted(c).alias(c) for c in docs.columns))


def unpacked(docs: DataFrame, row: str = "row", **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of its packed ``row``, some of them changed."""
    return [changed.get(c, F.col(row)[c]).alias(c) for c in docs.columns]


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def keep_table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and lost executors cost no replay."""
    path = shared_path(df.sparkSession, "corpus")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of ``keep_table`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of ``keep_table`` that are deleted together once the result that needs them is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.append(keep_table(df))
        return self.tables[-1]

    def drop(self) -> None:
        drop_tables(*self.tables)
        self.tables = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
