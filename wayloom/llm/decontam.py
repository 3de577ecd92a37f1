"""Benchmark decontamination: prefix-filtered set join of document shingles with item windows.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window). A window lies in a
document when all its words stand there consecutively, that is, when the document contains the window's whole set of
shingles, in place. For containment of the whole set the necessary prefix is one shingle, the rarest one, so:

1. One pass over the documents keeps the *segments*: stretches of words whose shingles all are in a fixed-size
   bitmap of item shingles, and that are long enough to hold a window (length bound). False positives only cost time.
2. Shingles are counted over the segments of all documents, which gives the rarity order; a window with a shingle
   that occurs nowhere is dropped, every other one is represented by its rarest shingle.
3. Segments join the windows on that shingle; a window must fit into the segment around it (positional bound), and
   its words are then compared one by one. No hash decides.

Windows of one or two words (whole items) have shingles of that many words and a bitmap of their own, so that they do not
widen the segments of the others; every place of their words is a segment, which is as many as they have hits.

What is broadcast are the bitmaps, whose size is fixed; all joins are on shingles or row ids and left to Spark.
Null and empty texts have no words and are never hit. Columns of any name pass through ``decontaminate``. Rows are judged one by one, so repeated rows get equal results.
Repeated items count once; a null or empty item has no window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.llm.common import Scratch, keep_table, packed, plain_words, unpacked

WINDOW = 13
SHINGLE = 3
BITMAP_BITS = 1 << 24
WORDS_AT_ONCE = 400_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def shingle_codes(words: list[bytes], k: int) -> np.ndarray:
    """Code of the ``k`` words from each place on; equal words give equal codes on every machine."""
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for j in range(k):
            out = (out ^ codes[j : j + n]) * MIX[j % 3]
            out ^= out >> np.uint64(29)
    return out


def _places(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint64(BITMAP_BITS - 1)).astype(np.int64)


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, words): the distinct windows of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w.decode() for w in plain_words(text)]
                for start in range(max(1, len(words) - window + 1) if words else 0):
                    ids.append(item)
                    windows.append(words[start : start + window])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(windows, pa.list_(pa.string()))], ["item_id", "words"]
            )

    source = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["item_id"].dataType.simpleString()
    return source.mapInArrow(cut, f"item_id {kind}, words array<string>").distinct()


def _bitmap(windows: DataFrame, k: int) -> bytes:
    """Bitmap of all window shingles; at most one 64-bit word of it for each of its fixed number of places is collected."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[int] = set()
            for words in batch.column(0).to_pylist():
                found.update(_places(shingle_codes([w.encode() for w in words], k)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["place"])

    rows = (
        windows.select("words")
        .mapInArrow(codes, "place long")
        .groupBy(F.floor(F.col("place") / 32).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(place % 32))) AS bits"))
        .toPandas()
    )
    bits = np.zeros(BITMAP_BITS // 32, np.uint32)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return bits.tobytes()


def segments(docs: DataFrame, text_col: str, kinds: list[tuple[int, int, Broadcast]]) -> DataFrame:
    """``docs`` without the text, plus n_words and segs: (k, start, words) of stretches that may hold a window.

    ``kinds``: (k, length of the shortest window, bitmap) for every number of words in a shingle.
    """
    others = [c for c in docs.columns if c != text_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [(k, shortest, np.frombuffer(bitmap.value, np.uint32)) for k, shortest, bitmap in kinds]
        kind = pa.list_(pa.struct([("k", pa.int32()), ("start", pa.int32()), ("words", pa.list_(pa.string()))]))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            counts: list[int] = []
            segs: list[list] = []
            buffer: list[bytes] = []
            bounds: list[int] = [0]

            def flush() -> None:
                done = len(segs)
                segs.extend([] for _ in bounds[1:])
                for k, shortest, words32 in maps:
                    places = _places(shingle_codes(buffer, k))
                    hit = (words32[places >> 5] >> (places & 31).astype(np.uint32)) & np.uint32(1)
                    for nth, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        flags = hit[lo : max(lo, hi - k + 1)]
                        if flags.any():
                            edges = np.flatnonzero(np.diff(np.concatenate(([0], flags, [0])).astype(np.int8)))
                            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                                if e - s + k - 1 >= shortest:
                                    segs[done + nth].append({"k": k, "start": s, "words": [w.decode() for w in buffer[lo + s : lo + e + k - 1]]})
                buffer.clear()
                bounds[:] = [0]

            for text in texts:
                words = plain_words(text.as_py())
                counts.append(len(words))
                buffer.extend(words)
                bounds.append(len(buffer))
                if len(buffer) >= WORDS_AT_ONCE:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in others] + [pa.array(counts, pa.int64()), pa.array(segs, kind)],
                [*others, "n_words", "segs"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return docs.mapInArrow(scan, f"{schema}, n_words long, segs array<struct<k:int,start:int,words:array<string>>>")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW
) -> DataFrame:
    """One row per row of ``docs``: id_col, text_code (``xxhash64`` of the text), n_words, n_hit, n_items, items, items_sha256."""
    scratch = Scratch()
    windows = scratch.keep(item_windows(items, item_col, "text", window).withColumn("k", F.least(F.size("words"), F.lit(SHINGLE))))
    spark = docs.sparkSession
    kinds = [
        (row["k"], row["shortest"], spark.sparkContext.broadcast(_bitmap(windows.filter(F.col("k") == row["k"]), row["k"])))
        for row in windows.groupBy("k").agg(F.min(F.size("words")).alias("shortest")).orderBy("k").collect()  # at most SHINGLE rows
    ]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col),
        F.xxhash64(F.col(text_col)).alias("text_code"),
        F.col(text_col).cast("string").alias("_text"),
    )
    scanned = keep_table(segments(rows, "_text", kinds))

    def shingles(words: str) -> F.Column:
        return F.expr(f"transform(sequence(1, size({words}) - k + 1), i -> array_join(slice({words}, i, k), ' '))")

    found = scanned.select("row", F.explode("segs").alias("seg")).select("row", "seg.k", "seg.start", "seg.words")
    placed = found.select("row", "k", "start", F.size("words").alias("n"), F.posexplode(shingles("words")).alias("at", "shingle"))
    rarity = placed.groupBy("k", "shingle").agg(F.count("*").alias("df"))
    texts = windows.select("k", F.array_join("words", " ").alias("window"), F.size("words").alias("len"), "words").distinct()
    parts = texts.select("k", "window", "len", F.posexplode(shingles("words")).alias("offset", "shingle"))
    anchors = (
        parts.join(rarity, ["k", "shingle"])
        .groupBy("k", "window", "len")
        .agg(F.count("*").alias("known"), F.min(F.struct("df", "shingle", "offset")).alias("rarest"))
        .filter(F.col("known") == F.col("len") - F.col("k") + 1)
        .select("k", "window", "len", "rarest.shingle", "rarest.offset")
    )
    near = (
        placed.join(anchors, ["k", "shingle"])
        .filter((F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("len") <= F.col("n")))
        .select("row", "k", "start", (F.col("at") - F.col("offset")).alias("lo"), "len", "window")
    )
    hits = keep_table(
        near.join(found, ["row", "k", "start"])
        .filter(F.expr("array_join(slice(words, lo + 1, len), ' ') = window"))
        .select("row", (F.col("start") + F.col("lo")).cast("long").alias("s"), (F.col("start") + F.col("lo") + F.col("len")).cast("long").alias("e"), "window")
    )
    owners = keep_table(windows.select(F.array_join("words", " ").alias("window"), F.col("item_id").cast("string").alias("item_id")).filter("item_id is not null"))
    scratch.drop()
    before = Window.partitionBy("row").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.select("row", "s", "e").distinct()
        .withColumn("done", F.coalesce(F.max("e").over(before), F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "done"))).alias("n_hit"))
    )
    named = hits.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    return (
        scanned.select("row", id_col, "text_code", "n_words")
        .join(covered, "row", "left")
        .join(named, "row", "left")
        .select(
            id_col, "text_code", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", none).alias("items"),
        )
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, columns unchanged; rows with equal doc_id and text share one verdict."""
    bad = contamination(docs, items).filter("contaminated").select("doc_id", "text_code").distinct().hint("shuffle_hash").alias("bad")
    rows = docs.select(packed(docs).alias("row"), "doc_id", F.xxhash64("text").alias("text_code")).alias("rows")
    same = F.col("rows.doc_id").eqNullSafe(F.col("bad.doc_id")) & (F.col("rows.text_code") == F.col("bad.text_code"))
    return rows.join(bad, same, "left_anti").select(*unpacked(docs))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(s) WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, item_id, s, dw.n FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
