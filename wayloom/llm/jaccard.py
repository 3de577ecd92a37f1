"""N-gram Jaccard join with several global token orders.

Documents are sets of shingles of ``size`` words; two link when their Jaccard similarity reaches ``percent`` (``SHINGLE``
and ``PERCENT`` unless given). Equal sets are one class from the start, so exact copies cost nothing further. Classes are
joined by prefix filtering: under any total order of the tokens, the first n - ceil(percent n / 100) + 1 tokens of two
similar sets have a token in common.

* Order 1 is by rarity. A set whose prefix consists of tokens that stand in no other set has no partner. This is
  decided first on tokens of a fixed part of the code space (an order that puts them first; a quarter at 90 %, half at
  80 %), so that only this part is counted and shuffled; sets that it cannot rule out are read again, whole, and ordered
  by the rarity of all their tokens. Pairs that share a prefix token must also fit by length and by the position of the token.
* Orders 2 and 3 are by ascending and by descending code. Their prefixes are kept as a table of their own; a pair must share
  a token of these, too, before its whole sets are read and intersected, which decides exactly.

No bucket of a token is expanded into all pairs. In rounds, each bucket picks *pivots* (first the one whose prefix token
has the fewest tokens of its own; in round r up to ``GROWTH ** r``), and only pairs of a pivot
and a member of another component are made. Linked members fall into one component at once, members of the largest
component of a bucket need not become pivots, and every other member becomes one in some round: each pair that ends in
two components has been compared, so no link is lost and a group of n near copies costs about n pairs.

What is broadcast are two bitmaps of at most ``BITMAP_LIMIT`` bits; where they fill up, more rows than needed pass them
and are sorted out by joins. Sets are hashed to 64-bit codes, and a class is keyed by 64 bits of id and text.

Kept tables are deleted once the components are known, but for the two that the result is read from.

Defined results: columns of any name and type pass through ``drop_near_duplicates``; null and empty texts have an empty set and link with nothing; a text of fewer than ``size`` words is
one token; rows that repeat a doc_id and text are one document, rows that repeat a doc_id with another text are judged
by their text; null ids are allowed and never become a component's id while another member has one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import Scratch, drop_tables, keep_table, packed, spaced_words, unpacked
from wayloom.operators.graph import connected_components
from wayloom.session import checkpoint_folder

SHINGLE = 3
PERCENT = 90
GROWTH = 8
BITMAP_LEAST, BITMAP_LIMIT = 1 << 20, 1 << 28
WORDS_AT_ONCE = 300_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def token_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct codes of the shingles of a text."""
    words = spaced_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        out = (out ^ codes[j : j + len(out)]) * MIX[j % len(MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_length(n: int | np.ndarray, percent: int = PERCENT):
    return n - (-(-percent * n // 100)) + 1


def _counted(percent: int) -> int:
    """One of so many parts (a power of two) of the code space is counted: 2.5 prefixes of tokens at least."""
    return 1 << max(0, (200 // (5 * max(1, 100 - percent))).bit_length() - 1)


def _prefix(n: Column, percent: int) -> Column:
    return n - F.floor((n * percent + 99) / 100).cast("int") + 1


def _bitmap(nodes: DataFrame, bits: int) -> bytes:
    """Bitmap of the node codes; collected as at most ``bits`` / 32 words."""
    place = F.pmod(F.col("node"), F.lit(bits))
    rows = (
        nodes.select(place.alias("place")).groupBy(F.floor(F.col("place") / 32).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(place % 32))) AS bits")).toPandas()
    )
    words = np.zeros(bits // 32, np.uint32)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return words.tobytes()


def _bits_for(n: int) -> int:
    return min(BITMAP_LIMIT, max(BITMAP_LEAST, 1 << (16 * max(1, n)).bit_length()))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), F.xxhash64(F.col(id_col), text).alias("node"), text.alias("_text"))


def set_prints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id_col, node, n, print): size and 128-bit print of each row's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints = [], []
            for text in batch.column(2):
                found = token_set(text.as_py(), size)
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary())], [id_col, "node", "n", "print"]
            )

    rows = _keyed(docs, id_col, text_col)
    return rows.mapInArrow(scan, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, node long, n int, print binary")


def _chosen(batches: Iterator[pa.RecordBatch], bitmap: bytes, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, set) of the rows of (node, text) whose node is in the bitmap."""
    words = np.frombuffer(bitmap, np.uint32)
    bits = len(words) * 32
    for batch in batches:
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        places = nodes % bits
        hits = np.flatnonzero((words[places >> 5] >> (places & 31).astype(np.uint32)) & np.uint32(1))
        for i in hits.tolist():
            yield int(nodes[i]), token_set(batch.column(1)[i].as_py(), size)


def possible_partners(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, bits: int, percent: int, size: int) -> DataFrame:
    """(node, n) of the classes whose prefix is not filled by tokens that no other set holds."""
    parts = _counted(percent)
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(classes.select(F.col("rep").alias("node")), bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nodes = np.repeat(np.array([node for node, _ in held], np.int64), [len(t) for _, t in held])
            tokens = np.concatenate([t for _, t in held]) if held else np.zeros(0, np.uint64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(nodes)], ["token", "node"])

        for node, found in _chosen(batches, bitmap.value, size):
            counted = found[(found & np.uint64(parts - 1)) == 0]
            held.append((node, counted))
            n += len(counted)
            if n >= WORDS_AT_ONCE:
                n = 0
                yield flush()
        yield flush()

    pool = _keyed(docs, id_col, text_col).select("node", "_text").mapInArrow(scan, "token long, node long")
    lone = pool.groupBy("token").agg(F.count("*").alias("df"), F.min("node").alias("node")).filter("df = 1")
    alone = lone.groupBy("node").agg(F.count("*").alias("alone"))
    every = classes.select(F.col("rep").alias("node"), "n")
    return every.join(alone, "node", "left").filter(F.coalesce("alone", F.lit(0)) < _prefix(F.col("n"), percent)).select("node", "n")


def postings(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(token, node, n, alone, pos): the prefixes of order 1 of (node, tokens), without tokens that stand in one set only.

    alone: tokens of the set that no other set holds.
    """
    pool = sets.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = pool.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = pool.join(often.hint("shuffle_hash"), "token")
    listed = (
        shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
        .withColumn("alone", F.col("n") - F.size("ranked"))
        .withColumn("p", _prefix(F.col("n"), percent))
        .filter("alone < p")
    )
    places = F.transform(F.slice("ranked", F.lit(1), F.col("p") - F.col("alone")), lambda x, i: F.struct(x["token"].alias("token"), (F.col("alone") + i).alias("pos")))
    rows = scratch.keep(listed.select("node", "n", "alone", F.explode(places).alias("x")).select("x.token", "node", "n", "alone", "x.pos"))
    met = rows.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token")
    return rows.join(met, "token")


def whole_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, bits: int, size: int) -> DataFrame:
    """(node, tokens) of the named nodes, and of some others that the bitmap lets pass."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(nodes, bits))

    def batch_of(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in held])]).astype(np.int32)
        tokens = np.concatenate([t for _, t in held]).view(np.int64) if held else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(tokens))], ["node", "tokens"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        n = 0
        for node, found in _chosen(batches, bitmap.value, size):
            held.append((node, found))
            n += len(found)
            if n >= WORDS_AT_ONCE:
                yield batch_of(held)
                held, n = [], 0
        yield batch_of(held)

    return _keyed(docs, id_col, text_col).select("node", "_text").mapInArrow(scan, "node long, tokens array<long>")


class Bucketed:
    """A table in the shared folder, bucketed by node so that joins need not move it."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"jaccard_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_folder(self.spark)}/{self.name}"
        df.repartition(n, "node").write.option("path", self.path).bucketBy(n, "node").sortBy("node").saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def drop(self) -> None:
        drop_tables(self.table)
        self.spark.sql(f"DROP TABLE {self.name}")


def heads_of(sets: DataFrame, percent: int) -> DataFrame:
    """(node, low, high): the prefixes of every set by orders 2 and 3."""
    p = _prefix(F.size("tokens"), percent)
    return sets.select("node", F.slice("tokens", F.lit(1), p).alias("low"), F.slice("tokens", F.size("tokens") - p + 1, p).alias("high"))


def verified(pairs: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share tokens of the prefixes by orders 2 and 3, too, and whose sets, read for these only, are similar."""

    def side(table: DataFrame, node: str, suffix: str) -> DataFrame:
        return table.select(F.col("node").alias(node), *(F.col(c).alias(f"{c}_{suffix}") for c in table.columns if c != "node"))

    near = (
        pairs.join(side(heads, "a", "a"), "a").join(side(heads, "b", "b"), "b")
        .filter(F.arrays_overlap("low_a", "low_b") & F.arrays_overlap("high_a", "high_b")).select("a", "b")
    )
    both = near.join(side(sets, "a", "a"), "a").join(side(sets, "b", "b"), "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    total = F.size("tokens_a") + F.size("tokens_b")
    return both.withColumn("c", common).filter(F.col("c") * 100 >= (total - F.col("c")) * percent).select("a", "b").distinct()


def _components(found: DataFrame, heads: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, comp) for all nodes with postings."""
    comp = scratch.keep(found.select("node").distinct().withColumn("comp", F.col("node")))
    done = None
    cells = 1
    while True:
        now = found.join(comp, "node")
        largest = (
            now.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token")
            .agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1").select("token", "most")
        )
        # Components only grow, so a bucket within one component is finished for good.
        unfinished = scratch.keep(now.join(largest, "token"))
        found = unfinished.drop("comp", "most")
        open_rows = unfinished if cells == 1 else unfinished.filter("comp <> most").join(done, ["token", "node"], "left_anti")
        cell = F.pmod(F.xxhash64("node"), F.lit(cells))
        pivots = scratch.keep(
            open_rows.groupBy("token", cell.alias("cell")).agg(F.min(F.struct("alone", "pos", "n", "node", "comp")).alias("v")).select("token", "v.*")
        )
        if pivots.isEmpty():
            return comp
        v, o = pivots.alias("v"), unfinished.alias("o")
        need = F.floor(((F.col("v.n") + F.col("o.n")) * percent + percent + 99) / (100 + percent))
        pairs = (
            o.join(v, F.col("o.token") == F.col("v.token"))
            .filter((F.col("o.comp") != F.col("v.comp")) & (F.least("o.n", "v.n") * 100 >= F.greatest("o.n", "v.n") * percent))
            .filter(F.least(F.col("o.n") - F.col("o.pos"), F.col("v.n") - F.col("v.pos")) >= need)
            .select(F.least("v.node", "o.node").alias("a"), F.greatest("v.node", "o.node").alias("b")).distinct()
        )
        links = scratch.keep(verified(pairs, heads, sets, percent))
        if not links.isEmpty():
            label = comp.select(F.col("node").alias("a"), F.col("comp").alias("src"))
            other = comp.select(F.col("node").alias("b"), F.col("comp").alias("dst"))
            edges = links.join(label, "a").join(other, "b").select("src", "dst").distinct()
            merged = connected_components(comp.select(F.col("comp").alias("id")).distinct(), edges)
            comp = scratch.keep(comp.join(merged.withColumnRenamed("id", "comp"), "comp").select("node", F.col("component").alias("comp")))
        seen = pivots.select("token", "node")
        done = scratch.keep(seen if done is None else done.unionByName(seen))
        cells *= GROWTH


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id_col, node, n_shingles, component_id (smallest id of the component), component (its node)."""
    scratch = Scratch()
    prints = keep_table(set_prints(docs, id_col, text_col, size))
    classes = scratch.keep(
        prints.filter("n > 0").groupBy("print").agg(F.min("node").alias("rep"), F.min(id_col).alias("low"), F.min("n").alias("n"))
    )
    bits = _bits_for(classes.count())
    nodes = scratch.keep(possible_partners(docs, classes, id_col, text_col, bits, percent, size))
    sets = Bucketed(whole_sets(docs, nodes, id_col, text_col, bits, size))
    chosen = sets.table.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    found = scratch.keep(postings(chosen, percent, scratch))
    heads = Bucketed(heads_of(sets.table.join(found.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), percent))
    comp = _components(found, heads.table, sets.table, percent, scratch)
    labelled = keep_table(classes.join(comp, F.col("rep") == F.col("node"), "left").select("print", "low", F.coalesce("comp", "rep").alias("comp")))
    scratch.drop()
    heads.drop()
    sets.drop()
    lowest = labelled.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_print = labelled.join(lowest, "comp").select("print", "component_id", F.col("comp").alias("component"))
    return prints.join(by_print, "print", "left").select(
        id_col, "node", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"), "component",
    )


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; columns unchanged.

    Rows that repeat this doc_id are reduced to the one with the smallest node key, rows of one doc_id and text to one of
    them; texts without words all stay.
    """
    found = keep_table(near_duplicates(docs, percent=percent, size=size))
    kept = found.filter("n_shingles > 0").groupBy("component").agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("node"))).alias("node"))
    bare = found.filter("n_shingles = 0").select("node").distinct()
    rows = docs.select(packed(docs).alias("row"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("node"))
    chosen = rows.join(kept.select("node").unionByName(bare).hint("shuffle_hash"), "node", "left_semi")
    return chosen.groupBy("node").agg(F.first("row").alias("row")).select(*unpacked(docs))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS df FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(df, 1), s.g) AS pos FROM s JOIN n USING (doc_id) LEFT JOIN f USING (g)),
x AS (SELECT * FROM r WHERE pos <= n - (90 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
i AS (SELECT a, b, count(*) AS m FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b AND sb.g = sa.g GROUP BY a, b),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 90 * (na.n + nb.n - m)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT reach.v, e2.b FROM reach JOIN e2 ON reach.u = e2.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT v AS doc_id, min(u) AS component_id FROM reach GROUP BY v) m USING (doc_id)
"""
