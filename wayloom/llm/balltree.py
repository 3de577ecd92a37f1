"""Ranked lexical search: exact inner products by sparse ball trees.

A document is a sparse vector of integers over the terms of the items, a query the indicator of its item's terms, and the
score their inner product. Tasks cut their documents into chunks of at most ``CHUNK_ENTRIES`` entries and build a ball
tree over each: a node has a whole-number centre, a radius around it, and for every term the radius in that term's
direction. No document under a node scores more than the query's product with the centre plus the smaller of

* sqrt(terms that the node holds) * radius, by the Cauchy-Schwarz inequality, and
* the sum of the query's terms' own radii (the plain ball is wide where many terms are common; these are not).

Centres and the terms' radii are integers, so that their sums are exact; squared radii are widened by far
more than doubles can lose, and the bound is rounded up. Subtrees are visited best bound first and dropped when
their bound is below the item's threshold; the documents of a leaf are scored exactly in 64-bit integers. Thresholds are scores
that ``top`` documents are known to reach: found first on a small part of the documents, then raised by each chunk of a task.

Passes: one over the texts gives (doc_id, n, terms, counts) rows, kept as a table; document frequencies, N and L are counted
over all of them. Items are taken in blocks of about ``BLOCK_BYTES`` of text, every block against all documents, so that the
vocabulary and the queries that are broadcast have a bounded size whatever the number of items.

Defined results: null texts and texts without a term have no row and are not counted; items without a term get
no rows; rows that repeat an item_id are one item with the terms of all of them; rows that repeat a doc_id are ranked one by
one; equal scores are in ascending order of doc_id, null last; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.llm.common import drop_tables, keep_table, plain_words

TOP = 50
LEAF = 64
CHUNK_ENTRIES = 500_000
BLOCK_BYTES = 8_000_000
#: About so many documents give the first thresholds.
SEED_DOCS = 8192
#: Relative widening of squared radii; sums of a million terms in doubles are good to 1e-10.
SLACK = 1e-8


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Entries:
    """Sparse rows: entries of row i stand at ``ptr[i]`` up to ``ptr[i + 1]``; every row has one at least."""

    ptr: np.ndarray
    col: np.ndarray
    val: np.ndarray

    def take(self, rows: np.ndarray) -> Entries:
        sizes = self.ptr[rows + 1] - self.ptr[rows]
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ptr[-1]) + np.repeat(self.ptr[rows] - ptr[:-1], sizes)
        return Entries(ptr, self.col[at], self.val[at])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


@dataclass
class Node:
    """Whole-number centre and, for the terms that its documents hold, how far they reach beyond it."""

    cols: np.ndarray
    centre: np.ndarray
    most: np.ndarray  # largest component: the centre plus the radius in the term's direction
    radius: float
    start: int
    stop: int
    children: list[Node] = field(default_factory=list)

    def bound(self, terms: np.ndarray) -> int:
        """No document under the node has a larger product with the indicator of ``terms``."""
        at = np.searchsorted(self.cols, terms)
        at[at == len(self.cols)] = 0
        at = at[self.cols[at] == terms]
        ball = int(self.centre[at].sum()) + math.ceil(math.sqrt(len(at)) * self.radius * (1 + SLACK)) + 1
        return min(ball, int(self.most[at].sum()))


class BallTree:
    """Ball tree over sparse rows of positive integers in ``width`` columns."""

    def __init__(self, rows: Entries, width: int, leaf: int = LEAF) -> None:
        self.width, self.leaf = width, leaf
        self.order: list[np.ndarray] = []
        self.root = self._node(np.arange(len(rows.ptr) - 1), rows, 0)
        self.place = np.concatenate(self.order)  # rows in the order of the leaves
        self.rows = rows.take(self.place)

    def _node(self, rows: np.ndarray, part: Entries, start: int) -> Node:
        n = len(rows)
        owner = part.owners()
        value = part.val.astype(np.float64)
        centre = np.floor(np.bincount(part.col, value, self.width) / n)
        most = np.zeros(self.width, np.int64)
        np.maximum.at(most, part.col, part.val)
        cols = np.flatnonzero(most)
        # |d - c|^2 = |c|^2 + the sum of (v - c)^2 - c^2 over the document's entries.
        there = centre[part.col]
        norm = float((centre**2).sum())
        away = np.bincount(owner, (value - there) ** 2 - there**2, n) + norm
        widened = away + SLACK * (np.bincount(owner, value**2 + there**2, n) + norm)
        radius = math.sqrt(max(0.0, float(widened.max()))) * (1 + SLACK) + 1
        node = Node(cols, centre[cols].astype(np.int64), most[cols], radius, start, start + n)
        if n <= self.leaf:
            self.order.append(rows)
            return node
        # Two far documents are the poles; a document goes to the nearer one, or, if that leaves one side nearly empty, by the median.
        square = np.bincount(owner, value**2, n)

        def distance(pole: int) -> np.ndarray:
            dense = np.zeros(self.width)
            mine = slice(part.ptr[pole], part.ptr[pole + 1])
            dense[part.col[mine]] = value[mine]
            return square - 2 * np.bincount(owner, value * dense[part.col], n) + square[pole]

        to_first = distance(int(away.argmax()))
        lean = to_first - distance(int(to_first.argmax()))
        left = lean < 0
        if not n // 10 < int(left.sum()) < n - n // 10:
            left = np.zeros(n, bool)
            left[np.argsort(lean, kind="stable")[: n // 2]] = True
        for side in (np.flatnonzero(left), np.flatnonzero(~left)):
            node.children.append(self._node(rows[side], part.take(side), node.children[-1].stop if node.children else start))
        return node

    def search(self, terms: np.ndarray, least: int, top: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, leaves visited) of the ``top`` best rows with a score of ``least`` or more; ties by ``rank``."""
        asked = np.zeros(self.width, bool)
        asked[terms] = True
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-self.root.bound(terms), 0, self.root)]
        made = visited = 0
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[2]
            if node.children:
                for child in node.children:
                    most = child.bound(terms)
                    if most >= least:
                        made += 1
                        heapq.heappush(heap, (-most, made, child))
                continue
            visited += 1
            lo, hi = self.rows.ptr[node.start], self.rows.ptr[node.stop]
            found = np.add.reduceat(np.where(asked[self.rows.col[lo:hi]], self.rows.val[lo:hi], 0), self.rows.ptr[node.start : node.stop] - lo)
            good = np.flatnonzero(found >= least)
            if not len(good):
                continue
            rows = np.concatenate([rows, self.place[node.start + good]])
            scores = np.concatenate([scores, found[good]])
            if len(rows) >= top:
                best = np.lexsort((rank[rows], -scores))[:top]
                rows, scores = rows[best], scores[best]
                least = max(least, int(scores[-1]))
        return rows, scores, visited


@dataclass
class Queries:
    """A block of items: its vocabulary, the columns of each item, and what is known of the documents."""

    vocabulary: dict[bytes, int]
    items: list
    columns: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n_docs: int = 0
    n_terms: int = 0
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Queries]:
    """The items with a term, in blocks of about ``block_bytes`` of text."""
    rows = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        terms: dict = {}
        for row in rows.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toLocalIterator():
            terms.setdefault(row["item"], set()).update(plain_words(row["text"]))
        terms = {item: found for item, found in terms.items() if found}
        names = sorted(set().union(*terms.values()))
        vocabulary = {t: i for i, t in enumerate(names)}
        if terms:
            yield Queries(vocabulary, list(terms), [np.array(sorted(vocabulary[t] for t in found), np.int64) for found in terms.values()])


def term_rows(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n, terms, counts) of the documents with a term: all terms are counted in n, those of the items are listed."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keep, sizes, terms, counts, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                words = plain_words(text.as_py())
                if not words:
                    continue
                keep.append(i)
                sizes.append(len(words))
                seen = Counter(words)
                for term in seen.keys() & known.keys() if len(seen) > len(known) else (t for t in seen if t in known):
                    terms.append(known[term])
                    counts.append(seen[term])
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), *lists], [id_col, "n", "terms", "counts"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n long, terms array<int>, counts array<int>")


def _values(n: np.ndarray, col: np.ndarray, tf: np.ndarray, sizes: np.ndarray, q: Queries) -> np.ndarray:
    """Integer component of every entry."""
    kind = np.int64 if 50 * int(n.max()) * q.n_docs < 1 << 62 else object  # Python's whole numbers where 64 bits could overflow
    m = 50 + (50 * n.astype(kind) * q.n_docs // q.n_terms).astype(np.int64)
    tf = tf.astype(np.int64)
    return q.weights[col] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes)))


def _chunks(batches: Iterator[pa.RecordBatch], q: Queries) -> Iterator[tuple[pa.Array, Entries]]:
    """(ids, rows) of at most about ``CHUNK_ENTRIES`` entries, without zero components and rows that have no others."""
    ids: list[pa.Array] = []
    sizes: list[np.ndarray] = []
    cols: list[np.ndarray] = []
    vals: list[np.ndarray] = []
    held = 0

    def flush() -> tuple[pa.Array, Entries]:
        out = pa.concat_arrays(ids), Entries(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(cols), np.concatenate(vals))
        for part in (ids, sizes, cols, vals):
            part.clear()
        return out

    for batch in batches:
        step = 256
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            listed = part.column(2)
            size = np.diff(listed.offsets.to_numpy())
            col = listed.flatten().to_numpy().astype(np.int64)
            val = _values(part.column(1).to_numpy(), col, part.column(3).flatten().to_numpy(), size, q)
            owner = np.repeat(np.arange(len(size)), size)
            used = val > 0
            size = np.bincount(owner[used], minlength=len(size))
            rows = np.flatnonzero(size)
            if not len(rows):
                continue
            ids.append(part.column(0).take(pa.array(rows)))
            sizes.append(size[rows])
            cols.append(col[used])
            vals.append(val[used])
            held += int(used.sum())
            if held >= CHUNK_ENTRIES:
                yield flush()
                held = 0
    if ids:
        yield flush()


def _ranks(ids: pa.Array) -> np.ndarray:
    order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def search_rows(rows: DataFrame, queries: Queries, id_col: str, top: int) -> DataFrame:
    """(nth, id_col, score): for each item at least all its ``top`` best documents; nth is the item's place in the block."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        least = q.least.copy()
        for ids, entries in _chunks(batches, q):
            tree = BallTree(entries, len(q.vocabulary))
            rank = _ranks(ids)
            nth, places, scores = [], [], []
            for i, terms in enumerate(q.columns):
                found, reached, _ = tree.search(terms, int(least[i]), top, rank)
                if len(found) >= top:
                    least[i] = max(least[i], reached.min())
                nth.append(np.full(len(found), i, np.int32))
                places.append(found)
                scores.append(reached)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nth)), ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], ["nth", id_col, "score"])

    return rows.select(id_col, "n", "terms", "counts").mapInArrow(run, f"nth int, `{id_col}` {rows.schema[id_col].dataType.simpleString()}, score long")


def _ranked(found: DataFrame, id_col: str, top: int) -> DataFrame:
    order = Window.partitionBy("nth").orderBy(F.desc("score"), F.col(id_col).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_block(docs: DataFrame, q: Queries, item_type, id_col: str, text_col: str, item_col: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    rows = keep_table(term_rows(docs, q, id_col, text_col))
    totals = rows.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    q.n_docs, q.n_terms = totals["n"], totals["l"] or 0
    df = np.zeros(len(q.vocabulary), np.int64)
    for row in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():  # at most the block's terms
        df[row["t"]] = row["df"]
    q.weights = np.array([term_weight(q.n_docs, int(x)) for x in df], np.int64)
    q.least = np.ones(len(q.items), np.int64)
    if q.n_docs > 4 * SEED_DOCS:
        part = rows.filter(F.pmod(F.xxhash64(id_col, "n"), F.lit(q.n_docs // SEED_DOCS)) == 0)
        for row in _ranked(search_rows(part, q, id_col, top), id_col, top).filter(F.col("rank") == top).collect():  # one row per item of the block
            q.least[row["nth"]] = row["score"]
    best = keep_table(_ranked(search_rows(rows, q, id_col, top), id_col, top))
    drop_tables(rows)
    kind = item_type.simpleString()
    names = spark.createDataFrame(list(enumerate(q.items)), f"nth int, `{item_col}` {kind}")
    return best.join(F.broadcast(names), "nth").select(item_col, "rank", id_col, "score")  # names: the items of one block


def rank_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(item_col, rank, id_col, score): the ``top`` best documents of every item."""
    spark: SparkSession = docs.sparkSession
    kind = items.schema[item_col].dataType
    done: DataFrame | None = None
    for queries in item_blocks(items, item_col, item_text, block_bytes):
        found = _search_block(docs, queries, kind, id_col, text_col, item_col, top)
        done = found if done is None else done.unionByName(found)
    if done is None:
        done = spark.createDataFrame([], f"`{item_col}` {kind.simpleString()}, rank int, `{id_col}` {docs.schema[id_col].dataType.simpleString()}, score long")
    return done


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
n AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
tot AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, tot),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM i JOIN wt USING (t) JOIN tf USING (t) JOIN n USING (r), tot GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s JOIN n USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
