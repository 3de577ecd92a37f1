"""Line dedup: suffix ranks over line sequences by distributed prefix doubling, in DataFrame functions only.

A document is a sequence of lines. A line that stands nowhere else cannot be part of a repeated run, so only repeated
lines are kept; where one is missing, a sequence ends. Every remaining position starts a suffix. Prefix doubling ranks
the suffixes by their first 1, 2, 4, ... lines: the rank is one plus the number of suffixes with a smaller prefix, so
that equal ranks mean equal prefixes and each round splits the groups of the one before by the rank found 2^k
positions further on. Suffixes alone in their group are finished; rounds end when all are.

Repeated runs: from each position the shortest run of at least ``min_words`` words is taken, forwards and backwards
(every longer run that covers a line holds such a run that covers it, too). The suffixes that share a run of n lines
form the interval of the suffix array whose common prefixes are n lines or longer; two ranks of the level 2^k <= n, at
the run's first line and at its last 2^k lines, name this interval, so that neither the sorted array nor an interval
has to be walked. The first member of an interval in (doc_id, text, position) order stays; lines covered by a run of a
later member are deleted. As the copy that stays is never the deleted one, no line content is lost.

Skew: groups are never gathered. Ranks need counts of smaller keys within a group, which are added up over about
sqrt(n) buckets of the group and then inside each bucket, on distinct keys with counts.

Defined results: null and empty texts have no repeated lines and stay as they are; blank lines are lines of no words;
rows that agree in doc_id and text are one document and get the same result; rows without an id come last in the order
and take part like all others (those of one text are one document); columns of any name pass through; empty tables
give empty results.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.llm.common import Scratch, keep_table, packed, unpacked

MIN_WORDS = 50
#: A document: has no id, id, code of the text. In this order, ids come before rows without one.
DOC = ["bare", "doc", "code"]


def _keyed(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    some_id = F.lit("0").cast(docs.schema["doc_id"].dataType)
    return docs.select(
        F.col("doc_id").isNull().alias("bare"), F.coalesce(F.col("doc_id"), some_id).alias("doc"),
        F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("code"), F.col(text_col).alias("text"), *more,
    )


def repeated_lines(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """(bare, doc, code, pos, line, words): lines that stand at two or more places of all documents; line is their md5."""
    lines = (
        _keyed(docs, text_col)
        .select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("pos", "body"))
        .select(*DOC, "pos", F.unhex(F.md5(F.col("body").cast("binary"))).alias("line"), F.regexp_count("body", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    )
    often = scratch.keep(lines.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line"))
    return lines.join(often, "line").repartition(*DOC).dropDuplicates([*DOC, "pos"])


def _refined(pairs: DataFrame, spread: Column, buckets: int) -> DataFrame:
    """(rank, next, finer) for distinct (rank, next, n): finer = rank plus the suffixes of the group with a smaller next."""
    placed = pairs.withColumn("bucket", F.least(spread, F.lit(buckets - 1)))
    sums = placed.groupBy("rank", "bucket").agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("rank", "bucket").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("start"))
    return placed.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["rank", "bucket"]).select(
        "rank", "next", (F.col("rank") + F.col("start") + F.col("before")).alias("finer")
    )


def suffix_ranks(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, bare, doc, code, pos, rank): ranks of the suffixes by their first 2^k lines, for every k for which that run is repeated.

    A suffix alone in its group is in its final place and takes no part in further rounds, nor does one whose
    continuation is alone: neither starts a repeated run of more lines.
    """
    total = lines.count()
    buckets = max(1, math.isqrt(total))
    level = lines.select(*DOC, "pos", F.lit(1).cast("long").alias("rank"), F.col("line").alias("next"))
    spread = (F.conv(F.substring(F.hex("next"), 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)).cast("int")
    levels: list[DataFrame] = []
    while True:
        pairs = level.groupBy("rank", "next").agg(F.count("*").alias("n")).filter("n > 1")
        ranks = scratch.keep(level.join(_refined(scratch.keep(pairs), spread, buckets), ["rank", "next"]).select(*DOC, "pos", F.col("finer").alias("rank")))
        levels.append(ranks.select(F.lit(len(levels)).alias("k"), *DOC, "pos", "rank"))
        if ranks.isEmpty():
            return functools.reduce(DataFrame.unionByName, levels)
        # A gap in the positions ends a run; see ``chained``.
        ahead = ranks.select(*DOC, (F.col("pos") - (1 << (len(levels) - 1))).alias("pos"), F.col("rank").alias("next"))
        level = ranks.join(ahead, [*DOC, "pos"])
        spread = (F.col("next").cast("double") * buckets / float(total + 1)).cast("int")


def chained(lines: DataFrame) -> DataFrame:
    """``lines`` renumbered so that a gap in the positions is a gap of more than the document's length.

    A jump of 2^k positions must not reach over a missing line into a later run, so every run of neighbours is moved
    away from the one before by twice its document's lines; at keeps the place in the document.
    """
    order = Window.partitionBy(*DOC).orderBy("pos")
    whole = Window.partitionBy(*DOC)
    fresh = F.when(F.col("pos") - F.lag("pos").over(order) == 1, 0).otherwise(1)
    return (
        lines.withColumn("_new", fresh)
        .withColumn("run", F.sum("_new").over(order).cast("long"))
        .withColumn("pos", F.col("pos") + F.col("run") * 2 * (F.max("pos").over(whole) + 1))
        .drop("_new", "run")
    )


def run_ends(lines: DataFrame, min_words: int) -> DataFrame:
    """(bare, doc, code, start, stop): for each position the shortest runs of ``min_words`` words from it on and up to it."""
    order = Window.partitionBy(*DOC).orderBy("pos")
    fresh = F.when(F.col("pos") - F.lag("pos").over(order) == 1, 0).otherwise(1)
    runs = lines.select(*DOC, "pos", "words", fresh.alias("new")).withColumn("run", F.sum("new").over(order))
    summed = runs.withColumn("upto", F.sum("words").over(Window.partitionBy(*DOC, "run").orderBy("pos")))
    before = F.col("upto") - F.col("words")
    goals = summed.select(
        *DOC, "run", F.explode(F.array(
            # kind 0: the end of a run from pos on; kind 1: the start of a run up to pos. Marks are what is looked for.
            F.struct(F.lit(0).alias("kind"), F.col("upto").alias("x"), F.col("pos").alias("mark"), F.lit(None).cast("long").alias("of")),
            F.struct(F.lit(0).alias("kind"), (before + min_words).alias("x"), F.lit(None).cast("long").alias("mark"), F.col("pos").alias("of")),
            F.struct(F.lit(1).alias("kind"), before.alias("x"), F.col("pos").alias("mark"), F.lit(None).cast("long").alias("of")),
            F.struct(F.lit(1).alias("kind"), (F.col("upto") - min_words).alias("x"), F.lit(None).cast("long").alias("mark"), F.col("pos").alias("of")),
        )).alias("g")
    ).select(*DOC, "run", "g.*")
    parts = Window.partitionBy(*DOC, "run", "kind")
    ahead = parts.orderBy("x", F.col("mark").isNotNull(), "mark", "of").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    back = parts.orderBy("x", F.col("mark").isNull(), "mark", "of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = goals.withColumn("stop", F.first("mark", True).over(ahead)).withColumn("start", F.last("mark", True).over(back)).filter("of is not null")
    return (
        found.select(*DOC, F.when(F.col("kind") == 0, F.col("of")).otherwise(F.col("start")).alias("start"), F.when(F.col("kind") == 0, F.col("stop")).otherwise(F.col("of")).alias("stop"))
        .filter("start is not null and stop is not null and start <= stop")
        .distinct()
    )


def later_copies(lines: DataFrame, ranks: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(bare, doc, code, start, stop, lines, copies): runs of which an earlier copy exists."""
    size = (F.col("stop") - F.col("start") + 1).alias("lines")
    runs = run_ends(lines, min_words).select(*DOC, "start", "stop", size).withColumn("k", F.floor(F.log2(F.col("lines").cast("double") + 0.5)).cast("int"))
    at = ranks.select("k", *DOC, F.col("pos").alias("start"), F.col("rank").alias("head"))
    tail = ranks.select("k", *DOC, F.col("pos").alias("tail"), F.col("rank").alias("foot"))
    named = scratch.keep(
        runs.withColumn("tail", F.expr("stop + 1 - shiftleft(1L, k)"))
        .join(at, ["k", *DOC, "start"])
        .join(tail, ["k", *DOC, "tail"])
        .select(*DOC, "start", "stop", "lines", "head", "foot")
    )
    place = F.struct(*DOC, "start")
    interval = ["lines", "head", "foot"]
    firsts = scratch.keep(named.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1"))
    return named.join(firsts, interval).filter(place > F.col("first")).select(*DOC, "start", "stop", "lines", "copies")


def deleted_lines(docs: DataFrame, scratch: Scratch, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(bare, doc, code, gone): the places of deleted lines of each document that loses any, in order."""
    lines = scratch.keep(chained(repeated_lines(docs, scratch, text_col).withColumn("at", F.col("pos"))).select(*DOC, F.col("pos").cast("long").alias("pos"), "at", "line", "words"))
    copies = later_copies(lines, suffix_ranks(lines, scratch), scratch, min_words)
    order = Window.partitionBy(*DOC).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    # Overlapping runs are cut to what they add, so that each line is named once.
    added = copies.withColumn("from", F.greatest(F.col("start"), F.coalesce(F.max("stop").over(order) + 1, F.col("start")))).filter("from <= stop")
    gone = added.select(*DOC, F.explode(F.sequence("from", "stop")).alias("pos")).join(lines.select(*DOC, "pos", "at"), [*DOC, "pos"])
    return gone.groupBy(*DOC).agg(F.sort_array(F.collect_set("at")).alias("gone"))


def _deduped(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, fresh, n_lines, n_gone): the packed rows with their text after line dedup, lines before and lines deleted."""
    scratch = Scratch()
    cuts = keep_table(deleted_lines(docs, scratch, "text", min_words))
    scratch.drop()
    # The hint keeps one plan at every size: texts are shuffled once and never sorted.
    joined = _keyed(docs, "text", packed(docs).alias("row")).join(cuts.hint("shuffle_hash"), DOC, "left")
    rows = joined.withColumn("split", F.split("text", "\n", -1)).withColumn("n_lines", F.coalesce(F.size("split"), F.lit(0)))
    # The lines between two deleted places are one slice; places are counted from 0, the ends are -1 and the number of lines.
    kept = F.expr(
        "array_join(flatten(transform(sequence(0, size(gone)), i -> slice(split, "
        "if(i = 0, 1, gone[int(greatest(i - 1, 0))] + 2), "
        "if(i = size(gone), n_lines, gone[int(least(i, size(gone) - 1))]) - if(i = 0, 0, gone[int(greatest(i - 1, 0))] + 1)))), '\n')"
    )
    fresh = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    return rows.select("row", fresh.alias("fresh"), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).alias("n_gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, lines_col: str = "_lines", gone_col: str = "_gone") -> DataFrame:
    """``docs`` with later copies of repeated runs cut from the text, and in place of columns of these names the lines before and the lines deleted."""
    others = docs.drop(lines_col, gone_col)
    return _deduped(others, min_words).select(*unpacked(others, text=F.col("fresh")), F.col("n_lines").alias(lines_col), F.col("n_gone").alias(gone_col))


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` after line dedup, columns unchanged; documents of which nothing but white space is left are dropped."""
    left = _deduped(docs, min_words).filter((F.col("n_gone") == 0) | F.regexp_like("fresh", F.lit(r"[^\x20\x09-\x0D]")))
    changed = {"text": F.col("fresh")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("fresh").cast(docs.schema["n_chars"].dataType)
    return left.select(*unpacked(docs, **changed))


ORACLE = r"""
WITH RECURSIVE o AS (SELECT doc_id AS id, text, dense_rank() OVER (ORDER BY doc_id NULLS LAST, text) AS doc_id FROM documents),
d AS (SELECT DISTINCT doc_id, string_split(text, chr(10)) AS l FROM o WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
n AS (SELECT line, count(*) AS c, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM p GROUP BY line),
q AS (SELECT p.*, w, c FROM p JOIN n USING (line)),
r AS (SELECT doc_id, i, line, w, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM q WHERE c > 1),
s AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, run ORDER BY i) AS upto FROM r),
f AS (SELECT a.doc_id, a.run, a.i AS i0, min(b.i) AS i1 FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.run = b.run AND b.i >= a.i AND b.upto >= a.upto - a.w + 50 GROUP BY ALL),
b AS (SELECT a.doc_id, a.run, max(b.i) AS i0, a.i AS i1 FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.run = b.run AND b.i <= a.i AND b.upto - b.w <= a.upto - 50 GROUP BY a.doc_id, a.run, a.i),
w AS (SELECT DISTINCT * FROM (SELECT doc_id, i0, i1 FROM f UNION ALL SELECT doc_id, i0, i1 FROM b)),
t AS (SELECT w.doc_id, i0, i1, array_to_string(l[i0:i1], chr(10)) AS body FROM w JOIN d USING (doc_id)),
g AS (SELECT doc_id, i0, i1, row_number() OVER (PARTITION BY body ORDER BY doc_id, i0) AS nth FROM t),
x AS (SELECT DISTINCT doc_id, unnest(range(i0, i1 + 1)) AS i FROM g WHERE nth > 1),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM p ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT o.id AS doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(len(string_split(o.text, chr(10))), 0) AS INT) AS n_lines, CAST(coalesce(m.n, 0) AS INT) AS n_deleted
FROM o LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id) m USING (doc_id)
"""
