import hashlib
import random
import re

from wayloom.llm import decontam as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for key, text in docs:
        w = words_of(text)
        hit, owners = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    owners |= windows[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        out.append(str((key, len(w), len(hit), len(owners), digest, len(hit) > 0 and 20 * len(hit) >= len(w))))
    return sorted(out)


def found(docs, items):
    rows = op.contamination(docs, items).collect()
    return sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])) for r in rows)


def test_windows_match_brute_force(spark):
    rng = random.Random(2)
    pool = ["the", "of", "and", "Ünder", "a1"] + [f"word{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice((0, 3, 5, 13, 14, 30))))) for i in range(12)] + [(50, None), (51, "the of and the of and the of and"), (3, "the  OF, and\nword1")]
    docs = []
    for i in range(60):
        body = [rng.choice(pool) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            piece = words_of(rng.choice(items)[1])
            body[at:at] = piece[rng.randrange(2) :]
        docs.append((i, ", ".join(body)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert found(d, b) == brute(docs, items)
    short = [(1, "the"), (2, "word3 of")]
    assert found(d, spark.createDataFrame(short, "item_id long, text string")) == brute(docs, short)


def test_hard_rows(spark, hard_docs):
    items = [(1, "x " * 20), (2, "a text without an id that is long enough"), (2, "a text without an id that is long enough")]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    assert found(hard_docs, b) == brute(rows, items)
    kept = op.decontaminate(hard_docs, b)
    assert kept.columns == hard_docs.columns and kept.count() == len(rows) - 2
    assert found(hard_docs, b.limit(0)) == brute(rows, [])
    assert found(hard_docs.limit(0), b) == []


def test_short_items_leave_the_segments_of_others_alone(spark, sf_docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    more = items.unionByName(spark.createDataFrame([(900, "the"), (901, "that and")], "item_id long, text string"))
    sizes = []
    segments = op.segments

    def counted(*args):
        out = segments(*args)
        sizes.append({r["k"]: r["n"] for r in out.selectExpr("inline(segs)").selectExpr("k", "size(words) n").groupBy("k").sum("n").toDF("k", "n").collect()})
        return out

    op.segments = counted
    try:
        docs = [(r["doc_id"], r["text"]) for r in sf_docs.collect()]
        assert found(sf_docs, more) == brute(docs, [tuple(r) for r in more.collect()])
        assert found(sf_docs, items) == brute(docs, [tuple(r) for r in items.collect()])
    finally:
        op.segments = segments
    assert sizes[0][op.SHINGLE] == sizes[1][op.SHINGLE] and set(sizes[1]) == {op.SHINGLE}
