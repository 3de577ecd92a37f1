import random
from collections import Counter

import numpy as np
from wayloom.llm import balltree as op
from wayloom.llm.common import plain_words


def brute(docs, items, top):
    counts = [(i, Counter(plain_words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(plain_words(text))
    out = []
    for item, asked in terms.items():
        scored = []
        for i, c in counts:
            m = 50 + 50 * c.total() * n_docs // n_terms
            score = sum(op.term_weight(n_docs, df[t]) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(map(str, out))


def found(docs, items, **kw):
    return sorted(str(tuple(r)) for r in op.rank_documents(docs, items, **kw).select("item_id", "rank", "doc_id", "score").collect())


def test_ranking_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(1200)]
    docs += [(2000 + i, docs[3][1]) for i in range(90)] + [(None, docs[3][1]), (5, docs[3][1]), (5, docs[3][1]), (6, None), (7, ""), (8, "W1 " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(30)] + [(None, docs[3][1]), (40, None), (41, "absent"), (3, "w299 W1"), (42, docs[3][1])]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    t = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, rank string")
    want = brute(docs, items, 50)
    assert found(d, t) == want
    monkeypatch.setattr(op, "SEED_DOCS", 64)
    monkeypatch.setattr(op, "CHUNK_ENTRIES", 3000)
    assert found(d, t, block_bytes=600) == want
    assert found(d, t, top=3) == brute(docs, items, 3)
    assert found(d.limit(0), t) == [] == found(d, t.limit(0))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    width = 200
    ptr, col, val = [0], [], []
    for _ in range(2000):
        topic = rng.integers(0, 10) * 20
        cols = np.unique(np.concatenate([topic + rng.integers(0, 20, 10), rng.integers(0, width, 2)]))
        col += cols.tolist()
        val += (rng.integers(1, 1000, len(cols)) * 10_000_000).tolist()
        ptr.append(len(col))
    rows = op.Entries(np.array(ptr), np.array(col), np.array(val))
    tree = op.BallTree(rows, width, leaf=16)
    rank = np.arange(2000)
    dense = np.zeros((2000, width), np.int64)
    dense[rows.owners(), rows.col] = rows.val

    def nodes(node):
        yield node
        for child in node.children:
            yield from nodes(child)

    visited = 0
    for topic in range(10):
        terms = np.sort(topic * 20 + rng.permutation(20)[:8])
        exact = dense[:, terms].sum(1)
        for node in nodes(tree.root):
            assert node.bound(terms) >= exact[tree.place[node.start : node.stop]].max()
        best = np.lexsort((rank, -exact))[:10]
        places, scores, leaves = tree.search(terms, 1, 10, rank)
        assert places[np.lexsort((rank[places], -scores))].tolist() == best.tolist()
        visited += leaves
    assert visited < 0.5 * 10 * len(tree.order)


def test_long_texts_use_whole_numbers_beyond_64_bits():
    q = op.Queries({b"a": 0}, [1], [np.array([0])], np.array([5]), 10**10, 10**12)
    n = np.array([10**9])
    m = 50 + 50 * 10**9 * 10**10 // 10**12
    assert op._values(n, np.array([0]), np.array([3]), np.array([1]), q)[0] == 5 * (3 * 10**9 // (3000 + 20 * m))
