import itertools
import math
import random
import zlib

import numpy as np
import pytest

from wayloom.llm import toxicity as op


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        e, moves = rng.normal(size=n), rng.normal(size=(2, 2))
        first = np.zeros(n, bool)
        first[0] = True
        first[n // 2] = True
        total, each = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            score = math.exp(sum(e[i] * path[i] for i in range(n)) + sum(moves[path[i - 1], path[i]] for i in range(n) if not first[i]))
            total += score
            each += score * np.array(path)
        assert np.allclose(op.marginals(e, first, moves)[0], each / total)


def test_long_chains_do_not_depend_on_blocks():
    rng = np.random.default_rng(2)
    e, moves, first = rng.normal(size=1000) * 3, rng.normal(size=(2, 2)), rng.random(1000) < 0.01
    first[0] = True
    p, a, _ = op.marginals(e, first, moves)
    t, odds = np.exp(moves), 0.0
    for i in range(1000):
        odds = math.exp(e[i]) * (1.0 if first[i] else (t[0, 1] + t[1, 1] * odds) / (t[0, 0] + t[1, 0] * odds))
        assert a[i] == pytest.approx(odds)
    assert (p >= 0).all() and (p <= 1).all()


def planted(n=900):
    rng = random.Random(4)
    words = [f"plain{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        bad = i % 7 == 0
        if bad:
            for _ in range(rng.randrange(2, 5)):
                body.insert(rng.randrange(len(body)), rng.choice(["Vilest", "gruntig", "gruntend", "sludge!"]))
        docs.append((i, " ".join(body)))
        if i % 10:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_spans(spark):
    docs, labels = planted()
    d = spark.createDataFrame(docs + [(5000, None), (5001, ""), (None, "plain1 vilest vilest sludge")], "doc_id long, text string")
    y = spark.createDataFrame(labels + [(7, 1, 1), (None, 1, 1), (8, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = op.fit(d, y)
    rows = op.with_toxicity(d.withColumn("held", op.held_out(d["doc_id"])), model).collect()
    texts = dict(docs)
    wrong = 0
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 5000:
            assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            wrong += r["predicted"] != (r["doc_id"] % 7 == 0)
            for s in r["spans"]:
                assert texts[r["doc_id"]][s["start"] : s["end"]].split()[0].lower().strip("!") in ("vilest", "gruntig", "gruntend", "sludge")
        elif r["doc_id"] is None:
            assert r["predicted"] == 1 and r["spans"]
        else:
            assert r["predicted"] == 0 and r["spans"] == [] and 0 <= r["score"] <= 1
    assert wrong == 0


def test_hard_rows_and_no_labels(spark, hard_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = op.drop_toxic(hard_docs, none)
    assert kept.columns == hard_docs.columns and kept.count() == hard_docs.count()
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    scored = op.with_toxicity(hard_docs, op.fit(hard_docs, one)).collect()
    assert len(scored) == hard_docs.count() and len({r["score"] for r in scored}) == 1
    assert op.with_toxicity(hard_docs.limit(0), op.Model(0.1)).count() == 0
