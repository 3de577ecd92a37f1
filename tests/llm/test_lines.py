import random

from pyspark.sql import functions as F

from wayloom.llm import lines as op


def brute(rows, min_words):
    """Lines that some run of at least min_words words covers which stands earlier, too."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    first, cover = {}, {}
    for key, text in docs:
        split = text.split("\n")
        for i in range(len(split)):
            words = 0
            for j in range(i, len(split)):
                words += len(split[j].split())
                if words >= min_words:
                    run = tuple(split[i : j + 1])
                    if first.setdefault(run, (key, i)) != (key, i):
                        cover.setdefault((key, text), set()).update(range(i, j + 1))
    out = []
    for key, text in rows:
        gone = cover.get((key, text), set())
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        out.append(str((key, kept, len(gone))))
    return sorted(out)


def found(docs, min_words):
    return sorted(str((r["doc_id"], r["text"], r["_gone"])) for r in op.dedup_lines(docs, min_words).collect())


def test_runs_match_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 5))) for _ in range(25)]
    passage = [rng.choice(pool) for _ in range(9)]
    rows = []
    for i in range(60):
        body = [rng.choice(pool) if rng.random() < 0.7 else f"own {i} {j}" for j in range(rng.randrange(1, 25))]
        if i % 3 == 0:
            at = rng.randrange(len(body))
            body[at:at] = passage[: rng.randrange(2, 10)]
        if i % 10 == 0:
            body += ["x y"] * 20
        rows.append((i, "\n".join(body)))
    rows += [(100 + i, rows[7][1]) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for min_words in (4, 10):
        assert found(docs, min_words) == brute(rows, min_words)


def test_hard_rows(spark, hard_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    assert found(hard_docs, 2) == brute(rows, 2)
    cut = op.drop_repeats(hard_docs)
    assert cut.columns == hard_docs.columns and cut.count() == len(rows)
    assert op.drop_repeats(hard_docs.limit(0)).count() == 0


def test_whole_copies_are_dropped_and_counted(spark):
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(8))
    docs = spark.createDataFrame([(1, long, 5), (2, long, 5), (3, "own\n" + long + "\nend", 5), (4, "short", 5), (5, "short", 5)], "doc_id long, text string, n_chars int")
    assert sorted(map(tuple, op.drop_repeats(docs).collect())) == [(1, long, len(long)), (3, "own\nend", 7), (4, "short", 5), (5, "short", 5)]


def test_rows_without_id_take_part_and_columns_pass(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "first\n" + line, "a", 1, 2, {"k": 1}), (1, line + "\nown words", "b", 3, 4, None), (2, "x\n" + line, "c", 5, 6, None), (None, line, "d", 7, 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, _gone int, _lines int, row map<string,int>").withColumn("code", F.lit(9))
    got = op.drop_repeats(docs)
    assert got.columns == docs.columns
    want = [(None, "first", "a", 1, 2, {"k": 1}, 9), (1, rows[1][1], "b", 3, 4, None, 9), (2, "x", "c", 5, 6, None, 9)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert found(docs, 50) == brute([r[:2] for r in rows], 50)


def test_scratch_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("wayloom.llm.common.checkpoint_folder", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(i, "a b c\n" * 30) for i in range(3)], "doc_id long, text string")
    op.drop_repeats(docs).collect()
    assert len(list(tmp_path.iterdir())) == 1  # what the result itself is read from
