"""The pipeline against its stages' rules, on given rows and on planted ones."""

import random

import corpus_pipeline
from wayloom.llm import toxicity


def test_stages_keep_columns_and_run_matches(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    want = sorted(map(str, last.drop("text").collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).drop("text").collect())) == want and want


def test_planted_cases(spark, tmp_path):
    rng = random.Random(9)
    words = [f"plain{i}" for i in range(2000)]

    def prose(lines, n=12):
        return "\n".join(" ".join(rng.choice(words) for _ in range(n)) for _ in range(lines))

    docs = {i: prose(rng.randrange(1, 6)) for i in range(300)}
    toxic = {i for i in range(300) if i % 6 == 0}
    for i in toxic:
        docs[i] += "\nvile sludge and more vile words, sludge"
    base = " ".join(rng.choice(words) for _ in range(120))
    docs[1001] = base
    docs[1002] = base + " extra"  # a near copy in one line
    docs[1003] = docs[1]  # a short exact copy or a whole repeated run
    passage = prose(6)
    docs[1004] = "own start\n" + passage
    docs[1005] = "other start\n" + passage + "\nother end"
    item = " ".join(rng.choice(words) for _ in range(30))
    docs[1006] = prose(2) + " " + item
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == set(docs) - toxic - {1002, 1003, 1006}
    assert rows[1004]["text"] == docs[1004] and rows[1005]["text"] == "other start\nother end"
    assert all(rows[i]["text"] == docs[i] for i in rows if i != 1005)
    assert toxicity.THRESHOLD == 0.3


def test_near_duplicate_stage_links_five_word_shingles_at_80_percent(spark):
    near = [f"near{i}" for i in range(70)]  # 56 of 66 shingles of five words, 58 of 68 of three: 0.85 either way
    far = [f"far{i}" for i in range(70)]  # 46 of 66 shingles of five words: 0.70
    texts = [near[:60], near, far[:50], far, ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4, 5]


def test_columns_of_the_caller_pass_every_stage(spark, tmp_path):
    rng = random.Random(3)
    words = [f"plain{i}" for i in range(500)]
    body = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    rows = [(None if i % 10 == 9 else i, t, f"s{i % 2}", f"g{i}", i, i, {"k": i}, f"n{i}") for i, t in enumerate(body)]
    rows += [rows[0], rows[9], rows[9]]
    names = "doc_id long, text string, source string, gone string, _gone int, _key int, row map<string,int>, node string"
    docs = spark.createDataFrame(rows, names)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.schema == docs.schema, name
    want = sorted({str(r) for r in rows})
    assert sorted(str(tuple(r)) for r in now.collect()) == want
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert sorted(str(tuple(r)[: len(docs.columns)]) for r in last.collect()) == want
    assert last.columns == [*docs.columns, "size", "source_size", "target", "taken"]
