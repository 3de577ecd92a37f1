import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from wayloom.llm import tokenfile as op

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def written(docs, tmp_path, **kw):
    folder = f"{tmp_path}/tokens"
    op.write_token_files(docs, folder, PATH, **kw)
    return folder


def test_files_hold_the_tokens_of_whole_texts_in_order(spark, sf_docs, tmp_path, plain):
    folder = written(sf_docs, tmp_path, block_tokens=5000)
    assert spark.read.parquet(f"{folder}/blocks").count() > 10
    rows = {r["doc_id"]: r for r in op.read_token_files(spark, folder, with_ids=True).collect()}
    start = 0
    for doc in sorted(sf_docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*plain.encode(doc["text"] or "", add_special_tokens=False).ids, 1]
        assert rows[doc["doc_id"]] == (doc["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), None, ids)
        start += len(ids)
    some = op.read_token_files(spark, folder, with_ids=True, wanted=F.col("doc_id").isin(3, 150)).collect()
    assert sorted(map(str, some)) == sorted(str(rows[i]) for i in (3, 150))


def test_hard_rows(spark, hard_docs, tmp_path, plain):
    folder = written(hard_docs.withColumn("start", F.lit("mine")), tmp_path)
    rows = sorted(op.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in hard_docs.collect()), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows[:-1]]).tolist()
    want = sorted(str([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in hard_docs.collect())
    assert sorted(str(r["ids"]) for r in rows) == want
    empty = written(hard_docs.limit(0), tmp_path / "none")
    assert op.read_token_files(spark, empty).collect() == []


def test_words_join_to_the_whole_text(plain):
    rng = random.Random(2)
    alphabet = [*"aAbBé Σςİ'st.,!0٣\t\n\r\x0b\x0c\x1c\x85\xa0　́e가", "<|endoftext|>", "'s", "it's ", "中文"]
    words = op._words(open(PATH, encoding="utf-8").read())
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25)))
        assert np.frombuffer(words.ids(pa.array([text]))[0], words.dtype).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], repr(text)


@pytest.mark.parametrize("n", [1, 63, 64, 1000, 200_003])
def test_blocks_round_trip_and_sections(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 40_000)
    table = op.Table.of_counts(*np.unique(ids, return_counts=True))
    assert int(table.shares.sum()) == 1 << op.SCALE_BITS and int(table.shares.min()) > 0
    payload = op.encode_block(ids, table, lanes=64)
    block, slots = op.Block(payload, table), table.slots()
    assert (block.ids(slots) == ids).all()
    for first, stop in [(0, 1), (n - 1, n), (n // 3, n // 2), (5, 5)]:
        assert (block.ids(slots, first, stop) == ids[first:stop]).all()


def test_skewed_table_and_damage(spark, tmp_path):
    ids = np.array([7] * 10_000_000 + list(range(100, 40_000)))
    table = op.Table.of_counts(*np.unique(ids, return_counts=True))
    assert int(table.shares.sum()) == 1 << op.SCALE_BITS and int(table.shares.min()) > 0
    payload = bytearray(op.encode_block(ids[-50_000:], table))
    payload[5000] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        op.Block(bytes(payload), table)
    folder = written(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id int, text string"), tmp_path)
    broken = F.overlay("payload", F.lit(b"x"), F.octet_length("payload"))
    spark.read.parquet(f"{folder}/blocks").withColumn("payload", broken).write.parquet(f"{tmp_path}/broken/blocks")
    spark.read.parquet(f"{folder}/table").write.parquet(f"{tmp_path}/broken/table")
    rows = op.read_token_files(spark, f"{tmp_path}/broken").collect()
    assert {(r["doc_id"], r["ids_crc32"]) for r in rows} == {(1, None), (2, None)} and all("checksum" in r["error"] for r in rows)
