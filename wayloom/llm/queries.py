"""Registered corpus queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import balltree, centroids, chat, decontam, html, jaccard, licenses, lines, media, mixing, tokenfile, toxicity, urls
from wayloom.llm.common import shared_path, table

#: Tokenizers file of op 12, by its name in the public_tokenizers module.
TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op10_benchmark_decontamination", decontam.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op2_tool_call_linking")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.messages_to_calls(table(spark, sf_dir, "conversations"))
    return chat.link_tool_calls(calls, results, chat.default_schemas(spark))


@query("op3_source_mix", mixing.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, sf_dir)


@query("op4_ngram_jaccard", jaccard.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_gif_media")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_texts(table(spark, sf_dir, "documents")))


@query("op6_toxicity_crf")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs, model, keep_text=False)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_words", "n_toxic", "spans")


@query("op7_url_rules", urls.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


@query("op8_line_dedup", lines.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_deleted"))


@query("op9_html_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op11_centroid_clustering", centroids.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


@query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_path(spark, "tokens")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return tokenfile.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op13_lexical_search", balltree.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
