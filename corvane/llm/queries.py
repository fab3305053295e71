"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, centroids, line_dedup, lm_trie, main_text, media, mixing, near_dup, phrases, pii, quality, tool_calls, url_reputation

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Path of the ranks and the split pattern used by the queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@_register
def op10_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), *tokenizer())


@_register
def op6_wav_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(_table(spark, sf_dir, "documents"))


@_register
def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("host")


@_register
def op4_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


@_register
def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return url_reputation.judge(_table(spark, sf_dir, "pages"), labels)


ORACLES["op9_host_reputation"] = url_reputation.oracle_sql()


@_register
def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


@_register
def op7_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_register
def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(tool_calls.from_conversations(_table(spark, sf_dir, "conversations")), tool_calls.ASK)


@_register
def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


@_register
def op2_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_trie.score_documents(_table(spark, sf_dir, "documents"))


@_register
def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


ORACLES["op11_dual_tree_lloyd"] = centroids.oracle_sql()


@_register
def op12_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


@_register
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


ORACLES["op13_phrase_collocations"] = phrases.oracle_sql()
