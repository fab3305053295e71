"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next
stage's docs; all but the last return the columns of `documents`.  SQL can't express the stages on near duplicates,
raking and BPE, so ORACLE_SQL is None; tests/llm compares the stages with brute force.

Defined cases, over those of the operators: null and empty texts fail the word rules and go in the first stage; a null
source or language is a group of its own; a null id is the least id for line dedup and is kept apart in near dedup;
repeated rows are copies, of which near dedup keeps one; texts of any length are taken whole; extra columns of any name
are carried to the mixing stage's result, and n_chars follows the text; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, line_dedup, mixing, near_dup, quality
from corvane.llm.queries import tokenizer
from corvane.llm.shared import stored

#: Share of the tokens that the mixing stage keeps.
BUDGET_SHARE = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the word rules or are depleted of all but boilerplate lines go; the others lose such lines."""
    return quality.keep_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one of them."""
    return line_dedup.keep_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_dup.keep_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by their calibrated probabilities."""
    return mixing.sample_documents(docs, budget_share=BUDGET_SHARE)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs, *tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
