"""The model's views over the input tables, for Spark and, word by word, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import table

NOW = "2024-01-31 00:00:00"

#: event_type -> importance. Fixed values of the five importance classes, laid over the table's five types.
IMPORTANCE = {"purchase": 0.9, "signup": 0.8, "view": 0.5, "click": 0.4, "error": 0.2}

EV = """ev AS (SELECT event_id, ts, user_id, event_type, value, props, 'p' || CAST(user_id % 5 AS VARCHAR) AS project, user_id % 3 AS team_id,
  CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS session_id FROM events)"""
OBS = """obs AS (SELECT d.doc_id, d.text AS content, d.source AS project, d.lang, TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 MINUTE AS created_at, d.n_chars,
  coalesce(l.toxic, 0) AS toxic, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"""
#: Facts: the status that a customer's orders of one priority have, from each order to the next.
FACTS = """facts AS (SELECT o_orderkey AS fact_id, o_custkey AS project, o_orderpriority AS fact_key, o_orderstatus AS fact_value, o_orderdate AS valid_from,
  lead(o_orderdate) OVER w AS valid_to, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props", F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project"), (F.col("user_id") % 3).alias("team_id"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.col("text").alias("content"), F.col("source").alias("project"), "lang", F.timestamp_micros(start + F.col("doc_id") * 60_000_000).cast("timestamp_ntz").alias("created_at"), "n_chars",
        F.coalesce("toxic", F.lit(0)).alias("toxic"), "quality")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("fact_key"), F.col("o_orderstatus").alias("fact_value"),
        F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"), F.lead("o_orderkey").over(w).alias("superseded_by"))
