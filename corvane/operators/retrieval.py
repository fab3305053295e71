"""Retrieval: lexical scans, BM25, rank fusion, reranking and shaping as one lazy plan; scalars are computed on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import cut


def lexical_scan(df: DataFrame, row_id: str, title: Column, content: Column, terms: list[str], newest: Column, window: int) -> DataFrame:
    """Over the newest rows, 2 for each term in the title and 1 in the content; rows without a hit go."""
    hits = reduce(lambda a, b: a + b, [2 * F.contains(F.lower(title), F.lit(t)).cast("int") + F.contains(F.lower(content), F.lit(t)).cast("int") for t in terms])
    return df.orderBy(newest.desc(), F.col(row_id).desc()).limit(window).select(row_id, hits.cast("double").alias("raw")).where("raw > 0")


def bm25(docs: DataFrame, row_id: str, tokens: Column, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """R2: BM25 of the query terms; the corpus figures are one row, and only the query's terms are exploded and counted."""
    rows = docs.select(row_id, tokens.alias("_tokens")).select(row_id, F.size("_tokens").alias("len"), F.filter("_tokens", lambda t: t.isin(terms)).alias("_hits"))
    corpus = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = rows.where(F.size("_hits") > 0).select(row_id, "len", F.explode("_hits").alias("term")).groupBy(row_id, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus)).groupBy(row_id).agg(F.sum(part).alias("raw"))  # both sides bounded by the query


def postings(docs: DataFrame, row_id: str, tokens: Column) -> DataFrame:
    """S3: an inverted index: term, row, tf and len of every term of every row; a row without terms has the term ''."""
    rows = docs.select(row_id, tokens.alias("_tokens")).withColumn("len", F.size("_tokens"))
    terms = rows.select(row_id, "len", F.explode_outer("_tokens").alias("term"))
    return terms.groupBy(row_id, F.coalesce("term", F.lit("")).alias("term"), "len").agg(F.count("*").alias("tf"))


#: Postings of one file of a stored index; folders at most.
FILE_ROWS, MOST_BUCKETS = 2_000_000, 4096


def store_index(found: DataFrame, folder: str, row_id: str) -> None:
    """Writes postings by bucket of the term, sorted by term, so that a query reads its terms' row groups only; and the corpus figures.

    Buckets and files follow the number of postings; a frequent term goes over several files, each written by its own task.
    """
    held = cut(found, "postings")
    buckets = min(MOST_BUCKETS, held.count() // FILE_ROWS + 1)
    bucketed = held.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    sizes = bucketed.groupBy("bucket").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("files"))  # a row a bucket
    dealt = bucketed.join(F.broadcast(sizes), "bucket").withColumn("part", F.pmod(F.xxhash64(row_id), F.col("files")))
    dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "term", row_id).drop("part", "files").write.partitionBy("bucket").parquet(f"{folder}/postings")
    rows = held.groupBy(row_id).agg(F.any_value("len").alias("len"))
    rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/corpus")


def bm25_indexed(spark, folder: str, row_id: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """R2 on a stored index: only the buckets, row groups and columns of the query's terms are read."""
    dealt = spark.read.parquet(f"{folder}/corpus").head()["buckets"]  # one row
    buckets = [F.pmod(F.xxhash64(F.lit(t)), F.lit(dealt)) for t in terms]
    tf = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(*buckets) & F.col("term").isin(terms)).select(row_id, "term", "tf", "len")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
    corpus = spark.read.parquet(f"{folder}/corpus")  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus)).groupBy(row_id).agg(F.sum(part).alias("raw"), F.count("*").alias("n_terms"))


def all_or_any(scored: DataFrame, terms: list[str]) -> DataFrame:
    """R2: rows with all of the terms; only where there is none, rows with any of them.  scored: n_terms and what is kept."""
    whole = scored.agg((F.max("n_terms") == len(set(terms))).alias("_all"))  # one row
    return scored.crossJoin(F.broadcast(whole)).where(~F.col("_all") | (F.col("n_terms") == len(set(terms)))).drop("_all", "n_terms")


def ranked(df: DataFrame, row_id: str, score: str, top: int, name: str) -> DataFrame:
    """0-based rank of the best `top` positive scores; ties by id.  The window sees `top` rows only."""
    head = df.where(F.col(score) > 0).orderBy(F.col(score).desc(), row_id).limit(top)
    return head.withColumn(name, (F.row_number().over(W.orderBy(F.col(score).desc(), row_id)) - 1).cast("bigint"))


def normalised(df: DataFrame, score: str, out: str) -> DataFrame:
    """A20 over a whole candidate set: bounds are one aggregated row."""
    bounds = df.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    value = F.when(F.col("_high") == F.col("_low"), 1.0).otherwise((F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, value).drop("_low", "_high")  # one row


def fuse(channels: dict[str, DataFrame], row_id: str, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked channels (row_id, rank): one union and one aggregate."""
    parts = [df.select(row_id, F.lit(weights.get(name, 1.0)).alias("w"), F.col("rank"), F.lit(name).alias("channel")) for name, df in channels.items()]
    union = reduce(lambda a, b: a.unionAll(b), parts)
    ranks = [F.min(F.when(F.col("channel") == name, F.col("rank"))).alias(f"{name}_rank") for name in channels]
    return union.groupBy(row_id).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("rrf"), *ranks)


def superseded_penalty(df: DataFrame, superseded: Column, score: str, factor: float = 0.5) -> DataFrame:
    """Superseded rows keep half their score."""
    return df.withColumn(score, F.when(superseded, F.col(score) * factor).otherwise(F.col(score)))


def simple_rerank(score: Column, title: Column, content: Column, query: str, terms: list[str], recency: Column) -> Column:
    """.7 score, .2 title is the query, .08 share of the query's terms found, .02 recency."""
    found = reduce(lambda a, b: a + b, [(F.contains(F.lower(title), F.lit(t)) | F.contains(F.lower(content), F.lit(t))).cast("double") for t in terms])
    return 0.7 * score + F.when(F.lower(title) == query.lower(), 0.2).otherwise(0.0) + 0.08 * found / len(terms) + 0.02 * recency


def no_memory(top_score: float | None, strong: dict[str, float]) -> bool:
    """Nothing found: the best score is under .1 and no channel has strong evidence."""
    least = {"lexical": 0.35, "vector": 0.2, "precision": 0.18, "graph": 0.18}
    return (top_score or 0.0) < 0.1 and not any(strong.get(k, 0.0) >= v for k, v in least.items())


def recall_score(title: Column, body: Column, phrase: str, terms: list[str]) -> Column:
    """3 for the phrase, 2 for a term in the title, 1 in the body."""
    text = F.lower(F.concat_ws(" ", title, body))
    parts = [2 * F.contains(F.lower(title), F.lit(t)).cast("bigint") + F.contains(F.lower(body), F.lit(t)).cast("bigint") for t in terms]
    return reduce(lambda a, b: a + b, parts, 3 * F.contains(text, F.lit(phrase.lower())).cast("bigint"))


def temporal_rerank(ranked_rows: DataFrame, row_id: str, final: str, state: Column, anchor: str, limit: int, descending: bool) -> DataFrame:
    """The first max(90, 8 * limit) rows by `final` are ordered anew by state score, then time; all others stay behind.

    Where no state score differs from 0 the order stays.  Only the head (a fixed number of rows) is sorted in one place.
    """
    best = [F.col(final).desc(), F.col(row_id)]
    head = ranked_rows.withColumn("_state", state).orderBy(*best).limit(max(90, 8 * limit))
    any_ = head.agg(F.max(F.col("_state") != 0).alias("_any"))  # one row
    time = F.col(anchor).desc() if descending else F.col(anchor).asc()
    w = W.partitionBy(F.lit(0))
    placed = head.crossJoin(F.broadcast(any_)).withColumns({"_old": F.row_number().over(w.orderBy(*best)), "_new": F.row_number().over(w.orderBy(F.col("_state").desc(), time, *best))})
    return placed.select(row_id, F.col("_state").cast("bigint").alias("state"), F.when(F.col("_any"), F.col("_new")).otherwise(F.col("_old")).cast("bigint").alias("place")).where(F.col("place") <= limit)


def resume_pack(rows: DataFrame, key: str, order: str, is_summary: Column, importance: Column, budget: int, half: float = 8.0) -> DataFrame:
    """Of each key the latest summary, then the best rows by importance * exp(-age / half) while their tokens fit the budget.

    rows: key, order, tokens.  age: places behind the latest row.
    """
    newest = rows.groupBy(key).agg(F.max(order).alias("_newest"), F.max(F.when(is_summary, F.col(order))).alias("_summary"))
    scored = rows.join(newest, key).withColumns({"_latest": F.coalesce(F.col(order) == F.col("_summary"), F.lit(False)), "_score": importance * F.exp(-(F.col("_newest") - F.col(order)) / half)})
    w = W.partitionBy(key).orderBy(F.col("_latest").desc(), F.col("_score").desc(), F.col(order).desc())
    placed = scored.withColumns({"place": F.row_number().over(w).cast("bigint"), "spent": F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0))})
    return placed.where(F.col("_latest") | (F.col("spent") <= budget)).select(key, order, F.when(F.col("_latest"), "summary").otherwise("item").alias("section"), "place", "spent")
