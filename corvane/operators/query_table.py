"""R1-R3 for a table of queries: stored postings with their weight, and a top k by score bounds.

The index holds, for each term and row, what the term adds to the row's BM25 score, and for each term the largest such
weight.  A query's terms are put in order of that bound.  The first ones, which make up most of what a row can reach, are
joined with their postings; their k-th best partial score is a floor.  If what the other terms can add is below the floor,
only rows that can still reach it are looked up in the other terms' postings (which are the long ones); queries for which
it is not read all of theirs.  The result is that of a full evaluation either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import cut

#: Grows when the stored form changes.
LAYOUT = 1
#: Postings of one file, and folders at most.
FILE_ROWS, MOST_BUCKETS = 2_000_000, 4096
#: Share of a query's bound that its first terms hold at least.
FIRST_SHARE = 0.6


def build(docs: DataFrame, folder: str, *, row_id: str, content: Column, title: Column | None = None, title_weight: float = 3.0, k1: float = 1.2, b: float = 0.75) -> None:
    """Writes `postings` (by bucket of the term, sorted), `terms` and `corpus`; content and title are arrays of tokens, hits in the title count `title_weight`."""
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(row_id).alias("id"), F.coalesce(content, none).alias("c"), F.coalesce(title if title is not None else none, none).alias("t"))
    rows = rows.withColumn("len", F.size("c") + F.size("t"))
    corpus = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))
    one = corpus.head()  # one row
    weighted = rows.select("id", "len", F.explode(F.concat(F.transform("c", lambda x: F.struct(x.alias("term"), F.lit(1.0).alias("w"))), F.transform("t", lambda x: F.struct(x.alias("term"), F.lit(title_weight).alias("w"))))).alias("x"))
    tf = cut(weighted.groupBy("id", "len", "x.term").agg(F.sum("x.w").alias("tf")), "tf")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((one.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (one.avg_len or 1.0)))
    postings = cut(tf.join(df, "term").select("term", "id", weight.alias("weight")), "weights")
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("weight").alias("bound"))
    n = postings.count()
    buckets = min(MOST_BUCKETS, n // FILE_ROWS + 1)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    sizes = terms.groupBy(bucket.alias("bucket")).agg(F.sum("df").alias("rows")).select("bucket", F.ceil(F.col("rows") / FILE_ROWS).cast("int").alias("files"))  # a row a bucket
    dealt = postings.withColumn("bucket", bucket).join(F.broadcast(sizes), "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("files")))  # a frequent term goes over several files
    dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "term", "id").select("term", "id", "weight", "bucket").write.partitionBy("bucket").parquet(f"{folder}/postings")
    terms.write.parquet(f"{folder}/terms")
    docs.sparkSession.createDataFrame([(one.n, float(one.avg_len or 0), buckets)], "n bigint, avg_len double, buckets int").coalesce(1).write.parquet(f"{folder}/corpus")


def _top(scored: DataFrame, top: int) -> DataFrame:
    """Best rows of each query; sorted and cut in each task before they meet (a limit on the rank is pushed below the shuffle)."""
    w = W.partitionBy("qid").orderBy(F.round("score", 6).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)


def split_terms(queries: DataFrame, terms: DataFrame, share: float = FIRST_SHARE) -> DataFrame:
    """qid, term, bound, first, rest: each query's known terms, whether they are among the first, and what the others can add."""
    asked = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term")).join(terms.select("term", "bound"), "term")
    w = W.partitionBy("qid")  # a query's own terms
    before = F.coalesce(F.sum("bound").over(w.orderBy(F.col("bound").desc(), "term").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    placed = asked.withColumns({"total": F.sum("bound").over(w), "before": before}).withColumn("first", F.col("before") < share * F.col("total"))
    return placed.withColumn("rest", F.sum(F.when(F.col("first"), 0.0).otherwise(F.col("bound"))).over(w)).select("qid", "term", "bound", "first", "rest")


def search(spark: SparkSession, folder: str, queries: DataFrame, top: int = 10, *, share: float = FIRST_SHARE) -> DataFrame:
    """qid, id, score and rank of the best `top` rows of each query (qid, terms)."""
    buckets = spark.read.parquet(f"{folder}/corpus").head()["buckets"]  # one row
    postings = spark.read.parquet(f"{folder}/postings")
    asked = cut(split_terms(queries, spark.read.parquet(f"{folder}/terms"), share).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")), "asked")
    first = postings.join(asked.where("first").select("qid", "term", "bucket"), ["bucket", "term"])
    partial = cut(first.groupBy("qid", "id").agg(F.sum("weight").alias("score")), "partial")
    floor = _top(partial, top).where(F.col("rank") == top).select("qid", F.col("score").alias("floor"))  # no row where fewer were found
    rest = asked.where("NOT first")
    state = cut(rest.groupBy("qid").agg(F.first("rest").alias("rest")).join(floor, "qid", "left").withColumn("whole", F.col("floor").isNull() | (F.col("rest") >= F.col("floor") - 1e-5)), "floors")
    # where the floor holds: the rows that can reach it, and their postings only
    open_ = partial.join(state.where("NOT whole"), "qid").where(F.col("score") + F.col("rest") >= F.col("floor") - 1e-5).select("qid", "id")
    wanted = open_.join(rest.select("qid", "term", "bucket"), "qid")
    some = postings.join(wanted, ["bucket", "term", "id"]).select("qid", "id", F.col("weight").alias("score"))
    # where it does not: all postings of the other terms
    all_ = postings.join(rest.join(state.where("whole").select("qid"), "qid").select("qid", "term", "bucket"), ["bucket", "term"]).select("qid", "id", F.col("weight").alias("score"))
    return _top(partial.unionAll(some).unionAll(all_).groupBy("qid", "id").agg(F.sum("score").alias("score")), top)
