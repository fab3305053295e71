"""Evaluation of retrieval: per-query metrics as aggregates, tests of significance on their totals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.tables import running_total


def ranking_metrics(ranked: DataFrame, sizes: DataFrame, query: str, hit: str, n_relevant: str, rank: str, k: int) -> DataFrame:
    """recall@k, precision@k, reciprocal rank and binary nDCG@k of each query; ranks from 1, unique items.

    ranked: query, rank and whether the item is relevant.  sizes: query and how many items are.
    """
    found = F.col(hit) & (F.col(rank) <= k)
    per = ranked.groupBy(query).agg(F.count_if(found).alias("_hits"), F.min(F.when(found, F.col(rank))).alias("_first"), F.sum(F.when(found, 1 / F.log2(F.col(rank) + 1)).otherwise(0.0)).alias("_dcg"))
    total = sizes.select(query, F.col(n_relevant).alias("_n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return total.join(per, query, "left").select(
        query, (F.coalesce("_hits", F.lit(0)) / F.col("_n")).alias("recall"), (F.coalesce("_hits", F.lit(0)) / k).alias("precision"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"), (F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def order_gain_ndcg(ranked: DataFrame, query: str, rank: str, expected: str, k: int) -> DataFrame:
    """Gain 1 / (1 + |place - expected place|), places from 0, over the gain of the right order."""
    gain = 1 / (1 + F.abs(F.col(rank) - F.col(expected)))
    dcg = F.sum(F.when(F.col(rank) < k, gain / F.log2(F.col(rank) + 2)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(0), F.least(F.count("*"), F.lit(k)).cast("int") - 1), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 2))
    return ranked.groupBy(query).agg((dcg / ideal).alias("ndcg"))


def rank_agreement(ranked: DataFrame, query: str, rank: str, expected: str) -> DataFrame:
    """(Kendall tau + 1) / 2 of retrieved and expected order, plain and with pair weights e^(-0.1 i) + e^(-0.1 j).

    Under two items both are 0.5.  A query's ranking is short (top k), so its pairs are made from one array a query.
    """
    w = W.partitionBy(query).orderBy(rank)
    places = ranked.withColumn("_i", F.row_number().over(w) - 1).groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col(expected).cast("double").alias("e")))).alias("p"))
    pairs = places.select(query, F.size("p").alias("n"), F.posexplode("p").alias("k", "a"), "p").select(query, "n", "a", F.explode_outer(F.slice("p", F.col("k") + 2, F.greatest(F.col("n") - F.col("k") - 1, F.lit(0)))).alias("b"))
    sign, weight = F.signum(F.col("b.e") - F.col("a.e")), F.exp(-0.1 * F.col("a.i")) + F.exp(-0.1 * F.col("b.i"))
    tau = pairs.groupBy(query).agg(F.max("n").alias("n"), F.sum(sign).alias("s"), F.count("b").alias("c"), F.sum(sign * weight).alias("ws"), F.sum(weight).alias("w"))
    half = lambda x: F.when(F.col("n") < 2, 0.5).otherwise((x + 1) / 2)
    return tau.select(query, half(F.try_divide("s", "c")).alias("order_score"), half(F.try_divide("ws", "w")).alias("weighted_score"))


def freshness_at_k(ranked: DataFrame, query: str, rank: str, is_new: Column, is_old: Column, k: int) -> DataFrame:
    """0 if the new item is outside the top k, 1 if no old one is inside, else the share of those that rank below it."""
    per = ranked.where(F.col(rank) <= k).groupBy(query).agg(F.min(F.when(is_new, F.col(rank))).alias("_new"), F.collect_list(F.when(is_old, F.col(rank))).alias("_old"))  # k at most
    below = F.size(F.filter("_old", lambda r: r > F.col("_new")))
    return per.select(query, F.when(F.col("_new").isNull(), 0.0).when(F.size("_old") == 0, 1.0).otherwise(below / F.size("_old")).alias("freshness"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share."""
    p = successes / n
    centre, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (centre - spread) / scale, (centre + spread) / scale


def bootstrap_mean(values: np.ndarray, resamples: int = 10_000, seed: int = 154500, level: float = 0.95) -> tuple[float, float]:
    """Percentile bounds of the mean of per-query scores; seeded."""
    rng = np.random.default_rng(seed)
    means = np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(resamples)])
    tail = (1 - level) / 2 * 100
    return float(np.percentile(means, tail)), float(np.percentile(means, 100 - tail))


def holm(tests: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """In rising order of p, rejected as long as p <= alpha / (m - k); the first failure stops.  One row a hypothesis."""
    w = W.partitionBy(F.lit(0)).orderBy(p, name)
    ranked = tests.select(name, p, (F.row_number().over(w) - 1).cast("bigint").alias("k"), F.count("*").over(W.partitionBy(F.lit(0))).alias("m"))
    passed = (F.col(p) <= alpha / (F.col("m") - F.col("k"))).cast("int")
    return ranked.withColumn("rejected", F.min(passed).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1).drop("m")


def wilcoxon(diffs: DataFrame, diff: str, row_id: str) -> DataFrame:
    """Signed-rank test by the normal approximation; zero differences go, ties are ranked in order of id, not averaged."""
    some = diffs.where(F.col(diff) != 0).select(F.col(diff).alias("d"), F.abs(F.col(diff)).alias("size"), F.col(row_id).alias("id"), F.lit(1).cast("bigint").alias("one"))
    r = running_total(some, ["size", "id"], "one", "r")
    sums = r.agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0)).cast("double").alias("w_plus"))
    n = F.col("n")
    return sums.withColumn("z", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token multisets; both empty gives 1, one empty 0."""
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    whole = F.size(a) + F.size(b)
    return F.when(whole == 0, 1.0).otherwise(2 * common / whole)


def percentiles(df: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group: the smallest value with at least that share of the rows at or below it.

    Rows are counted by value, and the counts summed up over all groups in order, so no group's values come to one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    summed = running_total(counts, [group, value], "_n", "_upto")
    spans = summed.groupBy(group).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_rows"))
    ranked = summed.join(spans, group)
    reached = lambda q: F.col("_upto") - F.col("_start") >= F.greatest(F.ceil(F.lit(q) * F.col("_rows")), F.lit(1))
    return ranked.groupBy(group).agg(*(F.min(F.when(reached(q), F.col(value))).alias(name) for name, q in at.items()))
