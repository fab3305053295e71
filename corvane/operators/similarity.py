"""Similarity joins and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import vectors
from corvane.session import cut


def set_pairs(sets: DataFrame, keys: list[str], low: float, high: float = 1.0) -> DataFrame:
    """a_rep, b_rep, jaccard of the pairs of one group with similarity in [low, high]; sets: _rep, keys, _set (distinct tokens, stored).

    Prefix filter: with tokens in a global order (rarest first), two sets that reach `low` share one of their first
    n - ceil(low * n) + 1 tokens; only numbers travel through this join, and a pair whose sizes and places leave too few
    tokens to share goes at once.  Each pair left is then compared once.
    """
    exploded = sets.select("_rep", *keys, F.explode("_set").alias("_token"))
    frequency = exploded.groupBy("_token").agg(F.count("*").alias("_df"))
    ordered = exploded.join(frequency, "_token").groupBy("_rep", *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_df", "_token"))), lambda s: F.xxhash64(s["_token"])).alias("_set"))
    n = F.size("_set")
    first = F.slice("_set", 1, F.greatest(F.lit(1), n - F.ceil(F.lit(low) * n).cast("int") + 1))
    prefix = cut(ordered.select("_rep", *keys, n.alias("_n"), F.posexplode(first).alias("_at", "_token")), "prefixes")
    a = prefix.select(*keys, "_token", F.col("_rep").alias("a_rep"), F.col("_n").alias("_na"), F.col("_at").alias("_pa"))
    b = prefix.select(*keys, "_token", F.col("_rep").alias("b_rep"), F.col("_n").alias("_nb"), F.col("_at").alias("_pb"))
    most = F.least(F.col("_na") - F.col("_pa"), F.col("_nb") - F.col("_pb"))
    fits = most >= low / (1 + low) * (F.col("_na") + F.col("_nb")) - 1e-9
    pairs = a.join(b, [*keys, "_token"]).where((F.col("a_rep") < F.col("b_rep")) & fits).select("a_rep", "b_rep").distinct()
    of = lambda r, s: sets.select(F.col("_rep").alias(r), F.col("_set").alias(s))
    common = F.size(F.array_intersect("_a", "_b"))
    scored = pairs.join(of("a_rep", "_a"), "a_rep").join(of("b_rep", "_b"), "b_rep").select("a_rep", "b_rep", (common / (F.size("_a") + F.size("_b") - common)).alias("jaccard"))
    return scored.where((F.col("jaccard") >= low) & (F.col("jaccard") <= high))


def token_self_join(df: DataFrame, row_id: str, tokens: str, low: float, high: float = 1.0, groups: list[str] | None = None) -> DataFrame:
    """Pairs of one group with Jaccard similarity of their token sets in [low, high].

    Texts are tokenised once and their sets stored; equal sets are folded before the join (see set_pairs).
    """
    keys = groups or []
    rows = cut(df.select(row_id, *keys, F.array_sort(F.array_distinct(tokens)).alias("_set")), "token-sets").where(F.size("_set") > 0)
    rows = rows.withColumns({"_h1": F.xxhash64("_set"), "_h2": F.xxhash64(F.lit(7), "_set")})
    same = [*keys, "_h1", "_h2"]
    folded = cut(rows.groupBy(*same).agg(F.min(row_id).alias("_rep"), F.any_value("_set").alias("_set")), "folded-sets")
    members = cut(rows.select(row_id, *same).join(folded.select(*same, "_rep"), same).select(row_id, "_rep"), "members")
    reps = set_pairs(folded.select("_rep", *keys, "_set"), keys, low, high)
    # back from the folded sets to the rows
    of = lambda r, i: members.select(F.col("_rep").alias(r), F.col(row_id).alias(i))
    out = reps.join(of("a_rep", "_i"), "a_rep").join(of("b_rep", "_j"), "b_rep").select(F.least("_i", "_j").alias("a_id"), F.greatest("_i", "_j").alias("b_id"), "jaccard")
    if high >= 1:
        twins = of("_r", "_i").join(of("_r", "_j"), "_r").where(F.col("_i") < F.col("_j"))
        out = out.unionAll(twins.select(F.col("_i").alias("a_id"), F.col("_j").alias("b_id"), F.lit(1.0).alias("jaccard")))
    return out


def cosine_top_k(df: DataFrame, query: list[float], k: int, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact top k by cosine; each partition keeps k rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.select(row_id, vectors.cosine(F.col(vector), q).alias("cosine")).orderBy(F.col("cosine").desc(), row_id).limit(k)


def hamming_prefilter_top_k(df: DataFrame, query: list[float], k: int, bits_k: int, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The bits_k nearest by sign bits, then the k best by cosine."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = df.select(row_id, vector, vectors.hamming(vectors.sign_bits(F.col(vector)), vectors.sign_bits(q)).alias("distance")).orderBy("distance", row_id).limit(bits_k)
    return near.select(row_id, "distance", vectors.cosine(F.col(vector), q).alias("cosine")).orderBy(F.col("cosine").desc(), row_id).limit(k)


def cosine_links(df: DataFrame, threshold: float, newest: int, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Pairs with cosine at or above a threshold among the newest rows; `newest` is the operator's own bound, so the pairs are bounded too."""
    head = df.orderBy(F.col(row_id).desc()).limit(newest).select(row_id, vector)
    packed = head.agg(F.collect_list(F.struct(F.col(row_id).alias("id"), F.col(vector).alias("v"))).alias("all"))  # at most `newest` rows
    return (
        head.crossJoin(F.broadcast(packed)).select(F.col(row_id).alias("a_id"), F.col(vector).alias("_a"), F.inline("all"))
        .where(F.col("a_id") < F.col("id")).select("a_id", F.col("id").alias("b_id"), vectors.cosine(F.col("_a"), F.col("v")).alias("cosine")).where(F.col("cosine") >= threshold)
    )
