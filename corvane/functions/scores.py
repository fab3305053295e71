"""Scalar score functions as Columns; times are parameters, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time with or without zone (UTC)."""
    return F.unix_micros(time.cast("timestamp"))


def hours_before(now: str, column: str) -> Column:
    """Hours from a time to `now`, not below 0."""
    return F.greatest(F.lit(0.0), (micros(F.lit(now)) - micros(F.col(column))) / 3.6e9)


def recency(now: str, column: str, days: float = 90.0) -> Column:
    """e-folding decay, exp(-age / days)."""
    return F.exp(-hours_before(now, column) / (24 * days))


def decay_tier(now: str, last_used: str) -> Column:
    """F16: hot within a day, warm within a week, else (and where null) cold."""
    age = hours_before(now, last_used)
    return F.when(F.col(last_used).isNull(), "cold").when(age < 24, "hot").when(age < 168, "warm").otherwise("cold")


def decay_factor(tier: Column) -> Column:
    return F.when(tier == "hot", 1.0).when(tier == "warm", 0.7).otherwise(0.4)


def importance(event_type: str, values: dict[str, float], default: float = 0.5) -> Column:
    """F17"""
    out = None
    for k, v in values.items():
        out = F.when(F.col(event_type) == k, v) if out is None else out.when(F.col(event_type) == k, v)
    return out.otherwise(default)


def hit_boost(hits: Column) -> Column:
    """.1 from five hits, .2 from ten."""
    return F.when(hits >= 10, 0.2).when(hits >= 5, 0.1).otherwise(0.0)


def min_max(value: str, *groups: str) -> Column:
    """Min-max over the set; where all are equal, 1."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(value) - low) / (high - low))


def rrf(rank0: Column, weight: float = 1.0, k: int = 60) -> Column:
    """Reciprocal rank of a 0-based rank; absent (null) gives 0."""
    return F.coalesce(weight / (k + rank0), F.lit(0.0))


def retry_wait(attempts: Column) -> Column:
    """M2: min(300, 2^min(n, 8)) seconds."""
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(attempts, F.lit(8))))


#: R7 weights. Lexical, vector, recency, tag, importance, graph.
WEIGHTS = {
    "base": (0.30, 0.25, 0.20, 0.10, 0.08, 0.07),
    "hybrid": (0.30, 0.30, 0.15, 0.10, 0.10, 0.05),
    "profile": (0.45, 0.15, 0.10, 0.20, 0.05, 0.05),
    "timeline": (0.20, 0.15, 0.45, 0.05, 0.15, 0.0),
    "freshness": (0.25, 0.20, 0.45, 0.05, 0.05, 0.0),
    "graph": (0.15, 0.15, 0.10, 0.05, 0.10, 0.45),
    "vector": (0.10, 0.55, 0.10, 0.05, 0.15, 0.05),
}


def weights(profile: str, *, vector_coverage: float = 1.0) -> dict[str, float]:
    """A profile's weights, without the vector's where too few rows have one, normalised to 1."""
    got = dict(zip(("lexical", "vector", "recency", "tag", "importance", "graph"), WEIGHTS[profile]))
    if vector_coverage < 0.2:
        got["vector"] = 0.0
    total = sum(got.values())
    return {k: v / total for k, v in got.items()}
