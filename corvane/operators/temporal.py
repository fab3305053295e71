"""Temporal operators: previous and neighbouring rows, nearest in time, after an anchor, fact histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def previous(df: DataFrame, keys: list[str], time: str, row_id: str, columns: list[str]) -> DataFrame:
    """prev_<column> of the row before in the same session."""
    w = W.partitionBy(*keys).orderBy(time, row_id)
    return df.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in columns))


def nearest(df: DataFrame, anchor: str, time: str, row_id: str, k: int, keys: list[str]) -> DataFrame:
    """The k rows of each key nearest to a time."""
    gap = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lit(anchor).cast("timestamp")))
    w = W.partitionBy(*keys).orderBy("gap_us", row_id)
    return df.withColumn("gap_us", gap).withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= k)


def after_first(df: DataFrame, keys: list[str], is_anchor, time: str, row_id: str, k: int) -> DataFrame:
    """The first k rows of each key strictly after its first anchor row."""
    anchors = df.where(is_anchor).groupBy(*keys).agg(F.min(time).alias("anchor_ts"))
    later = df.join(anchors, keys).where(F.col(time) > F.col("anchor_ts"))
    w = W.partitionBy(*keys).orderBy(time, row_id)
    return later.withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= k)


def neighbours(df: DataFrame, centre_id, keys: list[str], time: str, row_id: str, before: int, after: int) -> DataFrame:
    """The centre row and its neighbours in time within the same group; strictly earlier and strictly later ones."""
    centre = df.where(F.col(row_id) == centre_id).select(*keys, F.col(time).alias("centre_ts"))
    near = df.join(F.broadcast(centre.limit(1)), keys)  # one row
    lead = near.where(F.col(time) < F.col("centre_ts")).orderBy(F.col(time).desc(), F.col(row_id).desc()).limit(before).withColumn("place", F.lit("before"))
    tail = near.where(F.col(time) > F.col("centre_ts")).orderBy(time, row_id).limit(after).withColumn("place", F.lit("after"))
    return lead.unionAll(near.where(F.col(row_id) == centre_id).withColumn("place", F.lit("centre"))).unionAll(tail).drop("centre_ts")


def conflicts(facts: DataFrame, keys: list[str], value: str, time: str, row_id: str) -> DataFrame:
    """Consecutive facts of one key with differing values, older and newer."""
    w = W.partitionBy(*keys).orderBy(time, row_id)
    return facts.select(*keys, F.col(row_id).alias("older_id"), F.col(value).alias("older_value"), F.lead(row_id).over(w).alias("newer_id"), F.lead(value).over(w).alias("newer_value")).where(F.col("older_value") != F.col("newer_value"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """The latest right row at or before each left row of the same key: one union, one sort, one window; no pairs are made."""
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns), F.lit(None).cast("int").alias("_r"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *columns, F.lit(1).alias("_r"))
    w = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn("_last", F.last(F.when(F.col("_r") == 1, F.struct(*columns)), ignorenulls=True).over(w))
    return filled.where("_side = 1").select("_row.*", *(F.col(f"_last.{c}").alias(f"asof_{c}") for c in columns))


def valid_intervals(facts: DataFrame, keys: list[str], time: str, row_id: str) -> DataFrame:
    """Adds valid_from and valid_to: each fact holds until the next one of its key."""
    w = W.partitionBy(*keys).orderBy(time, row_id)
    return facts.withColumn("valid_from", F.col(time)).withColumn("valid_to", F.lead(time).over(w))
