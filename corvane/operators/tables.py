"""Table operators: latest-wins upserts, append with dedupe, top-k, pagination and set merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import cut


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the order.

    Without ties in `order` this is a max-by aggregate: partial on the map side, so a hot key costs one row a task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row with the greatest order columns of each key, as a partially aggregated max of a struct (hot keys are safe)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*(c if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns))


def newest_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; Spark's window-group limit prunes within each map task first."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= n)


def append_new(target: DataFrame, arriving: DataFrame, key: str, order: str) -> DataFrame:
    """The arriving rows whose key is new, one of each (the first by `order`)."""
    rest = [c for c in arriving.columns if c not in (key, order)]
    first = arriving.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_first"))
    first = first.select(*(key if c == key else F.col(f"_first.{c}").alias(c) for c in arriving.columns))
    return first.join(target.select(key), key, "left_anti")


def page(df: DataFrame, limit: int, time: str, row_id: str) -> DataFrame:
    """A page of `limit` rows, newest first, and whether more follow (one row is read beyond the page)."""
    head = df.orderBy(F.col(time).desc(), F.col(row_id).desc()).limit(limit + 1)
    w = W.orderBy(F.col(time).desc(), F.col(row_id).desc())  # over limit + 1 rows
    ranked = head.withColumn("position", F.row_number().over(w).cast("bigint"))
    return ranked.withColumn("has_more", F.max("position").over(W.partitionBy(F.lit(0))) > limit).where(F.col("position") <= limit)


def merge_lww(local: DataFrame, remote: DataFrame, key: str, updated: str, values: list[str]) -> DataFrame:
    """Full-outer merge, the later update wins, on ties the local row."""
    a = local.select(key, *(F.col(c).alias(f"l_{c}") for c in [updated, *values]))
    b = remote.select(key, *(F.col(c).alias(f"r_{c}") for c in [updated, *values]))
    remote_wins = F.col(f"l_{updated}").isNull() | (F.col(f"r_{updated}") > F.col(f"l_{updated}"))
    pick = F.coalesce(F.col(f"r_{updated}").isNotNull() & remote_wins, F.lit(False))
    return a.join(b, key, "full").select(key, *(F.when(pick, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(c) for c in [updated, *values]), F.when(pick, "remote").otherwise("local").alias("winner"))


def branch_merge(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows with the action that merging takes: promote where new, skip where the target has the same content."""
    return source.join(target.select(*keys, F.lit(True).alias("_there")).distinct(), keys, "left").withColumn("action", F.when(F.col("_there"), "skip").otherwise("promote")).drop("_there")


def full_outer_counts(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts of several frames by one key, 0 where a frame has none; a union and one aggregate instead of chained joins."""
    union = None
    for name, df in parts.items():
        one = df.select(F.col(key), *(F.lit(1 if n == name else 0).alias(n) for n in parts))
        union = one if union is None else union.unionByName(one)
    return union.groupBy(key).agg(*(F.sum(n).cast("bigint").alias(n) for n in parts))


def running_total(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """Adds the sum of `amount` over all rows up to each one in a total order, without gathering the rows.

    Rows are cut into ranges by bounds from a small sample (by hash); each range is summed on its own and shifted by the
    sums of those before it (one row a range).  The bounds are literals, so both readings of the rows cut them alike.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = cut(df, "to-sum")  # read three times
    # of many rows only those with small hashes are sent on, so that the sample does not grow with the partitions
    share = min(1.0, 64 * n / max(df.count(), 1))
    h = F.xxhash64(*order)
    rows = df.select(*order).where(F.pmod(h, F.lit(1 << 30)) <= share * (1 << 30)).orderBy(h).limit(32 * n).collect()
    sample = sorted({tuple(r) for r in rows if None not in r})
    bounds = [sample[len(sample) * k // n] for k in range(1, n)] if len(sample) >= n else sample
    kinds = [df.schema[c].dataType for c in order]
    literal = lambda b: F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(b, kinds, order)))
    key = F.struct(*(F.col(c) for c in order))
    part = F.size(F.filter(F.array(*map(literal, bounds)), lambda b: b <= key)) if bounds else F.lit(0)
    ranged = df.withColumn("_part", part)
    w = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = ranged.groupBy("_part").agg(F.sum(amount).alias("_s")).select("_part", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_shift"))
    local = F.sum(amount).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(out, local).join(F.broadcast(shifts), "_part").withColumn(out, F.col(out) + F.col("_shift")).drop("_part", "_shift")
