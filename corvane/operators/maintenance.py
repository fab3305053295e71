"""Policies over stored rows: forgetting, leases, passage containment, order-dependent merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.scores import hours_before


def forget_candidates(obs: DataFrame, now: str, threshold: float = 0.7, limit: int = 1000, least_days: float = 30.0) -> DataFrame:
    """M8: .4 access + .3 signal + .3 age; protected rows never, expired ones always (score 1), others from 30 days on and never accessed."""
    age = hours_before(now, "created_at") / 24
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    access = F.when(F.col("access_count") <= 0, 1.0).otherwise(clamp(1 - F.col("access_count") / 5))
    composite = F.round(0.4 * access + 0.3 * clamp(1 - clamp(F.col("signal_score"))) + 0.3 * clamp((age - 30) / 150), 4)
    expired = F.coalesce(F.col("expires_at") <= F.lit(now).cast("timestamp"), F.lit(False))
    scored = obs.where(~F.col("is_protected")).withColumn("score", F.when(expired, 1.0).otherwise(composite))
    return scored.where(expired | ((F.col("score") >= threshold) & (age >= least_days) & (F.col("access_count") == 0))).orderBy(F.col("score").desc(), "id").limit(limit)


def live_leases(events: DataFrame, now: str, ttl_s: int) -> DataFrame:
    """Targets whose latest event is an acquisition that has not run out; events: target, kind, ts, event_id."""
    last = events.groupBy("target").agg(F.max(F.struct("ts", "event_id", "kind")).alias("last")).where("last.kind = 'acquire'")
    ends = F.timestamp_micros(F.unix_micros(F.col("last.ts").cast("timestamp")) + ttl_s * 1_000_000)
    return last.select("target", F.col("last.ts").alias("acquired_at"), ends.cast("timestamp_ntz").alias("expires_at")).where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))


def _with_word_keys(df: DataFrame, size: int) -> DataFrame:
    """Adds `keys`, the hash of each run of `size` words of the array `w`, put together from the runs of its halves.

    Each length is a column of its own step, so that it is computed once.
    """
    made = {1: "_h1"}
    df = df.where(F.size("w") >= size).withColumn("_h1", F.transform("w", lambda w: F.xxhash64(w)))

    def add(df: DataFrame, n: int) -> DataFrame:
        if n in made:
            return df
        left = n // 2 if n % 2 == 0 else n - 1
        df = add(df, left)
        first, second, runs = F.col(made[left]), F.col(made[n - left]), F.greatest(F.size(made[left]) - (n - left), F.lit(0))
        made[n] = f"_h{n}"
        return df.withColumn(made[n], F.zip_with(F.slice(first, 1, runs), F.slice(second, left + 1, runs), lambda a, b: F.xxhash64(a, b)))

    return add(df, size).withColumn("keys", F.col(made[size])).drop(*made.values())


def contained_passages(docs: DataFrame, passages: DataFrame, head: int = 8, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(document, passage) where the document contains the whole passage.

    A passage with whole words between its first and last is found by the hash of up to `head` of them, which a document
    must have in a row; only these pairs are verified.  Passages of one or two words have none, and are looked for in
    each text; however many they are, all take part, and many are joined block by block.
    """
    words = F.split(F.col("text"), r"\s+")
    keyed = passages.select(item_id, F.col("text").alias("passage"), words.alias("w")).where(F.length("passage") > 0)
    keyed = keyed.withColumn("n", F.least(F.size("w") - 2, F.lit(head)))
    short = keyed.where("n < 1").select(item_id, "passage")
    pairs = None
    for size in sorted(r[0] for r in keyed.where("n >= 1").select("n").distinct().collect()):  # numbers up to `head`
        inner = _with_word_keys(keyed.where(F.col("n") == size).select(item_id, F.slice("w", 2, size).alias("w")), size).select(item_id, F.col("keys")[0].alias("key"))
        grams = _with_word_keys(docs.select(doc_id, words.alias("w")), size).select(doc_id, F.explode_outer("keys").alias("key"))  # a plain explode would compute the keys once more to filter
        part = grams.join(inner, "key").select(doc_id, item_id)
        pairs = part if pairs is None else pairs.unionAll(part)
    brief = docs.join(short, F.contains("text", F.col("passage"))).select(doc_id, item_id)  # no hint: a large side goes partition by partition
    if pairs is None:
        return brief.distinct()
    # Numbers meet first; the texts of the pairs found come after.
    long = pairs.distinct().join(docs.select(doc_id, "text"), doc_id).join(keyed.select(item_id, "passage"), item_id).where(F.contains("text", F.col("passage"))).select(doc_id, item_id)
    return long.unionAll(brief).distinct()


def verified(rows: DataFrame, sources: DataFrame, key: str, conflict: Column, empty: Column) -> DataFrame:
    """Each row with what its source says of it: missing_event, time_conflict, empty or verified.

    sources: key and what the Columns need, a row for each key.
    """
    known = sources.withColumn("_there", F.lit(True))
    status = F.when(F.col("_there").isNull(), "missing_event").when(conflict, "time_conflict").when(empty, "empty").otherwise("verified")
    return rows.join(known, key, "left").withColumn("status", status)


def manifest(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and key figures of each table, to be stored with a backup and compared after it is read back."""
    out = None
    for name, (df, key) in tables.items():
        k = F.col(key).cast("bigint")
        one = df.agg(F.count("*").alias("n_rows"), F.sum(k).alias("key_sum"), F.min(k).alias("key_min"), F.max(k).alias("key_max")).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionAll(one)
    return out


def backup(tables: dict[str, tuple[DataFrame, str]], folder: str) -> bool:
    """Writes the tables and their manifest, reads them back, and says whether the figures agree."""
    before = manifest(tables)
    for name, (df, _) in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    before.coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
    spark = before.sparkSession
    after = manifest({name: (spark.read.parquet(f"{folder}/{name}"), key) for name, (_, key) in tables.items()})
    written = spark.read.schema(before.schema).json(f"{folder}/_manifest")
    return after.exceptAll(written).isEmpty() and written.exceptAll(after).isEmpty()


def vector_repair(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Id and action: prune vectors without a row, backfill rows without a vector, reindex stale vectors.

    rows: id.  vectors: id, stale.
    """
    both = rows.distinct().withColumn("_row", F.lit(True)).join(vectors.withColumn("_vector", F.lit(True)), "id", "full")
    action = F.when(F.col("_row").isNull(), "prune").when(F.col("_vector").isNull(), "backfill").when(F.col("stale"), "reindex")
    return both.select("id", action.alias("action")).where("action IS NOT NULL")


def archived(rows: DataFrame, which: Column, content: str) -> tuple[DataFrame, DataFrame]:
    """The rows with stubs in place of what is archived (state 'archived', no content), and the archive."""
    chosen = F.coalesce(which, F.lit(False))
    stub = rows.withColumns({content: F.when(~chosen, F.col(content)), "state": F.when(chosen, "archived").otherwise(F.col("state"))})
    return stub, rows.where(chosen)


def restored(rows: DataFrame, archive: DataFrame, wanted: DataFrame, key: str, content: str) -> DataFrame:
    """The rows with the content of the wanted archived ones back in place, and live again."""
    back = archive.join(wanted.select(key).distinct(), key, "left_semi").select(key, F.col(content).alias("_content"), F.lit(True).alias("_back"))
    return rows.join(back, key, "left").withColumns({content: F.when(F.col("_back"), F.col("_content")).otherwise(F.col(content)), "state": F.when(F.col("_back"), "live").otherwise(F.col("state"))}).drop("_content", "_back")


def purged(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows that stay; gone: id."""
    return rows.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def purge_manifest(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> DataFrame:
    """For each table, the rows that a purge takes and leaves; checked before anything is deleted."""
    out, ids = None, gone.select("id").distinct().withColumn("_gone", F.lit(True))
    for name, (df, key) in tables.items():
        one = df.select(F.col(key).alias("id")).join(ids, "id", "left").agg(F.count("_gone").alias("purged"), F.count_if(F.col("_gone").isNull()).alias("kept")).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionAll(one)
    return out
