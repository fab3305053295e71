"""Events recorded as one write to all tables that follow from them, and replayed from any place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import consolidation
from corvane.session import cut
from corvane.streaming import commits, ingest

#: Rows of a project and type that a new row may supersede.
RECENT = 50
OBSERVATIONS = (
    "observation_id string, event_id string, platform string, project string, session_id string, event_type string, observation_type string, title string, content string, "
    "tags array<string>, dedupe_hash string, signal double, event_time timestamp, valid_from timestamp, valid_to timestamp, seq bigint"
)
HEADS = "project string, session_id string, observation_id string, title string, content string, ts timestamp"
RECENTS = "project string, observation_type string, observation_id string, ts timestamp, words array<string>"


def observations(batch: DataFrame) -> DataFrame:
    """The rows of a cleaned batch, one of each event and of each hash, with a number that orders them within the commit."""
    one = batch.groupBy("dedupe_hash").agg(F.min_by(F.struct(*batch.columns), F.struct("ts", "event_id")).alias("r")).select("r.*")
    one = one.groupBy("event_id").agg(F.min_by(F.struct(*batch.columns), F.struct("ts", "dedupe_hash")).alias("r")).select("r.*")
    end = F.lit(None).cast("timestamp")
    return one.select(
        F.concat(F.lit("obs_"), "event_id").alias("observation_id"), "event_id", "platform", "project", "session_id", "event_type", "observation_type", F.substring(F.split_part("content", F.lit("\n"), F.lit(1)), 1, 120).alias("title"),
        "content", "tags", "dedupe_hash", F.col("signal").cast("double").alias("signal"), F.col("ts").alias("event_time"), F.col("ts").alias("valid_from"), end.alias("valid_to"), F.monotonically_increasing_id().alias("seq"))


def derived(rows: DataFrame, heads: DataFrame, recents: DataFrame) -> dict[str, DataFrame]:
    """All tables that follow from a batch of observations.

    heads: the last row of each session so far; recents: the newest RECENT rows of each project and type so far.
    """
    key = ["project", "session_id"]
    fresh = rows.select("observation_id", *key, "title", "content", F.col("event_time").alias("ts"))
    # the row before the first of a session is its head from earlier commits
    before = heads.select("observation_id", *key, "title", "content", "ts").join(rows.select(*key).distinct(), key, "left_semi")
    session = F.to_json(F.struct(*key))
    follows = consolidation.auto_link(fresh.unionByName(before).withColumn("_session", session), "observation_id", "_session", "ts", "title", "content").withColumn("weight", F.lit(1.0))
    words = T.token_set(F.col("content"))
    mine = rows.select("project", "observation_type", "observation_id", F.col("event_time").alias("ts"), words.alias("words"))
    kind = ["project", "observation_type"]
    pool = mine.withColumn("_new", F.lit(True)).unionByName(recents.select(*mine.columns).join(mine.select(*kind).distinct(), kind, "left_semi").withColumn("_new", F.lit(False)))
    place = (F.row_number().over(W.partitionBy(*kind).orderBy("ts", "observation_id")) - 1).alias("k")
    placed = pool.select("*", place)
    updates = consolidation.auto_supersede(placed, "observation_id", kind, "k", "words", RECENT).withColumn("relation", F.lit("updates")).select("from_id", "to_id", "relation", "weight")
    new = rows.select(F.col("observation_id").alias("from_id"))
    links = follows.select("from_id", "to_id", "relation", "weight").unionByName(updates).join(new, "from_id", "left_semi")
    newest = pool.withColumn("_n", F.row_number().over(W.partitionBy(*kind).orderBy(F.col("ts").desc(), F.col("observation_id").desc()))).where(F.col("_n") <= RECENT)
    nugget = F.posexplode(consolidation.nuggets(F.col("content"))).alias("place", "nugget")
    return {
        "observations": rows,
        "tags": rows.select("observation_id", F.explode(F.array_distinct("tags")).alias("tag")),
        "entities": rows.select("observation_id", F.explode(F.array_distinct(T.entities(F.col("content")))).alias("entity")),
        "relations": consolidation.name_relations(rows, "observation_id", consolidation.code_names(F.col("content"))),
        "links": links,
        "nuggets": rows.select("observation_id", nugget).select("observation_id", "place", "nugget", F.sha2("nugget", 256).alias("content_hash")),
        "heads": fresh.unionByName(before).groupBy(*key).agg(F.max_by(F.struct("observation_id", "title", "content", "ts"), F.struct("ts", "observation_id")).alias("h")).select(*key, "h.*"),
        "recents": newest.select(*mine.columns),
        "audit": rows.groupBy("project", "event_type").agg(F.count("*").alias("recorded")),
    }


def _state(spark: SparkSession, target: str, table: str, schema: str, keys: list[str]) -> DataFrame:
    rows = commits.read(spark, target, table, schema)
    return commits.latest(rows, rows.select(*keys, "commit").distinct(), keys).drop("commit")


def record(target: str):
    """A foreachBatch function: cleaned events become one commit of all tables.

    A batch that was recorded before is passed over; one that died on the way is written anew.  Events recorded by an
    earlier commit go: the stream's own state keeps hashes for its horizon only.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if commits.committed(spark, target, number):
            return
        held = commits.read(spark, target, "observations", OBSERVATIONS).where(F.col("commit") < number)
        fresh = batch.join(held.select("dedupe_hash"), "dedupe_hash", "left_anti").join(held.select("event_id"), "event_id", "left_anti").select(*batch.columns)
        # the batch's rows are stored first: all tables are derived from the same ones, with the same numbers
        rows = cut(observations(fresh), "batch")
        if rows.isEmpty():  # a batch may only move the watermark
            return
        heads = _state(spark, target, "heads", HEADS, ["project", "session_id"])
        recents = _state(spark, target, "recents", RECENTS, ["project", "observation_type"])
        commits.commit(spark, target, number, derived(rows, heads, recents))

    return write


def run(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Records what files there are, then stops (available-now)."""
    rows = ingest.deduplicated(ingest.clean(ingest.read_events(spark, source)))
    rows.writeStream.foreachBatch(record(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replay(spark: SparkSession, target: str, last: tuple[int, int] | None = None) -> DataFrame:
    """Observations recorded after a place (commit, seq), in order; the last row's place is where the next replay begins.

    Commits before the place are not read.
    """
    number, seq = last or (-1, -1)
    rows = commits.read(spark, target, "observations", OBSERVATIONS, after=number - 1)
    return rows.where((F.col("commit") > number) | ((F.col("commit") == number) & (F.col("seq") > seq))).orderBy("commit", "seq")
