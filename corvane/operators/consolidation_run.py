"""M3: consolidation as incremental upkeep: only what has changed since a project's mark is worked out anew.

A run takes the sessions that have rows above the mark of their project, extracts their facts anew, and merges and links
the groups (project and type of fact) that had or now have facts of these sessions.  Its tables are one commit; a group's
merges and links of earlier runs are retracted by the later ones, as readers take those of its last run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import consolidation, ordered
from corvane.operators.similarity import set_pairs
from corvane.session import cut
from corvane.streaming import commits

FACTS = "fact_id bigint, project string, session string, fact_type string, created_at bigint, fact_key string, fact_value string, confidence double"
SESSIONS, GROUPS = "project string, session string", "project string, fact_type string"
MERGES = "project string, fact_type string, fact_id bigint, merged_into bigint"
DERIVES = "project string, fact_type string, from_id bigint, to_id bigint, weight double"
MARKS, JOBS = "project string, mark bigint", "project string, session string, facts bigint, status string"


def facts_now(spark: SparkSession, target: str) -> DataFrame:
    """The facts of each session as of its last run."""
    return commits.latest(commits.read(spark, target, "facts", FACTS), commits.read(spark, target, "sessions", SESSIONS), ["project", "session"]).drop("commit")


def _of_groups(spark: SparkSession, target: str, table: str, schema: str) -> DataFrame:
    return commits.latest(commits.read(spark, target, table, schema), commits.read(spark, target, "groups", GROUPS), ["project", "fact_type"]).drop("commit")


def merges_now(spark: SparkSession, target: str) -> DataFrame:
    return _of_groups(spark, target, "merges", MERGES)


def derives_now(spark: SparkSession, target: str) -> DataFrame:
    return _of_groups(spark, target, "derives", DERIVES)


def run(rows: DataFrame, target: str, number: int, threshold: float = 0.3, low: float = 0.05, high: float = 0.35) -> bool:
    """One run; False where there was nothing to do, or the run of this number is there.

    rows: id (distinct), project, session, seq (grows with time of arrival), at, text, kind.
    """
    spark = rows.sparkSession
    if commits.committed(spark, target, number):
        return False
    marks = commits.read(spark, target, "marks", MARKS).groupBy("project").agg(F.max("mark").alias("mark"))
    fresh = rows.join(marks, "project", "left").where(F.col("mark").isNull() | (F.col("seq") > F.col("mark")))
    sessions = cut(fresh.groupBy("project", "session").agg(F.max("seq").alias("mark")), "changed-sessions")
    if sessions.isEmpty():
        return False
    changed = rows.join(sessions.select("project", "session"), ["project", "session"], "left_semi")
    found = consolidation.extracted_facts(changed, "id", "text", "kind").join(changed.select("id", "project", "session", "at"), "id")
    mine = cut(found.select((F.col("id") * 32 + F.col("place")).alias("fact_id"), "project", "session", "fact_type", F.col("at").cast("bigint").alias("created_at"), "fact_key", "fact_value", "confidence"), "fresh-facts")
    old = facts_now(spark, target)
    in_changed = ["project", "session"]
    gone = old.join(sessions.select(*in_changed), in_changed, "left_semi")
    groups = cut(mine.select("project", "fact_type").unionAll(gone.select("project", "fact_type")).distinct(), "changed-groups")
    held = old.join(sessions.select(*in_changed), in_changed, "left_anti").join(groups, ["project", "fact_type"], "left_semi")
    pool = cut(held.select(*mine.columns).unionByName(mine).withColumn("tokens", T.token_set(F.col("fact_value"))), "fact-pool")
    merges = ordered.merge_facts(pool.select("fact_id", "project", "fact_type", "created_at", "tokens"), threshold)
    group = F.to_json(F.struct("project", "fact_type"))
    pairs = set_pairs(cut(pool.select(F.col("fact_id").alias("_rep"), group.alias("_group"), F.array_sort("tokens").alias("_set")).where(F.size("_set") > 0), "fact-sets"), ["_group"], low, high)
    names = pool.select("fact_id", "project", "fact_type")
    both = pairs.select(F.col("a_rep").alias("from_id"), F.col("b_rep").alias("to_id"), (0.5 + F.col("jaccard")).alias("weight"))
    both = both.unionAll(both.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "weight"))
    counts = mine.groupBy(*in_changed).agg(F.count("*").alias("facts"))
    return commits.commit(spark, target, number, {
        "facts": mine,
        "sessions": sessions.select(*in_changed),
        "groups": groups,
        "merges": names.join(merges, "fact_id").select("project", "fact_type", "fact_id", "merged_into"),
        "derives": both.join(names.withColumnRenamed("fact_id", "from_id"), "from_id").select("project", "fact_type", "from_id", "to_id", "weight"),
        "marks": sessions.groupBy("project").agg(F.max("mark").alias("mark")),
        "jobs": sessions.select(*in_changed).join(counts, in_changed, "left").select(*in_changed, F.coalesce("facts", F.lit(0)).cast("bigint").alias("facts"), F.lit("completed").alias("status")),
    })
