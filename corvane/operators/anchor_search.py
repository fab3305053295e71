"""R14 (with F36): for each query the row that it refers to, then the rows before, after or around that row in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.scores import micros
from corvane.session import cut

#: Rows of each channel that may be the anchor; days on either side of one for `around`.
ANCHORS, AROUND_DAYS = 20, 7
DAY = 86_400_000_000

# Words that say on which side of the reference the answer lies.
RELATION_PATTERNS = (
    ("before", r"(?i)^(?:what (?:happened|changed)|.*?)\bbefore\s+(.+?)[?.!]*$"),
    ("after", r"(?i)^(?:what (?:happened|changed)|.*?)\b(?:after|since|following)\s+(.+?)[?.!]*$"),
    ("around", r"(?i)^(?:.*?)\b(?:around|near|at the time of|when)\s+(.+?)[?.!]*$"),
)


def parsed(query: F.Column) -> tuple[F.Column, F.Column]:
    """relation and reference text of a question; both null where it names no reference."""
    relation = reference = None
    for name, pattern in RELATION_PATTERNS:
        hit = F.regexp_extract(query, pattern, 1)
        relation = F.when(hit != "", name) if relation is None else relation.when(hit != "", name)
        reference = F.when(hit != "", hit) if reference is None else reference.when(hit != "", hit)
    return relation, reference


def pick_anchors(lexical: DataFrame, vector: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, relation, project, anchor_id, anchor_us: of the best twenty rows by .6 vector + .4 lexical the one that the reference means.

    lexical, vector: qid, id, score in [0, 1].  rows: id, project, ts, title, words (a set).  queries: qid, relation,
    reference, words.  Rows that share a word with the reference go first: those titled with it, then the earliest, then
    the one with most of its words; where none shares any, the best score wins.
    """
    parts = vector.select("qid", "id", (0.6 * F.col("score")).alias("s")).unionAll(lexical.select("qid", "id", (0.4 * F.col("score")).alias("s")))
    hybrid = parts.groupBy("qid", "id").agg(F.round(F.sum("s"), 9).alias("hybrid"))
    best = hybrid.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.col("hybrid").desc(), "id"))).where(F.col("place") <= ANCHORS)
    near = rows.join(best, "id").join(queries, "qid")  # twenty rows a query
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    title, reference = plain(F.col("title")), plain(F.col("reference"))
    titled = F.when(title == reference, 3).when((reference != "") & F.contains(title, reference), 2).otherwise(0)
    overlap = F.size(F.array_intersect("row_words", "words")) / F.greatest(F.size("words"), F.lit(1))
    scored = near.withColumns({"titled": titled, "overlap": F.round(overlap, 9), "us": micros(F.col("ts"))})
    keyed = scored.withColumn("key", F.when(F.col("overlap") > 0, F.struct(F.lit(0).alias("k"), (-F.col("titled")).alias("a"), F.col("us").alias("b"), (-F.col("overlap")).alias("c"), F.col("place").alias("d")))
                              .otherwise(F.struct(F.lit(1).alias("k"), F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0.0).alias("c"), F.col("place").alias("d"))))
    return keyed.groupBy("qid", "relation", "words").agg(F.min_by(F.struct("id", "project", "us"), "key").alias("x")).select("qid", "relation", "words", F.col("x.project").alias("project"), F.col("x.id").alias("anchor_id"), F.col("x.us").alias("anchor_us"))


def beside(anchors: DataFrame, rows: DataFrame, limit: int, bucket_us: int = DAY) -> DataFrame:
    """qid, id, gap_us, place: the max(30, 3 * limit) rows of the anchor's project next to it on the side that the relation names.

    Rows lie in buckets of time.  The buckets of a project are numbered and their rows summed, which says up to which one
    an anchor has to look: it meets the rows it needs and those of two more buckets, not all of the past or future.
    """
    need = max(30, 3 * limit)
    timed = rows.select("id", "project", micros(F.col("ts")).alias("us")).withColumn("bucket", F.floor(F.col("us") / bucket_us))
    counts = timed.groupBy("project", "bucket").agg(F.count("*").alias("own"))  # a row for each project and bucket with rows
    w = W.partitionBy("project").orderBy("bucket")
    placed = cut(counts.select("project", "bucket", "own", F.sum("own").over(w).alias("upto"), F.row_number().over(w).alias("nth")), "time-buckets")
    home = placed.select("project", F.col("bucket").alias("home"), F.col("own").alias("home_own"), F.col("upto").alias("here"), F.col("nth").alias("home_nth"))
    at = anchors.withColumn("home", F.floor(F.col("anchor_us") / bucket_us)).join(home, ["project", "home"])
    # each bucket has a row at least, so `need` buckets are enough
    turn = F.when(F.col("relation") == "after", 1).otherwise(-1)
    sided = at.where("relation <> 'around'").select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(need)), lambda i: F.col("home_nth") + turn * i)).alias("nth")).join(placed, ["project", "nth"])
    between = F.when(F.col("relation") == "after", F.col("upto") - F.col("own") - F.col("here")).otherwise(F.col("here") - F.col("home_own") - F.col("upto"))
    reach = -(-AROUND_DAYS * DAY // bucket_us)
    near = at.where("relation = 'around'").select("qid", "project", F.explode(F.sequence(F.col("home") - reach, F.col("home") + reach)).alias("bucket"))
    wanted = sided.where(between < need).select("qid", "project", "bucket").unionAll(near)
    met = timed.join(wanted, ["project", "bucket"]).join(anchors.select("qid", "relation", "anchor_id", "anchor_us"), "qid").where(F.col("id") != F.col("anchor_id"))
    gap = F.col("us") - F.col("anchor_us")
    kept = met.withColumn("gap_us", gap).where(((F.col("relation") == "after") & (gap > 0)) | ((F.col("relation") == "before") & (gap < 0)) | ((F.col("relation") == "around") & (F.abs(gap) <= AROUND_DAYS * DAY)))
    nearest = W.partitionBy("qid").orderBy(F.abs("gap_us"), "id")
    return kept.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= need).select("qid", "relation", "anchor_id", "id", "gap_us", "place")


def answers(found: DataFrame, rows: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """qid, rank, id, anchor_id: rows that share a word with the query before those that don't, each in the order of time that the relation asks for."""
    words = rows.select("id", "row_words")
    scored = found.join(words, "id").join(queries.select("qid", "words"), "qid").withColumn("relevance", F.size(F.array_intersect("row_words", "words")))
    time = F.when(F.col("relation") == "around", F.abs("gap_us")).when(F.col("relation") == "before", -F.col("gap_us")).otherwise(F.col("gap_us"))
    w = W.partitionBy("qid").orderBy((F.col("relevance") > 0).desc(), time, F.col("relevance").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit).select("qid", "rank", "id", "anchor_id", "relation")
