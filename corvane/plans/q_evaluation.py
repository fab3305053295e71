"""Evaluation, maintenance and policies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane import views
from corvane.functions import text, vectors
from corvane.operators import evaluation as ev
from corvane.operators import consolidation, maintenance, vector_index
from corvane.plans.catalogue import register
from corvane.plans.q_index import embedding_index
from corvane.session import table

_COS = "(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))"
RANKED = f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), rk AS (SELECT a.vec_id AS query, a.label AS ql, b.vec_id AS item, b.label AS il, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank
FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10), rel AS (SELECT a.vec_id AS query, b.vec_id AS item FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"""


def ranked(spark, d):
    """The ten nearest vectors to each id divisible by 50, by the stored index; vectors of equal labels are relevant."""
    v = table(spark, d, "embeddings")
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    found = vector_index.search(spark, embedding_index(spark, d), queries, 10, exact=True, other=True, digits=6)
    label = lambda i, c: v.select(F.col("vec_id").alias(i), F.col("label").alias(c))
    return found.select(F.col("qid").alias("query"), F.col("id").alias("item"), "rank").join(label("query", "ql"), "query").join(label("item", "il"), "item")


def relevant(spark, d):
    """How many other vectors have the label of each query."""
    v = table(spark, d, "embeddings")
    sizes = v.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    return v.where("vec_id % 50 = 0").join(sizes, "label").where("n_relevant > 0").select(F.col("vec_id").alias("query"), "n_relevant")


@register("e1_recall_mrr_ndcg", f"""WITH {RANKED}, t AS (SELECT query, count(*) AS n FROM rel GROUP BY 1), h AS (SELECT query, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM rk WHERE ql = il GROUP BY 1)
SELECT query, round(coalesce(hits, 0) / n, 6)::DOUBLE AS recall, round(coalesce(hits, 0) / 10, 6)::DOUBLE AS precision, round(coalesce(1 / first, 0), 6)::DOUBLE AS mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))), 6)::DOUBLE AS ndcg FROM t LEFT JOIN h USING (query)""")
def e1(spark, d):
    got = ev.ranking_metrics(ranked(spark, d).withColumn("hit", F.col("ql") == F.col("il")), relevant(spark, d), "query", "hit", "n_relevant", "rank", 10)
    return got.select("query", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")))


@register("e3_order_gain_ndcg", f"""WITH {RANKED}, p AS (SELECT query, rank - 1 AS r, row_number() OVER (PARTITION BY query ORDER BY item) - 1 AS e FROM rk)
SELECT query, round(sum(1 / (1 + abs(r - e)) / log2(r + 2)) / list_sum(list_transform(range(0, count(*)), lambda i: 1 / log2(i + 2))), 6)::DOUBLE AS ndcg FROM p GROUP BY 1""")
def e3(spark, d):
    top = ranked(spark, d).select("query", (F.col("rank") - 1).alias("r"), (F.row_number().over(W.partitionBy("query").orderBy("item")) - 1).alias("e"))
    return ev.order_gain_ndcg(top, "query", "r", "e", 10).select("query", F.round("ndcg", 6).alias("ndcg"))


@register("e4_temporal_order", f"""WITH {RANKED}, p AS (SELECT query, rank - 1 AS i, item AS e FROM rk WHERE ql = il OR rank <= 5), r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY i) - 1 AS i, e FROM p),
s AS (SELECT a.query, sum(sign(b.e - a.e)) AS s, count(*) AS c, sum(sign(b.e - a.e) * (exp(-0.1 * a.i) + exp(-0.1 * b.i))) AS ws, sum(exp(-0.1 * a.i) + exp(-0.1 * b.i)) AS w FROM r a JOIN r b ON a.query = b.query AND a.i < b.i GROUP BY 1)
SELECT query, round((s / c + 1) / 2, 6)::DOUBLE AS order_score, round((ws / w + 1) / 2, 6)::DOUBLE AS weighted_score FROM s""")
def e4(spark, d):
    top = ranked(spark, d).where("ql = il OR rank <= 5")
    return ev.rank_agreement(top, "query", "rank", "item").select("query", F.round("order_score", 6).alias("order_score"), F.round("weighted_score", 6).alias("weighted_score"))


@register("e6_freshness", f"""WITH {RANKED}, n AS (SELECT query, min(rank) FILTER (il = ql) AS new_rank FROM rk GROUP BY 1), o AS (SELECT query, count(*) AS n_old, count(*) FILTER (rank > new_rank) AS below FROM rk JOIN n USING (query) WHERE il = (ql + 1) % 10 GROUP BY 1)
SELECT query, round(CASE WHEN new_rank IS NULL THEN 0 WHEN n_old IS NULL THEN 1 ELSE below / n_old END, 6)::DOUBLE AS freshness FROM n LEFT JOIN o USING (query)""")
def e6(spark, d):
    got = ev.freshness_at_k(ranked(spark, d), "query", "rank", F.col("il") == F.col("ql"), F.col("il") == (F.col("ql") + 1) % 10, 10)
    return got.select("query", F.round("freshness", 6).alias("freshness"))


_WN = "count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*)"


@register("e7_wilson", f"""WITH s AS (SELECT o_orderpriority AS slice, {_WN} AS p, count(*)::DOUBLE AS n FROM orders GROUP BY 1)
SELECT slice, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM s""")
def e7(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("slice")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    low, high = ev.wilson(F.col("k"), F.col("n"))
    return s.select("slice", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("e8_holm", """WITH t AS (SELECT o_orderpriority AS name, round(abs(avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders)) / 20000, 6) AS p FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, name) - 1 AS k, count(*) OVER () AS m FROM t)
SELECT name, p, k, min(CASE WHEN p <= 0.05 / (m - k) THEN 1 ELSE 0 END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM r""")
def e8(spark, d):
    orders = table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    per = orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("a"))
    return ev.holm(per.crossJoin(orders.agg(F.avg("o_totalprice").alias("b"))).select("name", F.round(F.abs(F.col("a") - F.col("b")) / 20000, 6).alias("p")), "name", "p")  # one row


@register("e9_wilcoxon", """WITH d AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O') AS d FROM orders GROUP BY 1), r AS (SELECT round(d, 4) AS d, row_number() OVER (ORDER BY abs(round(d, 4)), o_custkey) AS r FROM d WHERE round(d, 4) <> 0),
s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus FROM r) SELECT n, w_plus, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 5) AS z FROM s""")
def e9(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg((F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) - F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")))).alias("d"))
    return ev.wilcoxon(per.select("o_custkey", F.round("d", 4).alias("d")), "d", "o_custkey").withColumn("z", F.round("z", 5))


_TK = "list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda w: length(w) > 1)"


@register("e10_token_f1", f"""WITH t AS (SELECT conv_id, turn, {_TK} AS b, lag({_TK}) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2 * coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0) / (len(a) + len(b)) END, 6)::DOUBLE AS f1 FROM t WHERE a IS NOT NULL""")
def e10(spark, d):
    t = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^a-z]+", " ")), " "), lambda w: F.length(w) > 1)
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", t.alias("b")).withColumn("a", F.lag("b").over(w)).where("a IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(ev.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@register("e11_grounding", "SELECT doc_id, round((contains(text, 'thand')::INT + contains(text, 'onre')::INT + contains(text, 'and')::INT) / 3, 6)::DOUBLE AS grounding FROM documents")
def e11(spark, d):
    words = ["thand", "onre", "and"]
    return table(spark, d, "documents").select("doc_id", F.round(sum((F.contains("text", F.lit(w)).cast("int") for w in words), F.lit(0)) / len(words), 6).alias("grounding"))


@register("e13_three_layer_gate", "WITH m AS (SELECT source AS metric, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) AS v FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT metric, round(v, 6) AS value, v >= 0.6 AS floor_ok, v >= 0.95 * (SELECT avg(v) FROM m) AS relative_ok FROM m")
def e13(spark, d):
    m = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy(F.col("source").alias("metric")).agg(F.avg((F.col("quality") == 1).cast("double")).alias("v"))
    return m.crossJoin(m.agg(F.avg("v").alias("past"))).select("metric", F.round("v", 6).alias("value"), (F.col("v") >= 0.6).alias("floor_ok"), (F.col("v") >= 0.95 * F.col("past")).alias("relative_ok"))  # one row


@register("e15_leakage", "SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def e15(spark, d):
    """Documents that contain a whole passage: joined by the passage's first eight words, then verified."""
    return maintenance.contained_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))


@register("e16_layer_summary", "SELECT lang AS layer, count(*) AS n, round(avg(quality), 6) AS mean_quality, round(avg(toxic), 6) AS mean_toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def e16(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy(F.col("lang").alias("layer")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.avg("toxic"), 6).alias("mean_toxic"))


@register("m8_forget_policy", """WITH o AS (SELECT o_orderkey AS id, o_custkey AS project, greatest(0, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(o_orderdate)) / 8.64e10) AS age, o_orderkey % 4 AS access_count, (o_orderkey % 10) / 10 AS signal_score, o_orderpriority = '1-URGENT' AS protected, CASE WHEN o_orderkey % 50 = 0 THEN TIMESTAMP '2000-01-01' END AS expires_at FROM orders),
s AS (SELECT *, CASE WHEN expires_at <= TIMESTAMP '2001-08-02' THEN 1.0 ELSE round(0.4 * CASE WHEN access_count = 0 THEN 1 ELSE greatest(0, 1 - access_count / 5) END + 0.3 * (1 - signal_score) + 0.3 * least(1, greatest(0, (age - 30) / 150)), 4) END AS score FROM o WHERE NOT protected)
SELECT id, project, score::DOUBLE AS score FROM s WHERE expires_at <= TIMESTAMP '2001-08-02' OR (score >= 0.7 AND age >= 30 AND access_count = 0) ORDER BY score DESC, id LIMIT 1000""")
def m8(spark, d):
    obs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 4).alias("access_count"), ((F.col("o_orderkey") % 10) / 10).alias("signal_score"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_protected"), F.when(F.col("o_orderkey") % 50 == 0, F.lit("2000-01-01").cast("timestamp")).alias("expires_at"))
    return maintenance.forget_candidates(obs, "2001-08-02 00:00:00").select("id", "project", "score")


@register("m13_duplicate_cleanup", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY doc_id DESC) > 1")
def m13(spark, d):
    """All but the newest row of each content: a max by hash joined back, so a large group is not gathered."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2(text.normal_content(F.col("text")), 256).alias("h"))
    return rows.join(rows.groupBy("h").agg(F.max("doc_id").alias("kept")), "h").where("doc_id <> kept").select("doc_id")


@register("m14_compress", f"WITH {views.FACTS} SELECT fact_id, CASE WHEN fact_id % 100 < 50 THEN 'prune' WHEN superseded_by IS NOT NULL THEN 'merge' ELSE 'keep' END AS action FROM facts")
def m14(spark, d):
    return views.facts(spark, d).select("fact_id", F.when(F.col("fact_id") % 100 < 50, "prune").when(F.col("superseded_by").isNotNull(), "merge").otherwise("keep").alias("action"))


@register("m17_live_leases", """WITH ls AS (SELECT user_id AS target, event_type, event_id, ts FROM events WHERE event_type IN ('click', 'error')), l AS (SELECT target, arg_max(event_type, (ts, event_id)) AS last_kind, max(ts) AS last_ts FROM ls GROUP BY 1)
SELECT target, last_ts AS acquired_at, last_ts + INTERVAL 6 HOUR AS expires_at FROM l WHERE last_kind = 'click' AND last_ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-30 12:00:00'""")
def m17(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("target"), F.when(F.col("event_type") == "click", "acquire").when(F.col("event_type") == "error", "release").alias("kind"), "ts", "event_id").where("kind IS NOT NULL")
    return maintenance.live_leases(rows, "2024-01-30 12:00:00", 6 * 3600)


@register("j22_range_token_join", f"""WITH t AS (SELECT conv_id, turn, role, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda w: length(w) >= 6))) AS tok FROM conversations)
SELECT a.conv_id, a.turn AS planned_turn, min(b.turn) AS evidence_turn FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.tok = b.tok AND b.turn > a.turn WHERE a.role = 'user' AND b.role = 'assistant' GROUP BY 1, 2""")
def j22(spark, d):
    """Earliest later evidence that shares a long word."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^a-z]+", " ")), " "), lambda w: F.length(w) >= 6)
    met = consolidation.completed_plans(table(spark, d, "conversations"), "turn", "conv_id", "turn", words, F.col("role") == "user", F.col("role") == "assistant")
    return met.select("conv_id", F.col("planned_id").alias("planned_turn"), F.col("evidence_id").alias("evidence_turn"))


@register("j20_content_conflicts", "SELECT a.doc_id AS source_id, min(b.doc_id) AS target_id FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 GROUP BY 1")
def j20(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    target = docs.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("target_id"))
    return docs.where("doc_id % 2 = 1").join(target, "h").select(F.col("doc_id").alias("source_id"), "target_id")


@register("session_windows", """WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    """Sessions by a gap of six hours, as the events have no session of their own."""
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    got = rows.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"), F.min("ts").alias("start_ts"))
    return got.select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "n")
