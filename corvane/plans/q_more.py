"""Further functions, candidate channels, temporal states and order-dependent operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane import predicates as P
from corvane import views
from corvane.functions import scores, text, vectors
from corvane.operators import maintenance, ordered, tables
from corvane.plans.catalogue import register
from corvane.plans.q_retrieval import _VALUES, VEC, _cos, notes, query_vector, tok
from corvane.session import table
from corvane.views import EV, FACTS, NOW, OBS


@register("a3_hour_histogram", "SELECT hour(ts)::BIGINT AS hour, count(*) FILTER (event_type <> 'purchase') AS events, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def a3(spark, d):
    ev = table(spark, d, "events").select(F.hour("ts").cast("bigint").alias("hour"), "event_type")
    return tables.full_outer_counts({"events": ev.where("event_type <> 'purchase'"), "purchases": ev.where("event_type = 'purchase'")}, "hour")


@register("a10_graph_max_weight", "SELECT l_orderkey AS src, l_partkey AS dst, max(l_quantity) AS weight FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2")
def a10(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.max("l_quantity").alias("weight"))


_STATE = "CASE WHEN superseded_by IS NOT NULL AND valid_to <= TIMESTAMP '1999-01-01' THEN 'superseded' WHEN valid_to IS NOT NULL AND valid_to <= TIMESTAMP '1999-01-01' THEN 'historical' WHEN valid_from > TIMESTAMP '1999-01-01' THEN 'unknown' ELSE 'current' END"


@register("a21_temporal_states", f"WITH {FACTS} SELECT fact_key, {_STATE} AS state, count(*) AS n FROM facts GROUP BY 1, 2")
def a21(spark, d):
    t = F.lit("1999-01-01").cast("timestamp_ntz")
    ended = F.col("valid_to").isNotNull() & (F.col("valid_to") <= t)
    state = F.when(F.col("superseded_by").isNotNull() & ended, "superseded").when(ended, "historical").when(F.col("valid_from") > t, "unknown").otherwise("current")
    return views.facts(spark, d).groupBy("fact_key", state.alias("state")).agg(F.count("*").alias("n"))


@register("a23_classification_stats", f"WITH {_VALUES} SELECT CASE WHEN event_type = 'note' THEN 'text' ELSE 'event' END AS kind, count(*) AS n, round(avg(CASE WHEN event_type = 'session_start' THEN 1.0 ELSE 0 END), 6) AS context_ratio FROM notes GROUP BY 1")
def a23(spark, d):
    kind = F.when(F.col("event_type") == "note", "text").otherwise("event")
    return notes(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") == "session_start").cast("double")), 6).alias("context_ratio"))


@register("f2_word_sets", "SELECT item_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[\\s,.;:!?()\\[\\]{}\"''`<>=/\\\\+*\\-]+'), lambda w: length(w) >= 2)))::BIGINT AS n_words FROM benchmark")
def f2(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(text.word_set(F.col("text"))).cast("bigint").alias("n_words"))


_T = tok("text")


@register("f14_bigram_overlap", f"WITH t AS (SELECT item_id, {_T} AS w FROM benchmark), b AS (SELECT item_id, list_distinct(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM t), q AS (SELECT s AS qs FROM b WHERE item_id = 0) SELECT item_id, round(len(list_intersect(s, qs)) / len(list_distinct(s || qs)), 6)::DOUBLE AS overlap FROM b, q")
def f14(spark, d):
    b = table(spark, d, "benchmark").select("item_id", text.with_bigrams(text.tokens(F.col("text"))).alias("s"))
    q = b.where("item_id = 0").select(F.col("s").alias("qs"))  # one row
    return b.crossJoin(F.broadcast(q)).select("item_id", F.round(text.jaccard(F.col("s"), F.col("qs")), 6).alias("overlap"))


def _entities_sql(x: str) -> str:
    parts = []
    for kind, pattern in text.ENTITIES:
        name = "regexp_replace(v, '[.,;:!?]+$', '')[1:255]" if kind == "url" else "v"
        parts.append("list_transform(regexp_extract_all({}, '{}', 1), lambda v: {{'type': '{}', 'name': {}}})".format(x, pattern.replace("'", "''"), kind, name))
    return " || ".join(parts)


@register("f22_entities", f"WITH f AS (SELECT page_id, {_entities_sql("(coalesce(url, '') || ' ' || coalesce(html, ''))")} AS l FROM pages), k AS (SELECT page_id, unnest(list_slice(list_filter(l, lambda v, i: list_position(l, v) = i), 1, 50)) AS e FROM f) SELECT page_id, e.type AS type, e.name[1:255] AS name FROM k")
def f22(spark, d):
    return table(spark, d, "pages").select("page_id", F.inline(text.entities(F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))))).select("page_id", "type", "name")


@register("f26_private_blocks", "SELECT doc_id, sha256(regexp_replace(regexp_replace('a<private>' || text || '</private>' || text, '(?is)<private>.*?</private>', '', 'g'), '(?is)<private>.*$', '')) AS h FROM documents")
def f26(spark, d):
    head, tail = (F.col("text"), F.col("text"))
    raw = F.concat(F.lit("a<private>"), head, F.lit("</private>"), tail)
    return table(spark, d, "documents").select("doc_id", F.sha2(text.without_private_blocks(raw), 256).alias("h"))


@register("f30_normal_tags", f"WITH {OBS} SELECT doc_id, array_to_string(list_sort(list_distinct([lower(trim(' ' || upper(project) || ' ')), lower(trim(lang)), lower(trim(project))])), ',') AS tags FROM obs")
def f30(spark, d):
    tags = F.array(F.concat(F.lit(" "), F.upper("project"), F.lit(" ")), F.col("lang"), F.col("project"))
    return views.observations(spark, d).select("doc_id", F.array_join(F.array_sort(text.normal_tags(tags)), ",").alias("tags"))


@register("f32_keyword_hits", "SELECT doc_id, (contains(lower(text), 'thing')::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'the')::INT)::BIGINT AS hits, regexp_matches(text, '[0-9]+([.,][0-9]+)?') AS has_number FROM documents")
def f32(spark, d):
    return table(spark, d, "documents").select("doc_id", text.keyword_hits(F.col("text"), ["thing", "License", "the"]).alias("hits"), F.col("text").rlike(r"[0-9]+([.,][0-9]+)?").alias("has_number"))


@register("f33_temporal_anchor", f"WITH {FACTS} SELECT fact_id, coalesce(valid_to, valid_from) AS anchor FROM facts WHERE coalesce(valid_to, valid_from) < TIMESTAMP '1996-01-01'")
def f33(spark, d):
    anchor = F.coalesce("valid_to", "valid_from")
    return views.facts(spark, d).where(anchor < F.lit("1996-01-01").cast("timestamp_ntz")).select("fact_id", anchor.alias("anchor"))


@register("f39_script_ratio", "SELECT lang, count(*) FILTER (length(regexp_replace(text, '[^\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]', '', 'g')) > 0) AS n_cjk, round(avg(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / greatest(1, length(text))), 6) AS latin_ratio FROM documents GROUP BY 1")
def f39(spark, d):
    latin = F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) / F.greatest(F.lit(1), F.length("text"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(text.cjk_ratio(F.col("text")) > 0).alias("n_cjk"), F.round(F.avg(latin), 6).alias("latin_ratio"))


@register("f51_search_reason", "SELECT event_id, CASE WHEN a >= b AND a >= c THEN 'lexical' WHEN b >= c THEN 'vector' ELSE 'recency' END AS reason FROM (SELECT event_id, value / 100 AS a, (event_id % 7) / 7 AS b, (event_id % 11) / 11 AS c FROM events)")
def f51(spark, d):
    """Largest contribution; on ties the first named."""
    parts = [("lexical", F.col("value") / 100), ("vector", (F.col("event_id") % 7) / 7), ("recency", (F.col("event_id") % 11) / 11)]
    best = F.array_max(F.array(*(F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(parts))))
    return table(spark, d, "events").select("event_id", best["k"].alias("reason"))


@register("r1b_recent_rows", f"WITH {OBS} SELECT doc_id, round(greatest(0.05, 1 - 0.01 * (row_number() OVER (ORDER BY created_at DESC, doc_id DESC) - 1)), 6)::DOUBLE AS score FROM obs ORDER BY created_at DESC, doc_id DESC LIMIT 120")
def r1b(spark, d):
    head = views.observations(spark, d).select("doc_id", "created_at").orderBy(F.col("created_at").desc(), F.col("doc_id").desc()).limit(120)
    w = W.orderBy(F.col("created_at").desc(), F.col("doc_id").desc())  # over 120 rows
    return head.select("doc_id", F.round(F.greatest(F.lit(0.05), 1 - 0.01 * (F.row_number().over(w) - 1)), 6).alias("score"))


@register("r5_ensemble_fusion", f"WITH {VEC}, q AS (SELECT v AS qv FROM e WHERE vec_id = 0) SELECT vec_id, round(0.7 * ({_cos('v', 'qv')} + 1) / 2 + 0.3 * greatest(1.0 * (CASE WHEN label = 3 THEN 1 ELSE 0 END), 0.8 * (CASE WHEN label = 4 THEN 1 ELSE 0 END)), 6)::DOUBLE AS score FROM e, q")
def r5(spark, d):
    """Weighted sum over models; within a model the best variant by its weight."""
    q = F.array(*(F.lit(float(x)) for x in query_vector(spark, d)))
    variants = reduce(F.greatest, [w * (F.col("label") == k).cast("double") for k, w in ((3, 1.0), (4, 0.8))])
    return table(spark, d, "embeddings").select("vec_id", F.round(0.7 * (vectors.cosine(F.col("embedding"), q) + 1) / 2 + 0.3 * variants, 6).alias("score"))


@register("r10_importance", f"WITH {EV} SELECT event_id, round(least(1, CASE event_type WHEN 'purchase' THEN 0.9 WHEN 'signup' THEN 0.8 WHEN 'view' THEN 0.5 WHEN 'click' THEN 0.4 WHEN 'error' THEN 0.2 ELSE 0.5 END + CASE WHEN h >= 10 THEN 0.2 WHEN h >= 5 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS importance FROM ev JOIN (SELECT session_id, count(*) FILTER (event_type = 'click') AS h FROM ev GROUP BY 1) USING (session_id)")
def r10(spark, d):
    ev = views.events(spark, d)
    hits = ev.groupBy("session_id").agg(F.count_if(F.col("event_type") == "click").alias("h"))
    return ev.join(hits, "session_id").select("event_id", F.round(F.least(F.lit(1.0), scores.importance("event_type", views.IMPORTANCE) + scores.hit_boost(F.col("h"))), 6).alias("importance"))


@register("r21_projection", f"WITH {OBS}, w AS (SELECT project, count(*)::VARCHAR || ':' || strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS mark FROM obs GROUP BY 1) SELECT doc_id, project, sha256(project || ':' || mark) AS generation FROM obs JOIN w USING (project) WHERE toxic = 0")
def r21(spark, d):
    obs = views.observations(spark, d)
    mark = F.concat_ws(":", F.count("*").cast("string"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss"))
    marks = obs.groupBy("project").agg(mark.alias("mark"))
    return obs.where("toxic = 0").join(marks, "project").select("doc_id", "project", F.sha2(F.concat_ws(":", "project", "mark"), 256).alias("generation"))


@register("r24_feed", f"WITH {OBS}, p AS (SELECT doc_id, project, created_at FROM obs WHERE toxic = 0 AND project IN ('src1', 'src2') ORDER BY created_at DESC, doc_id DESC LIMIT 41) SELECT *, (SELECT count(*) > 40 FROM p) AS has_more FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, doc_id DESC) AS position FROM p) WHERE position <= 40")
def r24(spark, d):
    rows = views.observations(spark, d).where(P.all_of(F.col("toxic") == 0, P.in_projects("project", ["src1", "src2"]))).select("doc_id", "project", "created_at")
    return tables.page(rows, P.clamp_limit(40, 40, 1, 200), "created_at", "doc_id")


@register("m5_latest_resolution", f"WITH {FACTS} SELECT project, fact_key, arg_max(fact_value, (valid_from, fact_id)) AS value, count(DISTINCT fact_value) > 1 AS had_conflict FROM facts GROUP BY 1, 2")
def m5(spark, d):
    return views.facts(spark, d).groupBy("project", "fact_key").agg(F.max_by("fact_value", F.struct("valid_from", "fact_id")).alias("value"), (F.count_distinct("fact_value") > 1).alias("had_conflict"))


@register("m21_soft_delete", f"WITH {OBS} SELECT project, count(*) AS n, count(*) FILTER (doc_id % 9 <> 0) AS n_left FROM obs GROUP BY 1")
def m21(spark, d):
    tags = F.to_json(F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("deleted"))).otherwise(F.array(F.lit("kept"))))
    return views.observations(spark, d).withColumn("privacy", tags).groupBy("project").agg(F.count("*").alias("n"), F.count_if(P.visible("privacy")).alias("n_left"))


@register("e12_supersession_precision", f"""WITH {FACTS}, n AS (SELECT f.*, g.fact_value AS next_value FROM facts f LEFT JOIN facts g ON f.superseded_by = g.fact_id),
j AS (SELECT fact_key, coalesce(valid_to <= TIMESTAMP '2000-01-01', false) AS said, next_value IS NOT NULL AND next_value <> fact_value AS meant, (epoch_us(valid_to) - epoch_us(valid_from)) / 3.6e9 AS hours FROM n)
SELECT fact_key, round(count(*) FILTER (said AND meant) / nullif(count(*) FILTER (said), 0), 6) AS precision, round(count(*) FILTER (said AND meant) / nullif(count(*) FILTER (meant), 0), 6) AS recall,
  round(avg(hours) FILTER (said AND meant), 3) AS delay_hours FROM j GROUP BY 1""")
def e12(spark, d):
    """Facts that had ended by 2000 are taken for superseded; those whose next value differs are."""
    facts = views.facts(spark, d)
    later = facts.select(F.col("fact_id").alias("superseded_by"), F.col("fact_value").alias("next_value"))
    said = F.coalesce(F.col("valid_to") <= F.lit("2000-01-01").cast("timestamp_ntz"), F.lit(False))
    meant = F.coalesce(F.col("next_value") != F.col("fact_value"), F.lit(False))
    hours = (scores.micros(F.col("valid_to")) - scores.micros(F.col("valid_from"))) / 3.6e9
    both = facts.join(later, "superseded_by", "left").groupBy("fact_key").agg(F.count_if(said & meant).alias("both"), F.count_if(said).alias("said"), F.count_if(meant).alias("meant"), F.avg(F.when(said & meant, hours)).alias("delay"))
    return both.select("fact_key", F.round(F.try_divide("both", "said"), 6).alias("precision"), F.round(F.try_divide("both", "meant"), 6).alias("recall"), F.round("delay", 3).alias("delay_hours"))


@register("e17_ready_metrics", "SELECT o_orderpriority AS slice, round(count(*) FILTER (p AND e) / nullif(count(*) FILTER (p), 0), 6) AS precision, round(count(*) FILTER (p AND e) / nullif(count(*) FILTER (e), 0), 6) AS recall FROM (SELECT *, o_orderstatus = 'O' AS p, o_totalprice > 150000 AS e FROM orders) GROUP BY 1")
def e17(spark, d):
    p, e = F.col("o_orderstatus") == "O", F.col("o_totalprice") > 150000
    got = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("slice")).agg(F.count_if(p & e).alias("both"), F.count_if(p).alias("p"), F.count_if(e).alias("e"))
    return got.select("slice", F.round(F.try_divide("both", "p"), 6).alias("precision"), F.round(F.try_divide("both", "e"), 6).alias("recall"))


@register("w10_budget_pack")
def w10(spark, d):
    """Order-dependent: each conversation's turns packed into 300 tokens, newest last."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("full"), F.lit(12).alias("compact"))
    return ordered.pack_budget(turns, "conv_id", "turn", "full", "compact", 300)


@register("m4_fact_merge")
def m4(spark, d):
    """Order-dependent: user turns of each conversation as facts, merged in time order."""
    turns = table(spark, d, "conversations").where("role <> 'system'")
    facts = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("fact_id"), F.col("conv_id").cast("string").alias("project"), F.col("role").alias("fact_type"), F.col("turn").alias("created_at"), text.tokens(F.col("text")).alias("tokens"))
    return ordered.merge_facts(facts, 0.3)


@register("f15_now_parameter", f"SELECT user_id, round(sum(exp(-greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9) / 2160)), 4) AS heat FROM events GROUP BY 1")
def f15_heat(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(scores.recency(NOW, "ts")), 4).alias("heat"))
