"""Scans, predicates, joins, sets and aggregates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane import predicates as P
from corvane import views
from corvane.functions import scores
from corvane.operators import evaluation, tables, temporal
from corvane.plans.catalogue import register
from corvane.session import cut, table
from corvane.views import EV, FACTS, NOW, OBS


def rows():
    return F.count("*").alias("n")


@register("s2_pk_lookup", "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000)")
def s2(spark, d):
    ids = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    found = table(spark, d, "customer").join(ids, "c_custkey", "left_semi")
    return found.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name")


@register("s6_tag_unnest_counts", f"WITH {OBS} SELECT tag, count(*) AS n FROM (SELECT unnest(['lang:' || lang, 'src:' || project, CASE WHEN toxic = 1 THEN 'private' END]) AS tag FROM obs) WHERE tag IS NOT NULL GROUP BY tag")
def s6(spark, d):
    tags = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "project"), F.when(F.col("toxic") == 1, "private"))
    raw = views.observations(spark, d).select(F.to_json(tags).alias("tags_json"))
    return raw.select(F.explode(F.from_json("tags_json", "array<string>")).alias("tag")).where("tag IS NOT NULL").groupBy("tag").agg(rows())


@register("s7_event_store_read", f"WITH {EV} SELECT event_id, ts, project, event_type FROM ev WHERE project = 'p2' AND event_type IN ('purchase', 'error') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20")
def s7(spark, d):
    ok = P.all_of(P.in_projects("project", ["p2"]), P.of_types("event_type", ["purchase", "error"]), P.between("ts", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-25").cast("timestamp")))
    return views.events(spark, d).where(ok).select("event_id", "ts", "project", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(20).limit(50)


@register("s8_latest_ts", f"WITH {EV} SELECT project, event_type, max(ts) AS latest_ts FROM ev GROUP BY 1, 2")
def s8(spark, d):
    return views.events(spark, d).groupBy("project", "event_type").agg(F.max("ts").alias("latest_ts"))


@register("s27_append_dedupe", f"""WITH {EV}, base AS (SELECT * FROM ev WHERE event_id % 10 < 5), arriving AS (SELECT * FROM ev WHERE event_id % 10 >= 3 UNION ALL SELECT * FROM ev WHERE event_id % 10 = 7)
SELECT (SELECT count(*) FROM arriving) AS arriving, count(*) AS inserted, (SELECT count(*) FROM arriving) - count(*) AS deduplicated FROM (SELECT DISTINCT event_id FROM arriving) a WHERE event_id NOT IN (SELECT event_id FROM base)""")
def s27(spark, d):
    ev = views.events(spark, d).withColumn("dedupe_hash", F.sha2(F.concat_ws("|", "event_id", "user_id", "event_type"), 256))
    base = ev.where("event_id % 10 < 5")
    arriving = ev.where("event_id % 10 >= 3").unionAll(ev.where("event_id % 10 = 7"))
    fresh = tables.append_new(base, arriving, "dedupe_hash", "event_id")
    return arriving.agg(F.count("*").alias("arriving")).crossJoin(fresh.agg(F.count("*").alias("inserted"))).withColumn("deduplicated", F.col("arriving") - F.col("inserted"))  # one row each


@register("s28_upsert_latest", "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def s28(spark, d):
    return tables.latest_by(views.events(spark, d).select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id")


@register("s30_export", f"WITH {OBS} SELECT doc_id, project, created_at, n_chars FROM obs WHERE toxic = 0 ORDER BY created_at DESC, doc_id DESC LIMIT 1000")
def s30(spark, d):
    return views.observations(spark, d).where("toxic = 0").select("doc_id", "project", "created_at", "n_chars").orderBy(F.col("created_at").desc(), F.col("doc_id").desc()).limit(1000)


@register("s32_archive_stub", "SELECT doc_id, sha256(text) AS payload_sha256, octet_length(encode(text)) AS payload_bytes FROM documents WHERE n_chars < 200")
def s32(spark, d):
    return table(spark, d, "documents").where("n_chars < 200").select("doc_id", F.sha2("text", 256).alias("payload_sha256"), F.octet_length("text").cast("bigint").alias("payload_bytes"))


@register("p4_as_of", f"WITH {EV} SELECT event_type, count(*) AS n, max(ts) AS latest FROM ev WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def p4(spark, d):
    return views.events(spark, d).where(P.between("ts", until=F.lit("2024-01-15 12:00:00").cast("timestamp"))).groupBy("event_type").agg(rows(), F.max("ts").alias("latest"))


@register("p5_privacy_failclosed", f"WITH {OBS} SELECT project, count(*) AS n, count(*) FILTER (doc_id % 7 <> 3 AND NOT (doc_id % 7 = 0 AND toxic = 1)) AS n_visible, count(*) FILTER (doc_id % 7 = 5 OR doc_id % 7 = 6) AS n_untagged FROM obs GROUP BY project")
def p5(spark, d):
    r = F.col("doc_id") % 7  # tags by case: mixed, plain, plain, broken JSON, plain, null, empty
    raw = F.when(r == 3, F.lit('["private"')).when(r == 5, F.lit(None)).when(r == 6, F.lit("[ ]")).when((r == 0) & (F.col("toxic") == 1), F.lit('["a", "Private"]')).otherwise(F.lit('["a"]'))
    obs = views.observations(spark, d).withColumn("privacy_json", raw)
    return obs.groupBy("project").agg(rows(), F.count_if(P.visible("privacy_json")).alias("n_visible"), F.count_if(P.untagged("privacy_json")).alias("n_untagged"))


@register("p9_tenant", f"WITH {EV} SELECT team_id, count(*) AS n, count(DISTINCT user_id) AS n_users FROM ev WHERE user_id = 7 OR team_id = 2 GROUP BY team_id")
def p9(spark, d):
    return views.events(spark, d).where(P.role_access("member", 7, 2)).groupBy("team_id").agg(rows(), F.count_distinct("user_id").alias("n_users"))


@register("p13_validity", f"WITH {FACTS} SELECT project, count(*) AS n_valid, min(fact_id) AS first_fact FROM facts WHERE valid_from <= TIMESTAMP '1998-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-06-01') GROUP BY project")
def p13(spark, d):
    return views.facts(spark, d).where(P.valid_at(F.lit("1998-06-01").cast("timestamp"))).groupBy("project").agg(F.count("*").alias("n_valid"), F.min("fact_id").alias("first_fact"))


@register("p15_keyset_page", f"""WITH {EV}, c AS (SELECT ts, event_id FROM ev ORDER BY ts DESC, event_id DESC LIMIT 1 OFFSET 39), p AS (SELECT e.event_id, e.ts, e.event_type FROM ev e, c WHERE e.ts < c.ts OR (e.ts = c.ts AND e.event_id < c.event_id) ORDER BY e.ts DESC, e.event_id DESC LIMIT 41)
SELECT *, (SELECT count(*) > 40 FROM p) AS has_more FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS position FROM p) WHERE position <= 40""")
def p15(spark, d):
    ev = views.events(spark, d).select("event_id", "ts", "event_type")
    last = ev.orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(39).limit(1).collect()  # one row: the cursor that a client sends
    if not last:
        return tables.page(ev.limit(0), 40, "ts", "event_id")
    return tables.page(ev.where(P.after_cursor(last[0].ts, last[0].event_id, "ts", "event_id")), 40, "ts", "event_id")


@register("p16_like_escape", "SELECT doc_id, source FROM documents WHERE contains(text, '%%') OR contains(text, '_%')")
def p16(spark, d):
    return table(spark, d, "documents").where(P.literal_like("text", "%%") | P.literal_like("text", "_%")).select("doc_id", "source")


@register("j2_left_join_on_clause", "SELECT c_custkey, count(o_orderkey) AS n_visible, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0)::BIGINT AS n_f FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' AND o_totalprice > 300000 GROUP BY c_custkey")
def j2(spark, d):
    orders = table(spark, d, "orders").where((F.col("o_orderpriority") != "1-URGENT") & (F.col("o_totalprice") > 300000))
    per = orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_visible"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"))  # before the join: one row a customer
    return table(spark, d, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_visible", F.lit(0)).alias("n_visible"), F.coalesce("n_f", F.lit(0)).alias("n_f"))


@register("j7_shared_entity", """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_orderkey AS a_order, b.l_orderkey AS b_order, count(*) AS shared FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY 1, 2 ORDER BY shared DESC, a_order, b_order LIMIT 100""")
def j7(spark, d):
    """Pairs by a shared entity, over one in twenty of the entities or all: the pair count is quadratic in an entity's rows by definition."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = lines.withColumnRenamed("l_orderkey", "a_order"), lines.withColumnRenamed("l_orderkey", "b_order")
    return a.join(b, "l_partkey").where("a_order < b_order").groupBy("a_order", "b_order").agg(F.count("*").alias("shared")).orderBy(F.col("shared").desc(), "a_order", "b_order").limit(100)


@register("j8_prev_event", f"WITH {EV} SELECT event_id, user_id, lag(event_id) OVER w AS prev_event_id, CASE WHEN lag(ts) OVER w IS NULL THEN NULL ELSE (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 END AS gap_s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def j8(spark, d):
    ev = temporal.previous(views.events(spark, d), ["user_id"], "ts", "event_id", ["event_id", "ts"])
    return ev.select("event_id", "user_id", "prev_event_id", ((scores.micros(F.col("ts")) - scores.micros(F.col("prev_ts"))) / 1e6).alias("gap_s"))


@register("j9_left_semi", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_discount > 0.09)")
def j9(spark, d):
    wanted = table(spark, d, "lineitem").where("l_quantity >= 49 AND l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(wanted, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@register("j10_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')")
def j10(spark, d):
    late = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(late, "c_custkey", "left_anti").select("c_custkey", "c_name")


@register("j11_orphans", "SELECT l_partkey AS part FROM lineitem GROUP BY l_partkey HAVING bool_and(l_orderkey % 10 <> 0) AND bool_or(l_orderkey % 10 = 1)")
def j11(spark, d):
    """Parts with a row among the removed orders (1 in 10) and none among the kept sample (1 in 10): semi, then anti."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), "l_orderkey")
    gone, kept = lines.where("l_orderkey % 10 = 1"), lines.where("l_orderkey % 10 = 0")
    return lines.select("part").distinct().join(gone, "part", "left_semi").join(kept, "part", "left_anti")


@register("j14_nearest_time", f"WITH {EV} SELECT event_type, event_id, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 08:00:00')) AS gap_us, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 08:00:00')), event_id) QUALIFY rn <= 5")
def j14(spark, d):
    return temporal.nearest(views.events(spark, d), "2024-01-10 08:00:00", "ts", "event_id", 5, ["event_type"]).select("event_type", "event_id", "gap_us", "rn")


@register("j15_after_anchor", f"WITH {EV}, a AS (SELECT user_id, min(ts) AS anchor_ts FROM ev WHERE event_type = 'purchase' GROUP BY 1) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev JOIN a USING (user_id) WHERE ts > anchor_ts QUALIFY rn <= 10")
def j15(spark, d):
    return temporal.after_first(views.events(spark, d), ["user_id"], F.col("event_type") == "purchase", "ts", "event_id", 10).select("user_id", "event_id", "rn")


@register("asof_price", "SELECT l.event_id, l.user_id, r.value AS asof_value FROM events l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts WHERE l.event_type = 'view'")
def asof(spark, d):
    ev = table(spark, d, "events")
    right = ev.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return temporal.asof_join(ev.where("event_type = 'view'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "ts", ["value"]).select("event_id", "user_id", "asof_value")


PERIODS = {"daily": ("yyyy-MM-dd", "%Y-%m-%d"), "weekly": (None, "%Y-%W"), "monthly": ("yyyy-MM", "%Y-%m")}


def _period(kind: str):
    if kind != "weekly":
        return F.date_format("ts", PERIODS[kind][0])
    week = F.floor((F.dayofyear("ts") - 1 + 7 - F.weekday("ts")) / 7)
    return F.concat_ws("-", F.date_format("ts", "yyyy"), F.lpad(week.cast("string"), 2, "0"))


def _usage(kind: str):
    sql = f"SELECT strftime(ts, '{PERIODS[kind][1]}') AS period, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE event_type IN ('view', 'purchase', 'error') GROUP BY 1"

    @register(f"a1_usage_{kind}", sql)
    def a1(spark, d):
        ev = table(spark, d, "events").withColumn("period", _period(kind))
        return tables.full_outer_counts({k: ev.where(F.col("event_type") == k[:-1]) for k in ("views", "purchases", "errors")}, "period")


for _kind in PERIODS:
    _usage(_kind)


@register("a2_entity_distribution", "SELECT p_brand, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 50")
def a2(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey")
    return lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(rows(), F.count_distinct("l_orderkey").alias("n_orders")).orderBy(F.col("n").desc(), "p_brand").limit(50)


@register("a4_overview", f"""WITH {EV} SELECT 'total' AS kind, 'events' AS name, count(*) AS n FROM ev UNION ALL SELECT 'total', 'sessions', count(DISTINCT session_id) FROM ev UNION ALL SELECT 'event_type', event_type, count(*) FROM ev GROUP BY event_type
UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT * FROM (SELECT 'day', strftime(ts, '%Y-%m-%d') AS day, count(*) FROM ev GROUP BY 2 ORDER BY day DESC LIMIT 7)""")
def a4(spark, d):
    ev = views.events(spark, d)
    part = lambda kind, name, df, agg=F.count("*"): df.agg(agg.alias("n")).select(F.lit(kind).alias("kind"), name.alias("name"), "n")
    days = ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("name")).agg(rows()).orderBy(F.col("name").desc()).limit(7).select(F.lit("day").alias("kind"), "name", "n")
    out = part("total", F.lit("events"), ev.groupBy()).unionAll(part("total", F.lit("sessions"), ev.groupBy(), F.count_distinct("session_id")))
    return out.unionAll(part("event_type", F.col("event_type"), ev.groupBy("event_type"))).unionAll(part("lang", F.col("lang"), table(spark, d, "documents").groupBy("lang"))).unionAll(days)


@register("a5_facets", f"""WITH {OBS}, f AS (SELECT *, CASE WHEN created_at > TIMESTAMP '{NOW}' - INTERVAL 1 DAY THEN '24h' WHEN created_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN '7d' WHEN created_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN '30d' ELSE 'older' END AS bucket FROM obs WHERE toxic = 0)
SELECT 'project' AS facet, project AS value, count(*) AS n FROM f GROUP BY project UNION ALL SELECT 'lang', lang, count(*) FROM f GROUP BY lang UNION ALL SELECT 'time', bucket, count(*) FROM f GROUP BY bucket UNION ALL SELECT 'total', 'all', count(*) FROM f""")
def a5(spark, d):
    """All facets in one pass: each row is exploded to its facet values and counted once."""
    age = scores.hours_before(NOW, "created_at")
    future = F.col("created_at") > F.lit(NOW).cast("timestamp")
    bucket = F.when(future | (age < 24), "24h").when(age < 168, "7d").when(age < 720, "30d").otherwise("older")
    facets = F.array(*(F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in (("project", F.col("project")), ("lang", F.col("lang")), ("time", bucket), ("total", F.lit("all")))))
    return views.observations(spark, d).where("toxic = 0").select(F.inline(facets)).groupBy("facet", "value").agg(rows())


@register("a6_session_list", f"WITH {EV} SELECT session_id, max(ts) AS last_ts, count(*) AS n, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error FROM ev GROUP BY 1 ORDER BY last_ts DESC, session_id LIMIT 200")
def a6(spark, d):
    kinds = [F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in ("view", "click", "error")]
    return views.events(spark, d).groupBy("session_id").agg(F.max("ts").alias("last_ts"), rows(), *kinds).orderBy(F.col("last_ts").desc(), "session_id").limit(200)


@register("a7_project_stats", f"WITH {EV} SELECT project, count(*) AS n, count(DISTINCT session_id) AS n_sessions, max(ts) AS last_ts FROM ev GROUP BY 1")
def a7(spark, d):
    return views.events(spark, d).groupBy("project").agg(rows(), F.count_distinct("session_id").alias("n_sessions"), F.max("ts").alias("last_ts"))


@register("a8_status_counts", "SELECT o_orderpriority AS reason, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1")
def a8(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("reason")).agg(*(F.count_if(F.col("o_orderstatus") == s).alias(k) for k, s in (("pending", "P"), ("open", "O"), ("done", "F"))))


@register("a9_hit_counts", "SELECT user_id AS target, count(*) AS hits, CASE WHEN count(*) >= 10 THEN 0.2 WHEN count(*) >= 5 THEN 0.1 ELSE 0.0 END::DOUBLE AS boost FROM events WHERE event_type = 'click' GROUP BY 1")
def a9(spark, d):
    return table(spark, d, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("target")).agg(F.count("*").alias("hits")).withColumn("boost", scores.hit_boost(F.col("hits")))


@register("a11_model_coverage", "SELECT count(DISTINCT vec_id) AS total, count(DISTINCT CASE WHEN label = 3 THEN vec_id END) AS current, round(count(DISTINCT CASE WHEN label = 3 THEN vec_id END) / count(DISTINCT vec_id), 6) AS coverage FROM embeddings")
def a11(spark, d):
    v = table(spark, d, "embeddings").agg(F.count_distinct("vec_id").alias("total"), F.count_distinct(F.when(F.col("label") == 3, F.col("vec_id"))).alias("current"))
    return v.withColumn("coverage", F.round(F.col("current") / F.col("total"), 6))


@register("a12_having_absent", "SELECT o_custkey, min(o_orderdate) AS first_date FROM orders GROUP BY 1 HAVING sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 0")
def a12(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.min("o_orderdate").alias("first_date")).where("f = 0").drop("f")


@register("a13_migration_progress", "SELECT count(*) AS total, count(*) FILTER (label < 8) AS migrated, round(count(*) FILTER (label < 8) / count(*), 6) AS progress, count(*) FILTER (label < 8) / count(*) < 0.95 AS warning FROM embeddings")
def a13(spark, d):
    got = table(spark, d, "embeddings").agg(F.count("*").alias("total"), F.count_if(F.col("label") < 8).alias("migrated"))
    return got.withColumn("progress", F.round(F.col("migrated") / F.col("total"), 6)).withColumn("warning", F.col("migrated") / F.col("total") < 0.95)


@register("a14_lifecycle_impact", "SELECT (SELECT count(*) FROM orders WHERE o_custkey % 50 = 0) AS n_orders, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 0)) AS n_lines")
def a14(spark, d):
    ids = table(spark, d, "orders").where("o_custkey % 50 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return ids.agg(F.count("*").alias("n_orders")).crossJoin(table(spark, d, "lineitem").join(ids, "l_orderkey", "left_semi").agg(F.count("*").alias("n_lines")))  # one row each


@register("a15_byte_estimate", "SELECT source, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) FILTER (n_chars < 100) AS n_small FROM documents GROUP BY 1")
def a15(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(rows(), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.count_if(F.col("n_chars") < 100).alias("n_small"))


@register("a16_watermark", f"WITH {EV} SELECT project, count(*)::VARCHAR || ':' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS watermark, sha256(project || ':' || count(*)::VARCHAR || ':' || strftime(max(ts), '%Y-%m-%d %H:%M:%S')) AS generation FROM ev GROUP BY project")
def a16(spark, d):
    mark = F.concat_ws(":", F.count("*").cast("string"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss")).alias("watermark")
    return views.events(spark, d).groupBy("project").agg(mark).withColumn("generation", F.sha2(F.concat_ws(":", "project", "watermark"), 256))


@register("a17_dup_keys", "SELECT o_custkey, o_orderpriority, count(*) AS n, max(o_orderdate) AS kept_date FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def a17(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(rows(), F.max("o_orderdate").alias("kept_date")).where("n > 1")


@register("a18_hooks_health", f"SELECT event_type AS kind, max(ts) AS last_ts, CASE WHEN floor((epoch(TIMESTAMP '{NOW}') - epoch(max(ts))) / 86400) < 1 THEN 'alive' ELSE 'stale_' || CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(max(ts))) / 86400) AS BIGINT)::VARCHAR || 'd' END AS health FROM events GROUP BY 1")
def a18(spark, d):
    days = F.floor(scores.hours_before(NOW, "last_ts") / 24)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.max("ts").alias("last_ts")).withColumn("health", F.when(days < 1, "alive").otherwise(F.concat(F.lit("stale_"), days.cast("string"), F.lit("d"))))


@register("a19_consumption_rate", "SELECT event_type AS kind, count(*) AS delivered, count(*) FILTER (value > 50) AS consumed, round(count(*) FILTER (value > 50) / nullif(count(*), 0), 6) AS rate FROM events GROUP BY 1")
def a19(spark, d):
    got = table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("delivered"), F.count_if(F.col("value") > 50).alias("consumed"))
    return got.withColumn("rate", F.round(F.try_divide("consumed", "delivered"), 6))


@register("a20_minmax_norm", "SELECT event_id, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6)::DOUBLE AS score FROM events WINDOW w AS (PARTITION BY event_type)")
def a20(spark, d):
    """The bounds are aggregated first and joined back, so that no group is gathered in one task."""
    ev = table(spark, d, "events").select("event_id", "event_type", "value")
    bounds = ev.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ev.join(bounds, "event_type").select("event_id", F.round(F.when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))), 6).alias("score"))


@register("a22_percentile_nearest_rank", "SELECT event_type, max(value) FILTER (rn = greatest(ceil(0.5 * n), 1)) AS p50, max(value) FILTER (rn = greatest(ceil(0.95 * n), 1)) AS p95, round(avg(value), 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def a22(spark, d):
    ev = table(spark, d, "events").select("event_type", "value")
    means = ev.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"))
    return evaluation.percentiles(ev, "event_type", "value", {"p50": 0.5, "p95": 0.95}).join(means, "event_type").select("event_type", "p50", "p95", "mean")


@register("a24_answer_meta", f"WITH {EV} SELECT user_id, count(DISTINCT project) AS n_projects, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT session_id) > 1 AS cross_session FROM ev WHERE event_type = 'purchase' GROUP BY 1")
def a24(spark, d):
    return views.events(spark, d).where("event_type = 'purchase'").groupBy("user_id").agg(F.count_distinct("project").alias("n_projects"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (F.count_distinct("session_id") > 1).alias("cross_session"))


@register("a25_vector_breakdown", "SELECT label, len(embedding)::BIGINT AS dimension, count(*) AS n FROM embeddings GROUP BY 1, 2")
def a25(spark, d):
    return table(spark, d, "embeddings").groupBy("label", F.size("embedding").cast("bigint").alias("dimension")).agg(rows())


@register("a26_exclusion_report", "SELECT 'urgent' AS reason, count(*) FILTER (o_orderpriority = '1-URGENT') AS n FROM orders UNION ALL SELECT 'open', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 'large', count(*) FILTER (o_totalprice > 400000 AND o_orderdate >= TIMESTAMP '1996-01-01') FROM orders")
def a26(spark, d):
    reasons = {"urgent": F.col("o_orderpriority") == "1-URGENT", "open": F.col("o_orderstatus") == "O", "large": (F.col("o_totalprice") > 400000) & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"))}
    one = table(spark, d, "orders").agg(*(F.count_if(c).alias(k) for k, c in reasons.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("reason"), F.col(k).alias("n")) for k in reasons))))


@register("a27_partial_summaries", f"WITH {EV} SELECT session_id, max(ts) FILTER (event_type <> 'purchase') AS latest_event, max(ts) FILTER (event_type = 'purchase') AS latest_summary FROM ev GROUP BY 1 HAVING max(ts) FILTER (event_type <> 'purchase') > coalesce(max(ts) FILTER (event_type = 'purchase'), TIMESTAMP '1970-01-01') ORDER BY latest_event DESC, session_id LIMIT 100")
def a27(spark, d):
    is_summary = F.col("event_type") == "purchase"
    got = views.events(spark, d).groupBy("session_id").agg(F.max(F.when(~is_summary, F.col("ts"))).alias("latest_event"), F.max(F.when(is_summary, F.col("ts"))).alias("latest_summary"))
    return got.where(F.col("latest_event") > F.coalesce("latest_summary", F.lit("1970-01-01").cast("timestamp"))).orderBy(F.col("latest_event").desc(), "session_id").limit(100)


@register("u1_union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def u1(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, d, "supplier").where("s_acctbal > 0").select("s_nationkey")).distinct()


@register("u4_intersect", "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def u4(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


@register("u5_except", "SELECT n_nationkey AS nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def u5(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey")).subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@register("w1_latest_summary", "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def w1(spark, d):
    return tables.latest_by(table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text"), ["conv_id"], "turn")


@register("w2_row_ids", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) + (SELECT max(c_custkey) FROM customer) AS row_id FROM supplier")
def w2(spark, d):
    """Row numbers behind a base: partitions are numbered on their own and shifted by the rows before them (one number a partition)."""
    keys = table(spark, d, "supplier").select("s_suppkey")
    # stored, as both readings have to see the rows cut alike
    ranged = cut(keys.repartitionByRange("s_suppkey").withColumn("part", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy("s_suppkey")))
    w = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(rows()).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    base = table(spark, d, "customer").agg(F.max("c_custkey").alias("base"))
    return local.join(F.broadcast(offsets), "part").crossJoin(F.broadcast(base)).select("s_suppkey", (F.col("k") + F.col("before") + F.col("base")).alias("row_id"))


@register("w5_latest_pair", "WITH u AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, u.turn AS user_turn, min(c.turn) AS reply_turn FROM u LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') c USING (conv_id) WHERE c.turn IS NULL OR c.turn > u.turn GROUP BY 1, 2")
def w5(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    last = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("user_turn"))
    replies = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.collect_set("turn").alias("replies"))  # bounded by a conversation's turns
    out = last.join(replies, "conv_id", "left").select("conv_id", "user_turn", F.array_min(F.filter("replies", lambda t: t > F.col("user_turn"))).alias("reply_turn"), "replies")
    return out.where(F.col("replies").isNull() | F.col("reply_turn").isNotNull()).drop("replies")


@register("w6_timeline_neighbours", """WITH c AS (SELECT user_id, ts FROM events WHERE event_id = 50) SELECT * FROM (SELECT event_id, 'before' AS place FROM events e, c WHERE e.user_id = c.user_id AND e.ts < c.ts ORDER BY e.ts DESC, event_id DESC LIMIT 5)
UNION ALL SELECT event_id, 'centre' FROM events WHERE event_id = 50 UNION ALL SELECT * FROM (SELECT event_id, 'after' FROM events e, c WHERE e.user_id = c.user_id AND e.ts > c.ts ORDER BY e.ts, event_id LIMIT 5)""")
def w6(spark, d):
    return temporal.neighbours(table(spark, d, "events").select("event_id", "user_id", "ts"), 50, ["user_id"], "ts", "event_id", 5, 5).select("event_id", "place")


@register("w7_fact_conflicts", f"WITH {FACTS} SELECT * FROM (SELECT project, fact_key, fact_id AS older_id, fact_value AS older_value, lead(fact_id) OVER w AS newer_id, lead(fact_value) OVER w AS newer_value FROM facts WINDOW w AS (PARTITION BY project, fact_key ORDER BY valid_from, fact_id)) WHERE older_value <> newer_value")
def w7(spark, d):
    return temporal.conflicts(views.facts(spark, d), ["project", "fact_key"], "fact_value", "valid_from", "fact_id")


@register("w9_newest_n_per_group", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn <= 10")
def w9(spark, d):
    return tables.newest_n(table(spark, d, "events"), ["event_type"], 10, F.col("ts").desc(), F.col("event_id").desc()).select("event_type", "event_id", "rn")


@register("r26_session_thread", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS step, len(text)::BIGINT AS n_chars FROM conversations")
def r26(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn", "role")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).cast("bigint").alias("step"), F.length("text").cast("bigint").alias("n_chars"))


@register("r29_fact_history", f"WITH {FACTS} SELECT fact_id, project, fact_key, fact_value, valid_from, valid_to, superseded_by IS NULL AND valid_to IS NULL AS is_active FROM facts")
def r29(spark, d):
    """The filter on the key is pushed below the window."""
    facts = views.facts(spark, d).withColumn("merged_into", F.lit(None).cast("bigint"))
    return facts.select("fact_id", "project", "fact_key", "fact_value", "valid_from", "valid_to", P.active_fact().alias("is_active"))


@register("m2_retry_backoff", "SELECT event_id, least(300, pow(2, least(CAST(floor(value) AS BIGINT) % 12, 8)))::DOUBLE AS wait_s FROM events WHERE event_type = 'error'")
def m2(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", scores.retry_wait(F.floor("value") % 12).alias("wait_s"))


@register("m15_branch_merge", "WITH s AS (SELECT doc_id, lang, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1), t AS (SELECT DISTINCT lang, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) SELECT lang, CASE WHEN t.h IS NULL THEN 'promote' ELSE 'skip' END AS action, count(*) AS n FROM s LEFT JOIN t USING (lang, h) GROUP BY 1, 2")
def m15(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return tables.branch_merge(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), ["lang", "h"]).groupBy("lang", "action").agg(rows())


@register("m16_sync_lww", """WITH l AS (SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT o_orderkey, o_orderdate + (o_orderkey % 5 - 2) * INTERVAL 1 DAY AS o_orderdate, 'R' AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 1)
SELECT o_orderkey, CASE WHEN p THEN r.o_orderdate ELSE l.o_orderdate END AS o_orderdate, CASE WHEN p THEN r.o_orderstatus ELSE l.o_orderstatus END AS o_orderstatus, CASE WHEN p THEN 'remote' ELSE 'local' END AS winner FROM l FULL JOIN r USING (o_orderkey), LATERAL (SELECT r.o_orderdate IS NOT NULL AND (l.o_orderdate IS NULL OR r.o_orderdate > l.o_orderdate) AS p)""")
def m16(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    moved = F.timestamp_micros(scores.micros(F.col("o_orderdate")) + (F.col("o_orderkey") % 5 - 2) * 86_400_000_000).cast("timestamp_ntz")
    remote = orders.where("o_orderkey % 3 <> 1").select("o_orderkey", moved.alias("o_orderdate"), F.lit("R").alias("o_orderstatus"))
    return tables.merge_lww(orders.where("o_orderkey % 3 <> 0"), remote, "o_orderkey", "o_orderdate", ["o_orderstatus"])


@register("m18_signal_inbox", f"WITH {EV} SELECT event_id, user_id, ts FROM ev WHERE event_type = 'signup' AND project = 'p1' AND value < 50 AND (user_id = 6 OR event_id % 4 = 0) AND ts > TIMESTAMP '{NOW}' - INTERVAL 14 DAY ORDER BY ts, event_id LIMIT 100")
def m18(spark, d):
    unacked, addressed, alive = F.col("value") < 50, (F.col("user_id") == 6) | (F.col("event_id") % 4 == 0), scores.hours_before(NOW, "ts") < 14 * 24
    return views.events(spark, d).where(P.all_of(P.of_types("event_type", ["signup"]), P.in_projects("project", ["p1"]), unacked, addressed, alive)).select("event_id", "user_id", "ts").orderBy("ts", "event_id").limit(100)


@register("m20_audit_log", "SELECT event_id, user_id, event_type, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def m20(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", "event_type", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50)


@register("m23_skill_sessions", "SELECT conv_id, count(*) AS steps, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1 HAVING count(*) >= 5 AND arg_max(role, turn) = 'assistant'")
def m23(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"), F.max_by("role", "turn").alias("last_role")).where("steps >= 5 AND last_role = 'assistant'")
