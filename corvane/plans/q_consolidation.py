"""Consolidation, links, temporal planning and upkeep of stored rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane import predicates, views
from corvane.functions import cues, provenance, text
from corvane.operators import consolidation, maintenance, retrieval
from corvane.plans.catalogue import register
from corvane.plans.q_retrieval import tok
from corvane.session import table
from corvane.views import OBS

CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}"
KIND = "CASE role WHEN 'user' THEN 'decision' WHEN 'assistant' THEN 'lesson' ELSE 'context' END"


def turns(spark, d):
    """Conversation turns with an id and the kind of observation that their role stands for."""
    kind = F.when(F.col("role") == "user", "decision").when(F.col("role") == "assistant", "lesson").otherwise("context")
    return table(spark, d, "conversations").withColumns({"id": F.col("conv_id") * 1000 + F.col("turn"), "kind": kind})


@register("f42_nuggets")
def f42(spark, d):
    """An order-dependent fold over sentences, tested against brute force."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(consolidation.nuggets(F.col("text"))).alias("seq", "content")).select("doc_id", "seq", "content", F.sha2("content", 256).alias("content_hash"))


def _key_sql(x: str) -> str:
    return f"array_to_string(list_slice(list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9{CJK}\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1), 1, 12), '_')[1:120]"



_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(s), '{p}') THEN '{k}'" for k, p in consolidation.FACT_TYPES) + " ELSE kind END"


@register("f53_extracted_facts", f"""WITH c AS (SELECT conv_id * 1000 + turn AS id, text, {KIND} AS kind, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')[1:500] AS seed FROM conversations),
l AS (SELECT *, list_slice(list_filter(list_transform(string_split_regex(text, '[\\n。.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10), 1, 20) AS lines FROM c),
t AS (SELECT *, list_filter(list_transform(lines, lambda s: {{'fact_type': {_TYPE}, 's': s}}), lambda x: x.fact_type IN ('decision', 'preference', 'lesson', 'pattern', 'action')) AS typed FROM l),
k AS (SELECT *, list_transform(typed, lambda x: {{'fact_type': x.fact_type, 'fact_key': x.fact_type || ':' || {_key_sql('x.s')}, 'fact_value': x.s[1:500]}}) AS f FROM t),
u AS (SELECT *, list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: y.fact_key), x.fact_key) = i) AS g FROM k),
z AS (SELECT id, kind, coalesce(len(g), 0) = 0 AND kind <> 'context' AND seed <> '' AS lone, [{{'fact_type': kind, 'fact_key': kind || ':' || {_key_sql('seed')}, 'fact_value': seed}}] AS alone, g FROM u),
e AS (SELECT id, kind, lone, unnest(CASE WHEN lone THEN alone ELSE g END) AS x, unnest(range(len(CASE WHEN lone THEN alone ELSE g END))) AS place FROM z)
SELECT id, place::BIGINT AS place, x.fact_type AS fact_type, x.fact_key AS fact_key, x.fact_value AS fact_value, CASE WHEN lone THEN 0.6 WHEN x.fact_type = kind THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM e""")
def f53(spark, d):
    return consolidation.extracted_facts(turns(spark, d), "id", "text", "kind")


_NAMES = " || ".join(f"list_transform(regexp_extract_all(html, '{p}', 1), lambda v: lower(v))" for _, p in consolidation.CODE_NAMES)


@register("f23_name_relations", f"""WITH n AS (SELECT page_id, {_NAMES} AS l FROM pages), m AS (SELECT page_id, list_slice(list_filter(l, lambda v, i: list_position(l, v) = i), 1, 20) AS l FROM n),
p AS (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM m), q AS (SELECT page_id, l, i, unnest(range(i + 1, len(l) + 1)) AS j FROM p)
SELECT page_id, l[i] AS src, l[j] AS dst, 1 / len(l) AS strength FROM q""")
def f23(spark, d):
    return consolidation.name_relations(table(spark, d, "pages"), "page_id", consolidation.code_names(F.col("html")))


_WORDS = "list_filter(string_split_regex({x}, '\\s+'), lambda w: length(w) > 2)"
_HAS = " ".join("WHEN " + " OR ".join(f"contains(c, '{w}')" for w in words) + f" THEN '{name}'" for name, words in consolidation.LINK_WORDS)


@register("g10_auto_link", f"""WITH s AS (SELECT conv_id * 1000 + turn AS id, lower(text) AS c, lower(left(text, 60)) AS t, lag(conv_id * 1000 + turn) OVER w AS to_id, lag(lower(left(text, 60))) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, {_WORDS.format(x='t')} AS m, list_distinct({_WORDS.format(x='p')}) AS b FROM s WHERE to_id IS NOT NULL),
a AS (SELECT *, CASE WHEN len(m) > 0 AND len(b) > 0 THEN len(list_filter(m, lambda w: list_contains(b, w))) / greatest(len(m), len(b)) ELSE 0 END AS alike FROM k)
SELECT id AS from_id, to_id, CASE {_HAS} WHEN alike >= 0.6 THEN 'updates' WHEN alike >= 0.3 THEN 'extends' ELSE 'follows' END AS relation FROM a""")
def g10(spark, d):
    return consolidation.auto_link(turns(spark, d).withColumn("title", F.substring("text", 1, 60)), "id", "conv_id", "turn", "title", "text")


@register("g11_auto_supersede", f"""WITH s AS (SELECT conv_id, role, conv_id * 1000 + turn AS id, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS k, list_distinct({tok('text')}) AS t FROM conversations),
n AS (SELECT * FROM s WHERE len(t) > 0)
SELECT a.id AS from_id, b.id AS to_id, len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) AS weight FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.role = b.role AND b.k < a.k AND b.k >= a.k - 50 WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) >= 0.1""")
def g11(spark, d):
    w = W.partitionBy("conv_id", "role").orderBy("turn")
    return consolidation.auto_supersede(turns(spark, d).select("conv_id", "role", "id", (F.row_number().over(w) - 1).alias("k"), text.token_set(F.col("text")).alias("t")), "id", ["conv_id", "role"], "k", "t")


_PAIRS = f"""t AS (SELECT doc_id, source, list_distinct({tok('text')}) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
p AS (SELECT a.doc_id AS older_id, b.doc_id AS newer_id, a.source AS concept, CASE WHEN len(list_distinct(a.t || b.t)) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) END AS jaccard FROM t a JOIN t b ON a.source = b.source AND a.doc_id < b.doc_id WHERE a.n <= 100 AND b.n <= 100),
m AS (SELECT * FROM p WHERE jaccard >= 0.9 QUALIFY row_number() OVER (PARTITION BY concept ORDER BY newer_id DESC, older_id) <= 50)"""


def _pairs(spark, d):
    rows = table(spark, d, "documents").where("source IS NOT NULL AND text IS NOT NULL").select("doc_id", "source", F.col("doc_id").alias("at"), text.token_set(F.col("text")).alias("t"))
    return consolidation.contradictions(rows, "doc_id", "source", "at", "t")


@register("m6_contradictions", f"WITH {_PAIRS} SELECT older_id, newer_id, concept, jaccard::DOUBLE AS jaccard FROM m")
def m6(spark, d):
    return _pairs(spark, d)


@register("m6_superseded_links", f"WITH {_PAIRS} SELECT newer_id AS from_id, older_id AS to_id, 'superseded' AS relation, newer_id AS valid_to FROM m WHERE older_id % 2 = 0")
def m6_links(spark, d):
    """The judge of this query confirms pairs whose older row is even."""
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("at"))
    return consolidation.confirm_contradictions(_pairs(spark, d), rows, "doc_id", "at", F.col("older_id") % 2 == 0, F.lit(0.8))


@register("m7_completed_plans", f"""WITH s AS (SELECT conv_id, turn, role, conv_id * 1000 + turn AS id, list_filter({tok('text')}, lambda w: length(w) >= 3) AS t FROM conversations)
SELECT a.conv_id, a.id AS planned_id, arg_min(b.id, b.turn) AS evidence_id FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn > a.turn AND a.role = 'user' AND b.role = 'assistant' AND len(list_intersect(a.t, b.t)) > 0 GROUP BY 1, 2""")
def m7(spark, d):
    """User turns stand for plans, assistant turns for evidence."""
    rows = turns(spark, d)
    tokens = F.filter(text.tokens(F.col("text")), lambda w: F.length(w) >= 3)
    return consolidation.completed_plans(rows, "id", "conv_id", "turn", tokens, F.col("role") == "user", F.col("role") == "assistant")


@register("p17_file_filter", "WITH t AS (SELECT doc_id, 'file:' || source || '/' || lang AS tag FROM documents), s AS (SELECT min(source) AS s FROM documents) SELECT doc_id FROM t, s WHERE tag = 'file:' || s || '/en' UNION SELECT doc_id FROM t WHERE contains(tag, '/de') AND NOT EXISTS (SELECT 1 FROM t WHERE tag = 'file:/de')")
def p17(spark, d):
    """One path that is a whole tag, one that is a part of some."""
    docs = table(spark, d, "documents")
    tags = docs.select(F.col("doc_id").alias("row_id"), F.concat(F.lit("file:"), "source", F.lit("/"), "lang").alias("tag"))
    least = docs.agg(F.min("source")).first()[0] or ""
    return predicates.file_filter(docs.select("doc_id"), "doc_id", tags, f"what changed file:{least}/en file:/de").select("doc_id")


_NOW = "2024-01-02 00:00:00"
_CUED = "CASE doc_id % 9 WHEN 0 THEN 'It is currently ' WHEN 1 THEN 'We previously had ' WHEN 2 THEN 'no longer ' WHEN 3 THEN 'Right after ' WHEN 4 THEN 'until ' WHEN 5 THEN 'the first ' WHEN 6 THEN 'most recent ' ELSE '' END || coalesce(content, '')"
_STATES = f"v AS (SELECT doc_id, created_at, n_chars, {_CUED} AS x, CASE WHEN doc_id % 7 = 0 THEN created_at + INTERVAL 1 HOUR END <= TIMESTAMP '{_NOW}' AS ended, created_at > TIMESTAMP '{_NOW}' AS pending FROM obs)"


def _has(name: str, points: int) -> str:
    return f"CASE WHEN regexp_matches(x, '{cues.CUES[name]}') THEN {points} ELSE 0 END"


_SCORE = {
    "current": f"CASE WHEN coalesce(ended, false) OR pending THEN -2 ELSE 2 END + {_has('current', 3)}",
    "previous": f"{_has('strong_previous', 4)} + {_has('previous', 1)} + CASE WHEN ended THEN 1 ELSE 0 END + {_has('current', -1)}",
    "previous_current": f"CASE WHEN regexp_matches(x, '{cues.CUES['current']}') AND NOT regexp_matches(x, '{cues.CUES['strong_previous']}') THEN 4 ELSE 0 END + {_has('latest', -2)} + {_has('no_longer', -1)} + CASE WHEN coalesce(ended, false) OR pending THEN -1 ELSE 0 END",
    "no_longer": f"{_has('no_longer', 4)} + CASE WHEN ended THEN 2 ELSE 0 END + {_has('current', -1)}",
    "after": _has("after", 5), "before": _has("before", 5), "first": f"{_has('first', 5)} + {_has('previous', 1)}", "latest": f"{_has('latest', 5)} + {_has('current', 2)}",
}


def _stated(spark, d):
    obs = views.observations(spark, d)
    planted = ["It is currently ", "We previously had ", "no longer ", "Right after ", "until ", "the first ", "most recent "]
    place = (F.col("doc_id") % 9).cast("int")
    start = F.when(place < len(planted), F.element_at(F.array(*map(F.lit, planted)), F.least(place + 1, F.lit(len(planted))))).otherwise("")
    now = F.lit(_NOW).cast("timestamp_ntz")
    ended = F.when(F.col("doc_id") % 7 == 0, F.col("created_at") + F.expr("INTERVAL 1 HOUR")) <= now
    return obs.select("doc_id", "created_at", "n_chars", F.concat(start, F.coalesce("content", F.lit(""))).alias("x"), ended.alias("ended"), (F.col("created_at") > now).alias("pending"))


@register("f35_state_scores", f"WITH {OBS}, {_STATES} SELECT doc_id, " + ", ".join(f"({s})::BIGINT AS {m}" for m, s in _SCORE.items()) + " FROM v")
def f35(spark, d):
    return _stated(spark, d).select("doc_id", *(cues.state_score(m, F.col("x"), F.col("ended"), F.col("pending")).cast("bigint").alias(m) for m in cues.MODES))


@register("r13_temporal_rerank", f"""WITH {OBS}, {_STATES}, h AS (SELECT doc_id, created_at, n_chars, ({_SCORE['current']})::BIGINT AS state FROM v ORDER BY n_chars DESC, doc_id LIMIT 90),
p AS (SELECT doc_id, state, row_number() OVER (ORDER BY state DESC, created_at DESC, n_chars DESC, doc_id) AS place FROM h) SELECT * FROM p WHERE place <= 10""")
def r13(spark, d):
    state = cues.state_score("current", F.col("x"), F.col("ended"), F.col("pending"))
    return retrieval.temporal_rerank(_stated(spark, d), "doc_id", "n_chars", state, "created_at", 10, True)


_TOKENS = "CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN greatest(1, ceil(length(text) / 4)) ELSE 1 END::BIGINT"


@register("r28_resume_pack", f"""WITH s AS (SELECT conv_id, turn, role, {_TOKENS} AS tokens, max(turn) OVER (PARTITION BY conv_id) - turn AS age FROM conversations),
l AS (SELECT conv_id, max(turn) AS turn FROM s WHERE role = 'assistant' GROUP BY 1),
o AS (SELECT s.*, s.turn IS NOT DISTINCT FROM l.turn AS latest, CASE role WHEN 'user' THEN 0.8 WHEN 'assistant' THEN 0.5 ELSE 0.4 END * exp(-age / 8.0) AS score FROM s LEFT JOIN l USING (conv_id)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY latest DESC, score DESC, turn DESC ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY conv_id ORDER BY latest DESC, score DESC, turn DESC) AS place FROM o)
SELECT conv_id, turn, CASE WHEN latest THEN 'summary' ELSE 'item' END AS section, place, spent::BIGINT AS spent FROM c WHERE latest OR spent <= 400""")
def r28(spark, d):
    return retrieval.resume_pack(table(spark, d, "conversations").withColumn("tokens", text.token_estimate(F.col("text"))), "conv_id", "turn", F.col("role") == "assistant", F.when(F.col("role") == "user", 0.8).when(F.col("role") == "assistant", 0.5).otherwise(0.4), 400)


@register("r30_verify_provenance", f"""WITH {OBS} SELECT o.doc_id, CASE WHEN e.event_id IS NULL THEN 'missing_event' WHEN e.ts > o.created_at + INTERVAL 10 DAY THEN 'time_conflict' WHEN o.content IS NULL THEN 'empty' ELSE 'verified' END AS status FROM obs o LEFT JOIN events e ON e.event_id = o.doc_id * 3""")
def r30(spark, d):
    source = table(spark, d, "events").select(F.col("event_id").alias("source_id"), F.col("ts").alias("source_time"))
    obs = views.observations(spark, d).select("doc_id", "content", "created_at", (F.col("doc_id") * 3).alias("source_id"))
    return maintenance.verified(obs, source, "source_id", F.col("source_time").cast("timestamp_ntz") > F.col("created_at") + F.expr("INTERVAL 10 DAY"), F.col("content").isNull()).select("doc_id", "status")


@register("s31_backup_manifest", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, sum({k})::BIGINT AS key_sum, min({k})::BIGINT AS key_min, max({k})::BIGINT AS key_max FROM {t}" for t, k in (("nation", "n_nationkey"), ("orders", "o_orderkey"), ("documents", "doc_id"))))
def s31(spark, d):
    return maintenance.manifest({t: (table(spark, d, t), k) for t, k in (("nation", "n_nationkey"), ("orders", "o_orderkey"), ("documents", "doc_id"))})


@register("m12_vector_repair", "SELECT coalesce(d.doc_id, e.vec_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'prune' WHEN e.vec_id IS NULL THEN 'backfill' ELSE 'reindex' END AS action FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT vec_id, label, len(embedding) AS n FROM embeddings) e ON d.doc_id = e.vec_id WHERE d.doc_id IS NULL OR e.vec_id IS NULL OR e.n <> 64 OR e.label = 3")
def m12(spark, d):
    """Rows whose id is divisible by three are gone; vectors with label 3 are of an older model."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), ((F.size("embedding") != 64) | (F.col("label") == 3)).alias("stale"))
    return maintenance.vector_repair(table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id")), vectors)


@register("m10_archive_restore", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 12 <> 0 THEN 'archived' ELSE 'live' END AS state, CASE WHEN doc_id % 4 = 0 AND doc_id % 12 <> 0 THEN 0 ELSE coalesce(length(text), 0) END::BIGINT AS n FROM documents")
def m10(spark, d):
    """Every fourth row is archived, then every third of these restored."""
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("state", F.lit("live"))
    live, archive = maintenance.archived(docs, F.col("doc_id") % 4 == 0, "text")
    back = maintenance.restored(live, archive, archive.where(F.col("doc_id") % 3 == 0).select("doc_id"), "doc_id", "text")
    return back.select("doc_id", "state", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))


@register("m11_hard_purge", """WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'documents' AS name, count(*) FILTER (doc_id IN (SELECT doc_id FROM g)) AS purged, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM g)) AS kept FROM documents
UNION ALL SELECT 'labels', count(*) FILTER (doc_id IN (SELECT doc_id FROM g)), count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM g)) FROM labels
UNION ALL SELECT 'embeddings', count(*) FILTER (vec_id IN (SELECT doc_id FROM g)), count(*) FILTER (vec_id NOT IN (SELECT doc_id FROM g)) FROM embeddings""")
def m11(spark, d):
    """The manifest of purging the toxic documents with all that hangs on them."""
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    parts = {"documents": (table(spark, d, "documents"), "doc_id"), "labels": (table(spark, d, "labels"), "doc_id"), "embeddings": (table(spark, d, "embeddings"), "vec_id")}
    return maintenance.purge_manifest(parts, gone)


_LIFE = "life AS (SELECT doc_id, text, source, CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-01' END AS archived_at, CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR END AS expires_at, CASE doc_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'side' END AS branch, ['t' || (doc_id % 6), 'u'] AS tags FROM documents)"


def _life(spark, d):
    doc = F.col("doc_id")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, d, "documents").select(
        "doc_id", "text", "source", F.when(doc % 5 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("archived_at"), F.when(doc % 4 == 0, F.timestamp_micros(start + doc * 3_600_000_000).cast("timestamp_ntz")).alias("expires_at"),
        F.when(doc % 3 == 0, "main").when(doc % 3 == 1, "side").alias("branch"), F.array(F.concat(F.lit("t"), (doc % 6).cast("string")), F.lit("u")).alias("tags"))


@register("p6_not_archived", f"WITH {_LIFE} SELECT doc_id FROM life WHERE archived_at IS NULL")
def p6(spark, d):
    return _life(spark, d).where(predicates.not_archived()).select("doc_id")


@register("p7_not_expired", f"WITH {_LIFE} SELECT doc_id FROM life WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-10'")
def p7(spark, d):
    return _life(spark, d).where(predicates.not_expired(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))).select("doc_id")


@register("p11_branch", f"WITH {_LIFE} SELECT doc_id FROM life WHERE branch = 'main' OR branch IS NULL")
def p11(spark, d):
    return _life(spark, d).where(predicates.branch("main")).select("doc_id")


@register("p12_platforms", f"WITH {_LIFE} SELECT doc_id FROM life WHERE source NOT IN (SELECT min(source) FROM documents)")
def p12(spark, d):
    hidden = [r[0] for r in table(spark, d, "documents").agg(F.min("source")).collect()]  # one value
    return _life(spark, d).where(predicates.platforms(hidden, "source")).select("doc_id")


@register("p18_protected", f"WITH {_LIFE} SELECT doc_id, list_has_any(tags, ['t1', 't4']) AS held FROM life")
def p18(spark, d):
    return _life(spark, d).select("doc_id", predicates.protected("tags", ["t1", "t4"]).alias("held"))


@register("p20_suppressed", f"WITH {_LIFE} SELECT doc_id FROM life WHERE coalesce(regexp_matches(text, 'token = '), false) OR coalesce(regexp_matches(text, '[0-9]{{4}} [0-9]{{4}}'), false)")
def p20(spark, d):
    return _life(spark, d).where(predicates.suppressed("text", ["token = ", "[0-9]{4} [0-9]{4}"])).select("doc_id")


_PAYLOADS = (
    '{"tool_name":"Write","file_path":" src/a%d.ts ","model_id":"m1"}', '{"tool_name":"Edit","path":"lib/b%d.PY"}', '{"tool_name":"Read","filename":"notes%d"}', '{"tool_name":"Bash","command":"rm -rf out%d.json"}',
    '{"tool_name":"Bash","cmd":"touch new%d.rs && ls"}', '{"tool_name":"Bash","command":"cat conf/%d.yaml | less"}', '{"tool_name":"Bash","command":"python run%d.py"}', '{"tool_name":"Bash","command":"sed -i s/a/b/ ./x/%d.go"}',
    '{"file":"y%d.md","old_string":"a"}', '{"filePath":"z%d.unknown"}', '{"tool_name":"Bash","command":"ls"}', '{"k":%d}',
)


def _path_sql() -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(json_extract_string(p, '$.{f}')), '')" for f in provenance.PATH_FIELDS) + ")"


_CMD = "coalesce(json_extract_string(p, '$.command'), json_extract_string(p, '$.cmd'))"
def _found_sql(pattern: str) -> str:
    return " || ".join(f"regexp_extract(c, '{pattern}', {k + 1})" for k in range(max(1, pattern.count("([^"))))


_SHELL_PATH = "coalesce(" + ", ".join(f"nullif({_found_sql(x)}, '')" for x in [*(x for _, x in provenance.COMMANDS), provenance.ANY_PATH]) + ")"
_SHELL_ACTION = "CASE " + " ".join(f"WHEN {_found_sql(x)} <> '' THEN '{a}'" for a, x in provenance.COMMANDS) + f" WHEN regexp_extract(c, '{provenance.ANY_PATH}', 1) <> '' THEN CASE WHEN regexp_matches(c, '{provenance.WRITES}') THEN 'edit' ELSE 'read' END END"


@register("f50_code_provenance", "WITH e AS (SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {i} THEN replace('{x}', '%d', event_id::VARCHAR)" for i, x in enumerate(_PAYLOADS)) + f""" END AS p FROM events),
t AS (SELECT event_id, p, {_CMD} AS c, json_extract_string(p, '$.tool_name') AS tool FROM e),
f AS (SELECT event_id, p, CASE WHEN tool = 'Bash' THEN {_SHELL_PATH} ELSE {_path_sql()} END AS file_path, CASE tool WHEN 'Bash' THEN {_SHELL_ACTION} WHEN 'Write' THEN 'create' WHEN 'Edit' THEN 'edit' WHEN 'Read' THEN 'read'
  ELSE CASE WHEN json_extract_string(p, '$.old_string') IS NOT NULL OR json_extract_string(p, '$.new_string') IS NOT NULL THEN 'edit' ELSE 'read' END END AS action FROM t)
SELECT event_id, file_path, action, json_extract_string(p, '$.model_id') AS model_id, MAP {{{", ".join(f"'{k}': '{v}'" for k, v in provenance.LANGUAGES.items())}}}[lower(regexp_extract(file_path, '\\.([^.]*)$', 1))] AS language FROM f WHERE file_path IS NOT NULL""")
def f50(spark, d):
    """Payloads of twelve kinds laid over the events."""
    payload = F.element_at(F.array(*map(F.lit, _PAYLOADS)), (F.col("event_id") % 12 + 1).cast("int"))
    payload = F.replace(payload, F.lit("%d"), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", provenance.code_provenance(payload).alias("p")).where("p IS NOT NULL").select("event_id", "p.*")
