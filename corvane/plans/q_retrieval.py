"""Vectors, lexical search, fusion, text functions and graphs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane import views
from corvane.functions import scores, search_tokens, text, vectors
from corvane.functions.text import ALLOWED_SCHEME, PRIVATE_HOST, URL_HOST
from corvane.operators import graph, retrieval, similarity
from corvane.operators.stored_index import stored_for
from corvane.plans.catalogue import register
from corvane.session import table
from corvane.views import NOW, OBS

COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
VEC = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
TERMS = ["tion", "with"]
QUERY_ID = 0


def query_vector(spark, d) -> list[float]:
    """The query's vector: one row by key."""
    row = table(spark, d, "embeddings").where(F.col("vec_id") == QUERY_ID).select("embedding").head()
    return list(row[0]) if row else [0.0] * 64


def _cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


@register("f10_cosine_topk", f"WITH {VEC}, q AS (SELECT v AS qv FROM e WHERE vec_id = 0) SELECT vec_id, round({_cos('v', 'qv')}, 6) AS cosine FROM e, q ORDER BY {_cos('v', 'qv')} DESC, vec_id LIMIT 20")
def f10(spark, d):
    return similarity.cosine_top_k(table(spark, d, "embeddings"), query_vector(spark, d), 20).select("vec_id", F.round("cosine", 6).alias("cosine"))


BITS = "list_transform(range(64), lambda i: CASE WHEN {v}[i + 1] > 0 THEN 1 ELSE 0 END)"
HAMMING = "list_sum(list_transform(range(64), lambda i: CASE WHEN (v[i + 1] > 0) <> (qv[i + 1] > 0) THEN 1 ELSE 0 END))"


@register("f12_hamming_prefilter", f"WITH {VEC}, q AS (SELECT v AS qv FROM e WHERE vec_id = 0), h AS (SELECT vec_id, v, qv, CAST({HAMMING} AS BIGINT) AS distance FROM e, q ORDER BY distance, vec_id LIMIT 100) SELECT vec_id, distance, round({_cos('v', 'qv')}, 6) AS cosine FROM h ORDER BY {_cos('v', 'qv')} DESC, vec_id LIMIT 10")
def f12(spark, d):
    return similarity.hamming_prefilter_top_k(table(spark, d, "embeddings"), query_vector(spark, d), 10, 100).select("vec_id", "distance", F.round("cosine", 6).alias("cosine"))


@register("f11_resize", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding[1:16] AS DOUBLE[]), lambda x: x * x)), 6) AS head_square, 128::BIGINT AS padded FROM embeddings")
def f11(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.pow(vectors.norm(vectors.resized(v, 16)), F.lit(2.0)), 6).alias("head_square"), F.size(vectors.resized(v, 128)).cast("bigint").alias("padded"))


@register("j13_cosine_links", f"WITH {VEC}, h AS (SELECT * FROM e ORDER BY vec_id DESC LIMIT 300) SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({_cos('a.v', 'b.v')}, 6) AS cosine FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE {_cos('a.v', 'b.v')} >= 0.35")
def j13(spark, d):
    return similarity.cosine_links(table(spark, d, "embeddings"), 0.35, 300).select("a_id", "b_id", F.round("cosine", 6).alias("cosine"))


TOK = "list_slice(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1), 1, {n})"


def tok(x: str, n: int = 64) -> str:
    return TOK.format(x=x, n=n)


@register("f1_tokenize", f"SELECT item_id, len({tok('text')})::BIGINT AS n_tokens, len(list_distinct({tok('text')}))::BIGINT AS n_distinct, array_to_string({tok('text', 8)}, ' ') AS head FROM benchmark")
def f1(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", F.size(text.tokens(t)).cast("bigint").alias("n_tokens"), F.size(text.token_set(t)).cast("bigint").alias("n_distinct"), F.array_join(text.tokens(t, 8), " ").alias("head"))


_SETS = f"s AS (SELECT doc_id, lang, list_distinct({tok('text')}) AS s FROM documents)"
_JAC = "len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))"


@register("f13_jaccard_pairs", f"WITH {_SETS} SELECT a.doc_id AS a_id, b.doc_id AS b_id, round({_JAC}, 6) AS jaccard FROM s a JOIN s b ON a.lang = b.lang AND a.doc_id < b.doc_id WHERE len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) >= 0.9 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))")
def f13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", text.tokens(F.col("text")).alias("t"))
    return similarity.token_self_join(docs, "doc_id", "t", 0.9, groups=["lang"]).select("a_id", "b_id", F.round("jaccard", 6).alias("jaccard"))


@register("g12_derives_band", f"WITH s AS (SELECT item_id, list_distinct({tok('text')}) AS s FROM benchmark), p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, {_JAC} AS j FROM s a JOIN s b ON a.item_id < b.item_id) SELECT a_id, b_id, round(0.5 + j, 6) AS weight FROM p WHERE j BETWEEN 0.05 AND 0.35 UNION ALL SELECT b_id, a_id, round(0.5 + j, 6) FROM p WHERE j BETWEEN 0.05 AND 0.35")
def g12(spark, d):
    items = table(spark, d, "benchmark").orderBy(F.col("item_id").desc()).limit(200).select("item_id", text.tokens(F.col("text")).alias("t"))  # the operator's own bound
    p = similarity.token_self_join(items, "item_id", "t", 0.05, 0.35).select("a_id", "b_id", F.round(0.5 + F.col("jaccard"), 6).alias("weight"))
    return p.unionAll(p.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "weight"))


@register("f9_hash_embed", """WITH t AS (SELECT item_id, unnest(list_slice(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1), 1, 64)) AS token FROM benchmark),
h AS (SELECT item_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM t)
SELECT item_id, CAST(h % 64 AS BIGINT) AS bucket, CAST(sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS value FROM h GROUP BY 1, 2""")
def f9(spark, d):
    """Hashing embedder: bucket h mod 64, sign by the parity of h."""
    ascii_only = F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^a-z0-9\s]", " "), r"\s+", " ")), " "), lambda w: F.length(w) > 1)
    t = table(spark, d, "benchmark").select("item_id", F.explode(F.slice(ascii_only, 1, 64)).alias("token")).select("item_id", vectors.token_hash(F.col("token")).alias("h"))
    return t.groupBy("item_id", (F.col("h") % 64).alias("bucket")).agg(F.sum(F.when(F.col("h") % 2 == 0, 1).otherwise(-1)).cast("bigint").alias("value"))


@register("f15_recency_decay", f"""WITH a AS (SELECT event_id, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9) AS h FROM events)
SELECT event_id, round(exp(-h / 2160), 6) AS recency, CASE WHEN h < 24 THEN 'hot' WHEN h < 168 THEN 'warm' ELSE 'cold' END AS tier, CASE WHEN h < 24 THEN 1.0 WHEN h < 168 THEN 0.7 ELSE 0.4 END::DOUBLE AS factor FROM a""")
def f15(spark, d):
    tier = scores.decay_tier(NOW, "ts")
    return table(spark, d, "events").select("event_id", F.round(scores.recency(NOW, "ts"), 6).alias("recency"), tier.alias("tier"), scores.decay_factor(tier).alias("factor"))


#: Turns of `conversations` as rows with the event types that the classifiers know.
_VALUES = "notes AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'system' OR turn = 0 THEN 'session_start' WHEN turn % 9 = 8 THEN 'tool_use' WHEN turn % 11 = 10 THEN 'session_end' ELSE 'note' END AS event_type, text AS content FROM conversations)"


def notes(spark, d):
    turn = F.col("turn")
    kind = F.when((F.col("role") == "system") | (turn == 0), "session_start").when(turn % 9 == 8, "tool_use").when(turn % 11 == 10, "session_end").otherwise("note")
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + turn).alias("id"), kind.alias("event_type"), F.col("text").alias("content"))


def _case(column: str, cases, default: str) -> str:
    return "CASE " + " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format(column, p.replace("'", "''"), k) for k, p in cases) + f" ELSE '{default}' END"


@register("f19_classify_type", f"WITH {_VALUES} SELECT id, CASE event_type WHEN 'session_end' THEN 'summary' WHEN 'session_start' THEN 'context' WHEN 'tool_use' THEN 'action' ELSE {_case('lower(content)', text.OBSERVATION_TYPES, 'context')} END AS observation_type FROM notes")
def f19(spark, d):
    return notes(spark, d).select("id", text.observation_type(F.col("content"), F.col("event_type")).alias("observation_type"))


@register("f20_memory_type", f"WITH {_VALUES} SELECT id, CASE WHEN event_type IN ('session_start', 'session_end') OR regexp_matches(lower(content), '{text.EPISODIC}') THEN 'episodic' WHEN event_type = 'tool_use' OR regexp_matches(lower(content), '{text.PROCEDURAL}') OR regexp_matches(content, '(?s)```.*```') THEN 'procedural' ELSE 'semantic' END AS memory_type FROM notes")
def f20(spark, d):
    return notes(spark, d).select("id", text.memory_type(F.col("content"), F.col("event_type")).alias("memory_type"))


def _sector_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{'|'.join(patterns)}') THEN '{name}'" for name, patterns in text.SECTORS) + " ELSE 'meta' END"


@register("f3_search_tokens")
def f3(spark, d):
    """Tokens of every document, with the words of CJK text that the documents teach."""
    docs = table(spark, d, "documents")
    tokens = search_tokens.search_tokens(F.col("text"), search_tokens.learn_words(docs))
    return docs.select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@register("f21_sector_documents", f"SELECT doc_id, {_sector_sql('text')} AS sector FROM documents")
def f21_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sector(F.col("text")).alias("sector"))


@register("f18_signal", f"WITH {_VALUES} SELECT id, round(CASE WHEN regexp_matches(content, '{text.BOOST}') THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(content, '{text.DAMPEN}') THEN 0.2 ELSE 0 END, 6)::DOUBLE AS signal FROM notes")
def f18(spark, d):
    return notes(spark, d).select("id", F.round(text.signal(F.col("content")), 6).alias("signal"))


def _redact_sql(x: str) -> str:
    for pattern, put in text.REDACTIONS:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern.replace("'", "''"), put)
    return x


@register("f25_redaction", f"SELECT doc_id, sha256({_redact_sql('text')}) AS redacted_sha256, contains({_redact_sql('text')}, '[REDACTED_EMAIL]') AS had_email, contains({_redact_sql('text')}, '[REDACTED_SECRET]') AS had_secret FROM documents")
def f25(spark, d):
    got = table(spark, d, "documents").select("doc_id", text.redacted(F.col("text")).alias("r"))
    return got.select("doc_id", F.sha2("r", 256).alias("redacted_sha256"), F.contains("r", F.lit("[REDACTED_EMAIL]")).alias("had_email"), F.contains("r", F.lit("[REDACTED_SECRET]")).alias("had_secret"))


@register("f28_dedupe_hash", "SELECT event_id, sha256(concat_ws('|', user_id, event_type, epoch_us(ts), coalesce(props, ''))) AS dedupe_hash FROM events")
def f28(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", scores.micros(F.col("ts")).cast("string"), F.coalesce("props", F.lit(""))), 256).alias("dedupe_hash"))


_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@register("f29_content_dup_groups", f"SELECT sha256({_NORM}) AS content_hash, count(*) AS n, max(doc_id) AS kept_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def f29(spark, d):
    key = F.sha2(text.normal_content(F.col("text")), 256).alias("content_hash")
    return table(spark, d, "documents").groupBy(key).agg(F.count("*").alias("n"), F.max("doc_id").alias("kept_id")).where("n > 1")


@register("f31_tag_match", f"WITH {OBS} SELECT doc_id, round((CASE WHEN contains(lang, 'en') THEN 1 ELSE 0 END + CASE WHEN contains(project, 'src1') OR project = 'src1' OR contains('src1', project) THEN 1 ELSE 0 END) / 2, 6)::DOUBLE AS score FROM obs")
def f31(spark, d):
    wanted, have = F.array(F.lit("en"), F.lit("src1")), text.normal_tags(F.array("lang", "project"))
    return views.observations(spark, d).select("doc_id", F.round(text.tag_match(wanted, have), 6).alias("score"))


@register("f45_token_estimate", "SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN greatest(1, ceil(length(text) / 4)) ELSE 1 END::BIGINT AS tokens FROM documents")
def f45(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@register("f49_json_extract", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total_k, count(*) FILTER (json_extract_string(props, '$.none') IS NULL) AS n_missing FROM events GROUP BY 1")
def f49(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total_k"), F.count_if(F.get_json_object("props", "$.none").isNull()).alias("n_missing"))


@register("f52_consume_detection", "SELECT d.doc_id, list_sum(list_transform(['thand', 'onre', 'zzz'], lambda s: CASE WHEN contains(d.text, s) THEN 1 ELSE 0 END))::BIGINT AS signals, contains(d.text, 'thand') OR contains(d.text, 'onre') OR contains(d.text, 'zzz') AS consumed FROM documents d")
def f52(spark, d):
    signals = ["thand", "onre", "zzz"]
    hits = sum((F.contains("text", F.lit(s)).cast("bigint") for s in signals), F.lit(0).cast("bigint"))
    return table(spark, d, "documents").select("doc_id", hits.alias("signals"), (hits > 0).alias("consumed"))


_HTML = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g'), '(?i)</(p|div|section|article|header|footer|li|ul|ol|table|tr|h[1-6]|blockquote|pre)>|<(br|hr)\\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _e, _c in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    _HTML = f"replace({_HTML}, '{_e}', {_c})"
_HTML = f"regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"


@register("s17_html_text", f"SELECT page_id, length({_HTML})::BIGINT AS n_chars, sha256({_HTML}) AS text_sha256, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")
def s17(spark, d):
    got = table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("t"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"))
    return got.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"), "title")


# Fixed value: hosts that must not be fetched.
_URLS = ["http://127.0.0.1/x", "ftp://a.example.com/", "http://[::1]:8080/a", "https://2130706433/", "http://me:pw@localhost/", "HTTP://user@Example.com:80/?q=@x", "http://0x7f000001/"]


def _guard_sql(url: str) -> str:
    return f"regexp_matches({url}, '{ALLOWED_SCHEME}') AND NOT regexp_matches(lower(regexp_extract({url}, '{URL_HOST}', 1)), '{PRIVATE_HOST}')"


@register("s20_url_guard", "WITH u AS (SELECT page_id, CASE page_id % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_URLS)) + f" ELSE url END AS url FROM pages) SELECT page_id, lower(regexp_extract(url, '{URL_HOST}', 1)) AS host, {_guard_sql('url')} AS allowed FROM u")
def s20(spark, d):
    """With private, bracketed, decimal and user-info hosts put in."""
    place = F.col("page_id") % 9
    url = F.col("url")
    for i, x in enumerate(_URLS):
        url = F.when(place == i, x).otherwise(url)
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract(url, URL_HOST, 1)).alias("host"), text.url_allowed(url).alias("allowed"))


@register("r1_lexical_scan", f"WITH {OBS}, w AS (SELECT * FROM obs ORDER BY created_at DESC, doc_id DESC LIMIT 400), h AS (SELECT doc_id, (2 * contains(lower(project), 'tion')::INT + contains(lower(content), 'tion')::INT + 2 * contains(lower(project), 'with')::INT + contains(lower(content), 'with')::INT)::DOUBLE AS raw FROM w) SELECT doc_id, raw, round(CASE WHEN (SELECT max(raw) = min(raw) FROM h WHERE raw > 0) THEN 1 ELSE (raw - (SELECT min(raw) FROM h WHERE raw > 0)) / (SELECT max(raw) - min(raw) FROM h WHERE raw > 0) END, 6)::DOUBLE AS score FROM h WHERE raw > 0")
def r1(spark, d):
    hits = retrieval.lexical_scan(views.observations(spark, d), "doc_id", F.col("project"), F.col("content"), TERMS, F.col("created_at"), 400)
    return retrieval.normalised(hits, "raw", "score").select("doc_id", "raw", F.round("score", 6).alias("score"))


_BM_TOK = "list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda w: length(w) > 1)"


def _bm_tokens():
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^a-z]+", " ")), " "), lambda w: F.length(w) > 1)


BM25 = f"""dt AS (SELECT doc_id, {_BM_TOK} AS t FROM documents), c AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM dt),
x AS (SELECT doc_id, len(t) AS l, unnest(list_filter(t, lambda w: w IN ('that', 'thing', 'onre'))) AS term FROM dt), tf AS (SELECT doc_id, l, term, count(*) AS tf FROM x GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / avg_len))) AS raw FROM tf JOIN df USING (term), c GROUP BY 1)"""
BM_TERMS = ["that", "thing", "onre"]


def bm_index(spark, d: str) -> str:
    """The folder of the stored index of `documents` as they are now."""
    docs = table(spark, d, "documents")
    return stored_for(docs, "postings", lambda folder: retrieval.store_index(retrieval.postings(docs, "doc_id", _bm_tokens()), folder, "doc_id"))


def _bm25(spark, d):
    return retrieval.bm25_indexed(spark, bm_index(spark, d), "doc_id", BM_TERMS).select("doc_id", F.round("raw", 6).alias("score"))


@register("r2_bm25", f"WITH {BM25} SELECT doc_id, round(raw, 6) AS score FROM bm ORDER BY round(raw, 6) DESC, doc_id LIMIT 50")
def r2(spark, d):
    return _bm25(spark, d).orderBy(F.col("score").desc(), "doc_id").limit(50)


@register("r2_bm25_all_or_any", f"""WITH {BM25}, c2 AS (SELECT doc_id, count(*) AS n FROM tf GROUP BY 1), w AS (SELECT coalesce(max(n) = 3, false) AS every FROM c2)
SELECT doc_id, round(raw, 6) AS score FROM bm JOIN c2 USING (doc_id), w WHERE NOT every OR n = 3 ORDER BY round(raw, 6) DESC, doc_id LIMIT 50""")
def r2_all_or_any(spark, d):
    scored = retrieval.all_or_any(retrieval.bm25_indexed(spark, bm_index(spark, d), "doc_id", BM_TERMS), BM_TERMS)
    return scored.select("doc_id", F.round("raw", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(50)


@register("r2_bm25_scan", f"WITH {BM25} SELECT doc_id, round(raw, 6) AS score FROM bm ORDER BY round(raw, 6) DESC, doc_id LIMIT 50")
def r2_scan(spark, d):
    """The same without an index."""
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", _bm_tokens(), BM_TERMS).select("doc_id", F.round("raw", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(50)


@register("r6_max_sim", f"WITH {VEC}, q AS (SELECT v AS qv FROM e WHERE vec_id = 0) SELECT label, round(max({_cos('v', 'qv')}), 6) AS best FROM e, q WHERE vec_id <> 0 GROUP BY 1")
def r6(spark, d):
    q = F.array(*(F.lit(float(x)) for x in query_vector(spark, d)))
    return table(spark, d, "embeddings").where("vec_id <> 0").groupBy("label").agg(F.round(F.max(vectors.cosine(F.col("embedding"), q)), 6).alias("best"))


@register("r8_rrf_fusion", f"""WITH {BM25}, {VEC}, q AS (SELECT v AS qv FROM e WHERE vec_id = 0), l AS (SELECT doc_id, row_number() OVER (ORDER BY round(raw, 6) DESC, doc_id) - 1 AS r FROM bm QUALIFY r < 100),
v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round({_cos('v', 'qv')}, 6) DESC, vec_id) - 1 AS r FROM e, q WHERE round({_cos('v', 'qv')}, 6) > 0 QUALIFY r < 100)
SELECT coalesce(l.doc_id, v.doc_id) AS doc_id, l.r AS lexical_rank, v.r AS vector_rank, round(coalesce(1.0 / (60 + l.r), 0) + coalesce(1.0 / (60 + v.r), 0), 9)::DOUBLE AS rrf FROM l FULL JOIN v ON l.doc_id = v.doc_id""")
def r8(spark, d):
    return _fused(spark, d).select("doc_id", "lexical_rank", "vector_rank", F.round("rrf", 9).alias("rrf"))


def _fused(spark, d):
    lex = _bm25(spark, d).withColumnRenamed("score", "s")
    q = F.array(*(F.lit(float(x)) for x in query_vector(spark, d)))
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(vectors.cosine(F.col("embedding"), q), 6).alias("s"))
    return retrieval.fuse({"lexical": retrieval.ranked(lex, "doc_id", "s", 100, "rank"), "vector": retrieval.ranked(vec, "doc_id", "s", 100, "rank")}, "doc_id", {})


_RRF = f"""l AS (SELECT doc_id, row_number() OVER (ORDER BY round(raw, 6) DESC, doc_id) - 1 AS r FROM bm QUALIFY r < 100),
v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round({_cos('v', 'qv')}, 6) DESC, vec_id) - 1 AS r FROM e, q WHERE round({_cos('v', 'qv')}, 6) > 0 QUALIFY r < 100),
f AS (SELECT coalesce(l.doc_id, v.doc_id) AS doc_id, coalesce(1.0 / (60 + l.r), 0) + coalesce(1.0 / (60 + v.r), 0) AS rrf FROM l FULL JOIN v ON l.doc_id = v.doc_id)"""


@register("r20_flagship_search", f"""WITH {BM25}, {VEC}, {OBS}, q AS (SELECT v AS qv FROM e WHERE vec_id = 0), {_RRF},
s AS (SELECT doc_id, project, lang, left(content, 2000) AS content, created_at, n_chars, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 3.6e9) AS h, rrf, coalesce(quality, 0) AS quality FROM f JOIN obs USING (doc_id) WHERE toxic = 0),
p AS (SELECT *, (rrf + 0.15 * exp(-h / 2160) + 0.1 * CASE WHEN lang = 'en' THEN 1 ELSE 0 END + 0.1 * quality) * CASE WHEN h < 24 THEN 1.0 WHEN h < 168 THEN 0.7 ELSE 0.4 END * CASE WHEN doc_id % 10 = 3 THEN 0.5 ELSE 1 END AS final FROM s)
SELECT doc_id, project, sha256(content) AS content_sha256, round(final, 6)::DOUBLE AS final FROM p ORDER BY round(final, 6) DESC, created_at DESC, doc_id LIMIT 20""")
def r20(spark, d):
    """Lexical and vector channels, fusion, recency, tag and importance terms, decay, penalty for superseded rows, top 20.

    Ids and scores come first; texts are joined to the at most 200 candidates.
    """
    tier = scores.decay_tier(NOW, "created_at")
    w = scores.weights("hybrid")
    candidates = _fused(spark, d).select("doc_id", "rrf")
    rows = views.observations(spark, d).where("toxic = 0").join(F.broadcast(candidates), "doc_id")  # 200 rows at most
    final = (F.col("rrf") + w["recency"] / sum(w.values()) * scores.recency(NOW, "created_at") + w["tag"] * (F.col("lang") == "en").cast("double") + w["importance"] * F.coalesce("quality", F.lit(0))) * scores.decay_factor(tier)
    scored = retrieval.superseded_penalty(rows.withColumn("final", final), F.col("doc_id") % 10 == 3, "final").withColumn("final", F.round("final", 6))
    return scored.orderBy(F.col("final").desc(), F.col("created_at").desc(), "doc_id").limit(20).select("doc_id", "project", F.sha2(F.substring("content", 1, 2000), 256).alias("content_sha256"), "final")


@register("r12_session_progress", """WITH s AS (SELECT *, CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS sid, value / 100 AS sig FROM events), b AS (SELECT sid, max(sig) AS best, max(ts) AS last_ts FROM s GROUP BY 1 ORDER BY best DESC, last_ts DESC, sid LIMIT 1)
SELECT event_id, round(0.08 + 0.28 * CASE WHEN count(*) OVER () = 1 THEN 1 ELSE percent_rank() OVER (ORDER BY ts, event_id) END, 6)::DOUBLE AS boost FROM s WHERE sid = (SELECT sid FROM b)""")
def r12(spark, d):
    """The best session gets .08, and .28 more in steps to its last row; its rows alone are ordered."""
    s = views.events(spark, d).select("event_id", "ts", "session_id", (F.col("value") / 100).alias("sig"))
    best = s.groupBy("session_id").agg(F.max("sig").alias("best"), F.max("ts").alias("last_ts")).orderBy(F.col("best").desc(), F.col("last_ts").desc(), "session_id").limit(1)
    rows = s.join(F.broadcast(best.select("session_id")), "session_id")  # one row
    w = W.partitionBy("session_id")
    step = F.when(F.count("*").over(w) == 1, 1.0).otherwise(F.percent_rank().over(w.orderBy("ts", "event_id")))
    return rows.select("event_id", F.round(0.08 + 0.28 * step, 6).alias("boost"))


@register("r15_simple_rerank", f"WITH {OBS} SELECT doc_id, round(0.7 * (n_chars / 40000) + CASE WHEN lower(project) = 'src3' THEN 0.2 ELSE 0 END + 0.08 * ((contains(lower(project), 'src3') OR contains(lower(content), 'src3'))::INT + (contains(lower(project), 'tion') OR contains(lower(content), 'tion'))::INT) / 2 + 0.02 * exp(-greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 3.6e9) / 336), 6)::DOUBLE AS score FROM obs")
def r15(spark, d):
    score = retrieval.simple_rerank(F.col("n_chars") / 40000, F.col("project"), F.col("content"), "src3", ["src3", "tion"], scores.recency(NOW, "created_at", 14))
    return views.observations(spark, d).select("doc_id", F.round(score, 6).alias("score"))


@register("r18_superseded_penalty", f"WITH {views.FACTS} SELECT fact_id, round((fact_id % 100 + 1) / 100.0 * CASE WHEN superseded_by IS NULL THEN 1 ELSE 0.5 END, 6)::DOUBLE AS score FROM facts ORDER BY score DESC, fact_id LIMIT 50")
def r18(spark, d):
    facts = views.facts(spark, d).select("fact_id", ((F.col("fact_id") % 100 + 1) / 100).alias("score"), "superseded_by")
    return retrieval.superseded_penalty(facts, F.col("superseded_by").isNotNull(), "score").select("fact_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "fact_id").limit(50)


@register("r22_recall_search", f"WITH {OBS} SELECT doc_id, (3 * contains(lower(project || ' ' || content), 'src1 the')::INT + 2 * contains(lower(project), 'src1')::INT + contains(lower(content), 'src1')::INT + 2 * contains(lower(project), 'the')::INT + contains(lower(content), 'the')::INT)::BIGINT AS score FROM obs ORDER BY score DESC, created_at DESC, doc_id LIMIT 40")
def r22(spark, d):
    score = retrieval.recall_score(F.col("project"), F.col("content"), "src1 the", ["src1", "the"])
    return views.observations(spark, d).select("doc_id", "created_at", score.alias("score")).orderBy(F.col("score").desc(), F.col("created_at").desc(), "doc_id").limit(40).select("doc_id", "score")


@register("g1_two_hop_decay", """WITH ed AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem), seeds AS (SELECT DISTINCT src AS node FROM ed ORDER BY 1 LIMIT 10),
h1 AS (SELECT dst AS part, max(1.0 * 0.8) AS score FROM ed JOIN seeds ON src = node GROUP BY 1), h2 AS (SELECT ed.src AS ord, max(h1.score * 0.8 * 0.5) AS score FROM ed JOIN h1 ON ed.dst = h1.part WHERE ed.src NOT IN (SELECT node FROM seeds) GROUP BY 1)
SELECT node, round(score, 6)::DOUBLE AS score, hop FROM (SELECT 'p' || part AS node, score, 1 AS hop FROM h1 UNION ALL SELECT 'o' || ord, score, 2 FROM h2) ORDER BY score DESC, node LIMIT 40""")
def g1(spark, d):
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    o, p = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    edges = pairs.select(F.inline(F.array(F.struct(o.alias("src"), p.alias("dst")), F.struct(p.alias("src"), o.alias("dst"))))).select("src", "dst", F.lit(0.8).alias("weight"), F.lit(1.0).alias("penalty"))
    seeds = pairs.select("l_orderkey").distinct().orderBy("l_orderkey").limit(10).select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("node"), F.lit(1.0).alias("score"))
    return graph.expand(edges, seeds, 2).select("node", F.round("score", 6).alias("score"), "hop")


@register("g3_proximity", """WITH ed AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem), h1 AS (SELECT DISTINCT src AS ord FROM ed WHERE dst = 7), h2 AS (SELECT DISTINCT dst AS part FROM ed JOIN h1 ON src = ord WHERE dst <> 7)
SELECT 'p7' AS node, 0 AS hop, 1.0::DOUBLE AS proximity UNION ALL SELECT 'o' || ord, 1, 0.5 FROM h1 UNION ALL SELECT 'p' || part, 2, round(1 / 3, 6) FROM h2""")
def g3(spark, d):
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    o, p = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    edges = pairs.select(F.inline(F.array(F.struct(o.alias("src"), p.alias("dst")), F.struct(p.alias("src"), o.alias("dst")))))
    return graph.hops_from(edges, spark.range(1).select(F.lit("p7").alias("node")), 2).select("node", "hop", F.round(graph.proximity(F.col("hop")), 6).alias("proximity"))


_KIND = "CASE o_orderstatus WHEN 'F' THEN 'updates' WHEN 'O' THEN 'contradicts' ELSE 'other' END"


@register("g4_temporal_signal", """SELECT o_custkey AS node, round(least(1, greatest(-0.5, sum(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN -0.5 ELSE 0.1 END * least(1, greatest(0, o_totalprice / 500000))
  * CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderdate + INTERVAL 400 DAY <= TIMESTAMP '2000-01-01' THEN 0.5 ELSE 1 END))), 5)::DOUBLE AS signal FROM orders GROUP BY 1""")
def g4(spark, d):
    """Relations that ended 400 days on; every eleventh was invalidated."""
    kind = F.when(F.col("o_orderstatus") == "F", "updates").when(F.col("o_orderstatus") == "O", "contradicts").otherwise("other")
    ends = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 400 DAY")
    rel = table(spark, d, "orders").select(F.col("o_custkey").alias("node"), kind.alias("kind"), (F.col("o_totalprice") / 500000).alias("strength"), ends.alias("valid_to"), F.when(F.col("o_orderkey") % 11 == 0, ends).alias("invalidated_at"))
    return graph.temporal_signal(rel, "node", "kind", "strength", graph.relation_freshness("2000-01-01 00:00:00", "valid_to", "invalidated_at")).select("node", F.round("signal", 5).alias("signal"))


@register("g7_neighbours", "SELECT p_brand AS entity, count(DISTINCT l_orderkey) AS n_observations, min(l_orderkey) AS first_observation FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY 1")
def g7(spark, d):
    parts = table(spark, d, "part").where("p_size < 10").select("p_partkey", "p_brand")
    return table(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("entity")).agg(F.count_distinct("l_orderkey").alias("n_observations"), F.min("l_orderkey").alias("first_observation"))


_WORK = """it AS (SELECT o_orderkey AS work_id, CASE o_orderstatus WHEN 'P' THEN 'planned' WHEN 'O' THEN 'planned' ELSE 'closed' END AS status, o_orderpriority, o_orderdate, o_custkey FROM orders),
dep AS (SELECT work_id AS from_id, lead(work_id) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, work_id) AS to_id,
  CASE left(o_orderpriority, 1) WHEN '2' THEN 'checkpoint' WHEN '3' THEN 'supersedes' WHEN '4' THEN 'duplicates' ELSE 'blocks' END AS relation FROM it),
codes AS (SELECT work_id, 'status' AS code FROM it WHERE status <> 'planned' UNION SELECT to_id, 'blocked_by' FROM dep JOIN it ON from_id = work_id WHERE status <> 'closed' AND to_id IS NOT NULL AND relation = 'blocks'
  UNION SELECT to_id, 'checkpoint_waiting' FROM dep JOIN it ON from_id = work_id WHERE status <> 'closed' AND to_id IS NOT NULL AND relation = 'checkpoint'
  UNION SELECT to_id, CASE relation WHEN 'supersedes' THEN 'superseded' ELSE 'duplicate' END FROM dep WHERE to_id IS NOT NULL AND relation IN ('supersedes', 'duplicates')
  UNION SELECT work_id, 'leased' FROM it WHERE work_id % 17 = 0)"""


def _work(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), F.when(F.col("o_orderstatus").isin("P", "O"), "planned").otherwise("closed").alias("status"), "o_orderpriority", "o_orderdate", "o_custkey")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "work_id")
    kind = F.substring("o_orderpriority", 1, 1)
    relation = F.when(kind == "2", "checkpoint").when(kind == "3", "supersedes").when(kind == "4", "duplicates").otherwise("blocks")
    deps = items.select(F.col("work_id").alias("from_id"), F.lead("work_id").over(w).alias("to_id"), relation.alias("relation")).where("to_id IS NOT NULL")
    return items, deps


@register("g13_ready", f"""WITH {_WORK}
SELECT it.work_id, status, coalesce(string_agg(code, ',' ORDER BY code), '') AS reasons, count(code) = 0 AS ready FROM it LEFT JOIN codes USING (work_id) GROUP BY 1, 2""")
def g13(spark, d):
    items, deps = _work(spark, d)
    return graph.readiness(items.select("work_id", "status"), deps, items.where("work_id % 17 = 0"))


_AGE = "greatest(0, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(o_orderdate)) / 3.6e9)"


@register("g14_next_work", f"""WITH {_WORK}, u AS (SELECT from_id AS work_id, count(*) AS n FROM dep JOIN it ON to_id = work_id WHERE status <> 'closed' AND relation = 'blocks' GROUP BY 1)
SELECT work_id, (8 * least(5, greatest(0, 5 - left(o_orderpriority, 1)::INT)))::BIGINT AS priority_score, (8 * least(5, greatest(0, 5 - left(o_orderpriority, 1)::INT)) + 10 * least(5, coalesce(n, 0)) + CASE WHEN {_AGE} <= 1 THEN 15 WHEN {_AGE} <= 24 THEN 10 WHEN {_AGE} <= 168 THEN 5 ELSE 0 END + CASE WHEN o_custkey % 7 = 0 THEN 20 ELSE 8 END)::BIGINT AS score FROM it LEFT JOIN u USING (work_id) WHERE work_id NOT IN (SELECT work_id FROM codes WHERE work_id IS NOT NULL) ORDER BY score DESC, priority_score DESC, work_id LIMIT 100""")
def g14(spark, d):
    items, deps = _work(spark, d)
    session = F.when(F.col("o_custkey") % 7 == 0, "now").otherwise("other")
    return graph.next_work(items, deps, items.where("work_id % 17 = 0").select("work_id"), F.substring("o_orderpriority", 1, 1).cast("int"), scores.hours_before("2001-08-02 00:00:00", "o_orderdate"), session, "now", 100)
