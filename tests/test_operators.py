import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import predicates as P
from corvane.functions import scores, text, vectors
from corvane.operators import evaluation, graph, maintenance, ordered, retrieval, similarity, tables, temporal
from corvane.plans import catalogue


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_x")).select(column.alias("r")).head()[0]


def test_privacy_fails_closed(spark):
    raw = [None, "[]", '["a"]', '["PRIVATE"]', "broken", '["x", "deleted"]', '{"a": 1}', "[1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, tags string")
    assert [r.i for r in df.where(P.visible("tags")).orderBy("i").collect()] == [0, 1, 2]
    assert [r.i for r in df.where(P.untagged("tags")).orderBy("i").collect()] == [0, 1]


def test_validity_is_half_open(spark):
    t = dt.datetime(2024, 1, 2)
    rows = [(1, None, None), (2, t, None), (3, None, t), (4, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3)), (5, dt.datetime(2024, 1, 3), None)]
    df = spark.createDataFrame(rows, "i int, valid_from timestamp, valid_to timestamp")
    assert [r.i for r in df.where(P.valid_at(t)).orderBy("i").collect()] == [1, 2, 4]


def test_limits_cursors_and_types(spark):
    assert [P.clamp_limit(x, 20, 1, 100) for x in (None, 0, 7, 1000, True)] == [20, 1, 7, 100, 20]
    assert P.decode_cursor(P.encode_cursor("2024-01-01", 5)) == ("2024-01-01", 5)
    df = spark.createDataFrame([("a",), (" b ",), ("c",)], "k string")
    assert df.where(P.all_of(P.of_types("k", ["a", " ", "c "]), None)).count() == 2
    assert P.in_projects("k", []) is None and P.role_access("admin", 1) is None


def test_scores(spark):
    now, day = "2024-01-31 00:00:00", dt.datetime(2024, 1, 30)
    assert abs(one(spark, scores.recency(now, "t"), t=day) - np.exp(-1 / 90)) < 1e-12
    assert one(spark, scores.recency(now, "t"), t=dt.datetime(2025, 1, 1)) == 1.0  # the future is now
    assert one(spark, scores.decay_tier(now, "t"), t=None) == "cold"
    assert [one(spark, scores.hit_boost(F.col("n")), n=n) for n in (4, 5, 10)] == [0.0, 0.1, 0.2]
    assert [one(spark, scores.retry_wait(F.col("n")), n=n) for n in (0, 3, 8, 50)] == [1.0, 8.0, 256.0, 256.0]
    same = spark.createDataFrame([(1, 3.0), (2, 3.0)], "i int, v double")
    assert {r.s for r in same.select(scores.min_max("v").alias("s")).collect()} == {1.0}
    w = scores.weights("vector", vector_coverage=0.1)
    assert w["vector"] == 0 and abs(sum(w.values()) - 1) < 1e-12


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0), F.lit(-2.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, b)) == 0.0
    assert abs(one(spark, vectors.cosine(a, F.array(F.lit(2.0), F.lit(5.0)))) - 2 / np.sqrt(29)) < 1e-12  # over the shorter length
    assert one(spark, vectors.resized(a, 5)) == [1.0, 0.0, -2.0, 0.0, 0.0]
    assert one(spark, vectors.sign_bits(a)) == [4]
    assert one(spark, vectors.token_hash(F.lit("react"))) == 1493001052


def test_text(spark):
    assert one(spark, text.tokens(F.lit("A bc, DE-f 日本!"))) == ["bc", "de", "日本"]
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert sorted(one(spark, text.with_bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))) == ["a", "a b", "b", "b c", "c"]
    assert one(spark, text.redacted(F.lit("mail a.b@x.org token=abc, sk_0123456789abcdef0 " + "ab" * 20))) == "mail [REDACTED_EMAIL] [REDACTED_SECRET], [REDACTED_KEY] [REDACTED_HEX]"
    assert one(spark, text.without_private_blocks(F.lit("a<private>x\ny</private>b<PRIVATE>z"))) == "ab"
    assert one(spark, text.normal_tags(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("b")))) == ["a", "b"]
    assert one(spark, text.token_estimate(F.lit(None).cast("string"))) == 1
    assert one(spark, text.html_text(F.lit("<p>a&amp;lt; b</p><script>x</script><br>c <b>d</b>"))) == "a&lt; b\n\nc d"
    assert one(spark, text.observation_type(F.lit("x"), F.lit("session_end"))) == "summary"


def test_table_operators(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c")], "k int, t int, v string")
    assert sorted(map(tuple, tables.latest_by(df, ["k"], "t").collect())) == [(1, 3, "b"), (2, 2, "c")]
    assert tables.append_new(df.where("k = 1"), df, "k", "t").select("v").collect()[0][0] == "c"
    pages = tables.page(df, 2, "t", "k").orderBy("position").collect()
    assert [r.v for r in pages] == ["b", "c"] and all(r.has_more for r in pages)
    local, remote = spark.createDataFrame([(1, 5, "l"), (2, 5, "l")], "id int, u int, v string"), spark.createDataFrame([(1, 5, "r"), (2, 6, "r"), (3, 1, "r")], "id int, u int, v string")
    assert {(r.id, r.v) for r in tables.merge_lww(local, remote, "id", "u", ["v"]).collect()} == {(1, "l"), (2, "r"), (3, "r")}
    counts = tables.full_outer_counts({"x": df.where("k = 1"), "y": df.where("k = 2")}, "k").orderBy("k").collect()
    assert [tuple(r) for r in counts] == [(1, 2, 0), (2, 0, 1)]


def test_asof_join_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 6, "c")], "k int, t2 int, v string")
    got = {(r.k, r.t): r.asof_v for r in temporal.asof_join(left, right, ["k"], "t", "t2", ["v"]).collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}


def test_similarity_join_loses_no_pair(spark):
    import random

    rnd = random.Random(2)
    sets = [[str(rnd.randrange(12)) for _ in range(rnd.randrange(0, 9))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, t array<string>")
    for low in (0.3, 0.6, 1.0):
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if sets[i] and sets[j] and len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= low - 1e-12}
        assert {(r.a_id, r.b_id) for r in similarity.token_self_join(df, "id", "t", low).collect()} == want


def test_graph_hops_and_readiness(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {r.node: r.hop for r in graph.hops_from(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    items = spark.createDataFrame([(1, "closed"), (2, "planned"), (3, "planned"), (4, "planned"), (5, "planned")], "work_id int, status string")
    deps = spark.createDataFrame([(1, 2, "blocks"), (2, 3, "blocks"), (3, 4, "relates")], "from_id int, to_id int, relation string")
    ready = {r.work_id: (r.ready, r.reasons) for r in graph.readiness(items, deps, spark.createDataFrame([(5,)], "work_id int")).collect()}
    assert ready == {1: (False, "status"), 2: (True, ""), 3: (False, "blocked_by"), 4: (True, ""), 5: (False, "leased")}


def test_budget_skips_and_goes_on(spark):
    items = spark.createDataFrame([("k", 1, 50, 10), ("k", 2, 60, 20), ("k", 3, 25, 5), ("k", 4, 100, 40)], "k string, o int, f int, c int")
    got = [(r.o, r.form, r.left_tokens) for r in ordered.pack_budget(items, "k", "o", "f", "c", 100).orderBy("o").collect()]
    assert got == [(1, "full", 50), (2, "compact", 30), (3, "full", 5), (4, "skip", 5)]


def test_facts_merge_in_time_order(spark):
    rows = [(1, "p", "t", 1, ["a", "b", "c"]), (2, "p", "t", 2, ["a", "b", "d"]), (3, "p", "t", 3, ["b", "d", "e"]), (4, "p", "u", 4, ["a", "b", "c"]), (5, "p", "t", 5, ["x"])]
    got = {r.fact_id: r.merged_into for r in ordered.merge_facts(spark.createDataFrame(rows, "fact_id bigint, project string, fact_type string, created_at int, tokens array<string>"), 0.3).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: None}  # 3 is like 2, but 2 is merged already


def test_passages_in_documents(spark):
    long = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, long[:-1]), (3, f"pre{long}post"), (4, "tiny bit"), (5, None)], "doc_id int, text string")
    items = spark.createDataFrame([(10, long), (11, "tiny"), (12, ""), (13, None)], "item_id int, text string")
    assert {tuple(r) for r in maintenance.contained_passages(docs, items).collect()} == {(1, 10), (3, 10), (4, 11)}


def test_evaluation(spark):
    assert one(spark, evaluation.token_f1(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c")))) == 2 * 1 / 5
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r.name for r in evaluation.holm(tests, "name", "p").where("rejected").collect()} == {"a"}
    low, high = evaluation.bootstrap_mean(np.array([0.0, 1.0] * 50), 500)
    assert low < 0.5 < high and (low, high) == evaluation.bootstrap_mean(np.array([0.0, 1.0] * 50), 500)
    single = spark.createDataFrame([("q", 1, 5)], "q string, r int, e int")
    assert evaluation.rank_agreement(single, "q", "r", "e").head().order_score == 0.5


def test_no_memory_and_fusion(spark):
    assert retrieval.no_memory(0.05, {"lexical": 0.1}) and not retrieval.no_memory(0.05, {"vector": 0.2}) and not retrieval.no_memory(0.2, {})
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, rank int")
    got = {r.id: r.rrf for r in retrieval.fuse({"x": a, "y": a.where("id = 2").withColumn("rank", F.lit(0))}, "id", {"y": 0.5}).collect()}
    assert abs(got[1] - 1 / 60) < 1e-12 and abs(got[2] - (1 / 61 + 0.5 / 60)) < 1e-12


def test_rank_queries_search_all_embeddings(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[350:360] = v[50] + np.float32(1e-3) * rng.normal(size=(10, 8)).astype(np.float32)  # the nearest of 50 are beyond id 300
    labels = [i % 10 for i in range(350)] + [0] * 50
    spark.createDataFrame([(i, v[i].tolist(), labels[i]) for i in range(400)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.query: r for r in catalogue.QUERIES["e1_recall_mrr_ndcg"](spark, str(tmp_path)).collect()}
    x = v.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 400, 50))
    for q in got:
        near = sorted((i for i in range(400) if i != q), key=lambda i: (-round(float(x[i] @ x[q]), 6), i))[:10]
        relevant = {i for i in range(400) if i != q and labels[i] == labels[q]}
        assert got[q].recall == pytest.approx(len(relevant & set(near)) / len(relevant), abs=1e-6)
    assert got[50].recall == pytest.approx(10 / (sum(x == 0 for x in labels) - 1), abs=1e-6)


def test_shared_entity_counts_all_parts(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = sorted({(int(o), int(p)) for o, p in zip(rng.integers(0, 30, 400), rng.integers(1, 45, 400))})
    spark.createDataFrame(rows + rows[:5], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = {o: {p for x, p in rows if x == o} for o, _ in rows}
    pairs = [(a, b, len(parts[a] & parts[b])) for a in parts for b in parts if a < b and parts[a] & parts[b]]
    want = sorted(pairs, key=lambda x: (-x[2], x[0], x[1]))[:100]
    assert [tuple(r) for r in catalogue.QUERIES["j7_shared_entity"](spark, str(tmp_path)).collect()] == want


def test_whole_queries_pass_over_no_rows(spark, tmp_path):
    docs = [(i, lang, f"{i} mail me at joe{i}@example.com " + "long " * 30 + f"end {i}") for i, lang in enumerate(["en", "de", "fr", None])]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(o, p) for o in range(12) for p in (7, 150 + o, 450 + o)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, f"k{u}", at) for u in range(1)] + [(u, f"k{u}", at) for u in range(1, 5)], "user_id long, event_type string, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in run("f25_redaction") if r.had_email} == {0, 1, 2, 3}
    assert {r.h for r in run("f26_private_blocks")} == {hashlib.sha256(f"a{x}".encode()).hexdigest() for *_, x in docs}
    assert {r.kind for r in run("a18_hooks_health")} == {f"k{u}" for u in range(5)}
    assert {r.node for r in run("g3_proximity") if r.hop == 2} == {f"p{p + o}" for p in (150, 450) for o in range(12)}
    assert {r.node for r in run("g1_two_hop_decay") if r.hop == 1} == {"p7"} | {f"p{p + o}" for p in (150, 450) for o in range(10)}


def test_all_short_passages_are_looked_for(spark):
    items = [(i, f"x{i} y{i} z{i}") for i in range(10_030)] + [(20_000 + i, f"q{i};") for i in range(10_030)] + [(40_000, "ne tw"), (40_001, "a\tb c d e f g"), (40_002, "absent one two three")]
    docs = spark.createDataFrame([(1, " ".join(x for _, x in items[:10_030])), (2, " ".join(x for _, x in items[10_030:20_060])), (3, "one two"), (4, "aa\tb c d e f gg"), (5, ""), (6, None)], "doc_id long, text string")
    got = {tuple(r) for r in maintenance.contained_passages(docs, spark.createDataFrame(items, "item_id long, text string").repartition(8)).collect()}
    assert got == {(1, i) for i in range(10_030)} | {(2, 20_000 + i) for i in range(10_030)} | {(3, 40_000), (4, 40_001)}
