"""Order-dependent rules against plain loops, stored indexes against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import anchor_search, ordered, query_table, vector_index
from corvane.operators.stored_index import stored_for

# --- M4 and W10 ---------------------------------------------------------------------------------------------------


def merged(rows, threshold):
    out, kept = {}, {}
    for i, project, kind, at, tokens in sorted(rows, key=lambda r: (r[3], r[0])):
        have, best, into = set(tokens or ()), 0.0, None
        for j, other in kept.setdefault((project, kind), []):
            share = len(have & other) / len(have | other) if have | other else 0.0
            if share >= threshold and share > best:
                best, into = share, j
        if into is None:
            kept[project, kind].append((i, have))
        out[i] = into
    return out


@pytest.mark.parametrize("seed,last_edges", [(1, 0), (2, 0), (3, 100_000), (4, 30)])
def test_merges_equal_the_rule_in_order(spark, seed, last_edges):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, rnd.choice(["p", "q", None]), rnd.choice("ab"), rnd.randrange(20), rnd.sample(words, rnd.randrange(0, 7))) for i in range(150)]
    rows += [(200 + i, "p", "a", rnd.randrange(30), ["w1", "w2", "w3"]) for i in range(60)]  # one very common fact
    rows += [(400 + i, "chain", "a", i, [f"c{i}", f"c{i + 1}"]) for i in range(12)] + [(500, "p", "a", 3, None)]
    df = spark.createDataFrame(rows, "fact_id long, project string, fact_type string, created_at long, tokens array<string>").repartition(4)
    got = {r.fact_id: r.merged_into for r in ordered.merge_facts(df, 0.3, last_edges).collect()}
    assert got == merged(rows, 0.3)


def packed(rows, budget):
    out = []
    left = {}
    for k, o, f, c in sorted(rows, key=lambda r: (str(r[0]), *r[1:])):
        have = left.setdefault(k, budget)
        form = "full" if f <= have else "compact" if c <= have else "skip"
        left[k] -= f if form == "full" else c if form == "compact" else 0
        out.append((k, o, form, left[k]))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,fan", [(4096, 64), (3, 2), (1, 3)])
def test_packing_equals_the_fold(spark, chunk, fan):
    rnd = random.Random(chunk)
    rows = [(rnd.choice([0, 0, 0, 1, 2, None]), rnd.randrange(40), rnd.randrange(0, 60), rnd.randrange(0, 9)) for _ in range(150)]
    df = spark.createDataFrame(rows, "k long, o long, f long, c long").repartition(5)
    got = ordered.pack_budget(df, "k", "o", "f", "c", 200, chunk, fan)
    assert sorted(map(tuple, got.collect()), key=str) == packed(rows, 200)
    assert ordered.pack_budget(df.limit(0), "k", "o", "f", "c", 200).collect() == []


# --- stored indexes -----------------------------------------------------------------------------------------------


def _vectors(n, seed=4, dim=16):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    return [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.5 * rnd.normal(size=dim)]) for i in range(n)]


def _nearest(rows, queries, top, other=True):
    x = np.array([v for _, v in rows])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    ids, out = np.array([i for i, _ in rows]), {}
    for i, v in queries:
        q = np.array(v) / max(np.linalg.norm(v), 1e-300)
        score = np.round(x @ q, 9)
        out[i] = [int(ids[k]) for k in np.lexsort((ids, -score)) if not other or ids[k] != i][:top]
    return out


def test_vector_index_finds_what_the_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "FILE_ROWS", 40)  # cells over several files, queries over several groups
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 7)
    rows = _vectors(1200)
    rows += [(2000 + i, rows[3][1]) for i in range(300)] + [(3000, [0.0] * 16)]  # one very common vector, one zero vector
    df = spark.createDataFrame([*rows, (4000, None), (4001, [])], "id long, vector array<float>").repartition(4)
    folder = str(tmp_path / "index")
    vector_index.build(df, folder, cells=20)
    assert spark.read.parquet(f"{folder}/vectors").count() == len(rows)  # every row is indexed
    asked = [r for r in rows if r[0] % 50 == 0]
    queries = spark.createDataFrame(asked, "qid long, vector array<float>")
    want = _nearest(rows, asked, 10)
    lists = lambda df: {q: [r.id for r in sorted(g, key=lambda r: r.rank)] for q, g in _grouped(df.collect()).items()}
    assert lists(vector_index.search(spark, folder, queries, 10, 2, exact=True, other=True)) == want
    near = lists(vector_index.search(spark, folder, queries, 10, 6, other=True))
    recall = np.mean([len(set(near.get(q, [])) & set(w)) / len(w) for q, w in want.items()])
    assert recall >= 0.9


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.qid, []).append(r)
    return out


def test_vector_index_recall_on_the_given_vectors(spark, tmp_path):
    """Recall at 10 of the ids divisible by 50, with the number of probes that the index was tuned to."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    vector_index.build(df, str(tmp_path / "i"))
    rows = [(r.id, list(r.vector)) for r in df.collect()]
    asked = [r for r in rows if r[0] % 50 == 0]
    found = vector_index.search(spark, str(tmp_path / "i"), spark.createDataFrame(asked, "qid long, vector array<double>"), 10, other=True).collect()
    want = _nearest(rows, asked, 10)
    got = {q: {r.id for r in g} for q, g in _grouped(found).items()}
    assert np.mean([len(got.get(q, set()) & set(w)) / 10 for q, w in want.items()]) >= 0.9


def test_vector_search_reads_only_the_probed_folders(spark, tmp_path):
    rows = _vectors(600)
    folder = str(tmp_path / "index")
    vector_index.build(spark.createDataFrame(rows, "id long, vector array<float>"), folder, cells=12)
    cells = spark.read.parquet(f"{folder}/cells").count()
    read = spark.read.parquet(f"{folder}/vectors").where(F.col("cell").isin(1, 2))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and cells > 6
    assert len({f.split("cell=")[1].split("/")[0] for f in read.select("id", F.input_file_name().alias("f")).toPandas()["f"]}) == 2


def test_index_follows_its_source(spark, tmp_path):
    source, built = str(tmp_path / "rows"), []
    spark.range(10).write.parquet(source)
    load = lambda: spark.read.parquet(source)

    def build(folder):
        built.append(folder)
        load().write.parquet(folder)

    first = stored_for(load(), "test", build)
    assert stored_for(load(), "test", build) == first and len(built) == 1
    spark.range(5).write.mode("append").parquet(source)
    second = stored_for(load(), "test", build)
    assert second != first and spark.read.parquet(second).count() == 15

    def dies(folder):
        load().write.parquet(folder)
        raise RuntimeError

    spark.range(5).write.mode("append").parquet(source)
    with pytest.raises(RuntimeError):
        stored_for(load(), "test", dies)
    assert spark.read.parquet(stored_for(load(), "test", build)).count() == 20


def _bm25(docs, queries, top):
    lens = {i: len(c) + len(t) for i, c, t in docs}
    avg = sum(lens.values()) / len(lens)
    tf, df = {}, {}
    for i, c, t in docs:
        for w in set(c) | set(t):
            tf[w, i] = c.count(w) + 3 * t.count(w)
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, terms in queries:
        score = {}
        for w in set(terms) & set(df):
            for i, *_ in docs:
                if (w, i) in tf:
                    x = tf[w, i]
                    score[i] = score.get(i, 0) + np.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * lens[i] / avg))
        out[q] = sorted(score.items(), key=lambda s: (-round(s[1], 6), s[0]))[:top]
    return {q: [(i, round(float(s), 5)) for i, s in v] for q, v in out.items() if v}


@pytest.mark.parametrize("share", [0.2, 0.6, 1.0])
def test_query_table_equals_full_evaluation(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(query_table, "FILE_ROWS", 50)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    pick = lambda n: [words[min(39, int(rnd.expovariate(0.15)))] for _ in range(n)]
    docs = [(i, pick(rnd.randrange(0, 60)), pick(rnd.randrange(0, 4))) for i in range(200)] + [(300, [], [])] + [(301 + i, ["w0", "w1"], []) for i in range(40)]
    queries = [(q, pick(rnd.randrange(1, 9))) for q in range(25)] + [(90, ["unknown"]), (91, []), (92, ["w39"]), (93, words)]
    query_table.build(spark.createDataFrame(docs, "doc long, c array<string>, t array<string>"), str(tmp_path / "i"), row_id="doc", content=F.col("c"), title=F.col("t"))
    found = query_table.search(spark, str(tmp_path / "i"), spark.createDataFrame(queries, "qid long, terms array<string>"), 5, share=share)
    got = {q: [(r.id, round(r.score, 5)) for r in sorted(g, key=lambda r: r.rank)] for q, g in _grouped(found.collect()).items()}
    assert got == _bm25(docs, queries, 5)


def test_score_bounds_skip_postings(spark, tmp_path, monkeypatch):
    """A rare term decides: of the common term's 2,000 postings only those of rows that can still win are joined."""
    docs = [(i, ["common"] + (["rare"] if i < 12 else []) + ["x"] * (i % 5), []) for i in range(2000)]
    folder = str(tmp_path / "i")
    query_table.build(spark.createDataFrame(docs, "doc long, c array<string>, t array<string>"), folder, row_id="doc", content=F.col("c"))
    queries = spark.createDataFrame([(1, ["common", "rare"])], "qid long, terms array<string>")
    terms = query_table.split_terms(queries, spark.read.parquet(f"{folder}/terms"))
    assert {r.term: r.first for r in terms.collect()} == {"rare": True, "common": False}
    saved, plain = {}, query_table.cut
    monkeypatch.setattr(query_table, "cut", lambda df, name: saved.setdefault(name, plain(df, name)))
    found = query_table.search(spark, folder, queries, 10)
    assert {r.id for r in found.collect()} <= set(range(12)) and found.count() == 10
    assert saved["partial"].count() == 12  # rows of the first join: the rare term's postings, none of the common term's
    assert not saved["floors"].head()["whole"]


# --- anchors ------------------------------------------------------------------------------------------------------


def test_questions_name_their_anchor(spark):
    asked = ["What happened before the database migration?", "what changed after the Launch of v2", "who was on call around the outage", "which editor do I use?"]
    relation, reference = anchor_search.parsed(F.col("q"))
    got = [tuple(r) for r in spark.createDataFrame([(a,) for a in asked], "q string").select(relation, reference).collect()]
    assert got == [("before", "the database migration"), ("after", "the Launch of v2"), ("around", "the outage"), (None, None)]


def test_rows_beside_an_anchor(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice("pq"), start + dt.timedelta(hours=rnd.choice([rnd.randrange(24 * 300), rnd.randrange(20)]))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, project string, ts timestamp")
    anchors = [(q, ("after", "before", "around")[q % 3], rows[q * 7]) for q in range(40)]
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    frame = spark.createDataFrame([(q, rel, r[1], r[0], us(r[2])) for q, rel, r in anchors], "qid long, relation string, project string, anchor_id long, anchor_us long")
    got = {q: [(r.id, r.gap_us) for r in sorted(g, key=lambda r: r.place)] for q, g in _grouped(anchor_search.beside(frame, df, 2).collect()).items()}
    for q, rel, (i, project, at) in anchors:
        gaps = [(us(t) - us(at), j) for j, p, t in rows if p == project and j != i]
        right = [(g, j) for g, j in gaps if (g > 0 if rel == "after" else g < 0 if rel == "before" else abs(g) <= 7 * anchor_search.DAY)]
        assert got.get(q, []) == [(j, g) for g, j in sorted(right, key=lambda x: (abs(x[0]), x[1]))[:30]]
