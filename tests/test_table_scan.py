"""Searches for tables of queries by passes over the rows, against brute force and against the stored indexes."""

import math
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import query_table, table_scan, vector_index
from corvane.plans import catalogue
from corvane.session import scratch_folder


def _lists(found, score):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append((r.id, round(r[score], 6)))
    return got


def test_lexical_scan_equals_full_evaluation(spark, tmp_path, monkeypatch):
    rnd = random.Random(12)
    word = lambda: f"w{int(rnd.paretovariate(0.7)) % 60}"
    docs = [(i, [word() for _ in range(rnd.randrange(0, 40))], [word() for _ in range(rnd.randrange(0, 3))]) for i in range(300)]
    docs += [(300 + i, ["w1", "w2", "w5"], ["w2"]) for i in range(40)] + [(900, [], []), (901, None, None)]  # equal rows tie
    rnd.shuffle(docs)
    queries = [(q, list({word() for _ in range(rnd.randrange(1, 9))} | {"w1"})) for q in range(50)] + [(50, ["none"]), (51, []), (52, None)]
    monkeypatch.setattr(table_scan, "QUERY_ROWS", 20)  # several passes, blocks and kinds of terms
    monkeypatch.setattr(table_scan, "BLOCK_WORDS", 100)
    monkeypatch.setattr(table_scan, "BLOCK_SCORES", 300)
    monkeypatch.setattr(table_scan, "COMMON", 3)
    frame = spark.createDataFrame(docs, "doc long, c array<string>, t array<string>").repartition(5)
    asked = spark.createDataFrame(queries, "qid long, terms array<string>")
    got = _lists(table_scan.lexical(frame, asked, 7, row_id="doc", content=F.col("c"), title=F.col("t")), "score")

    sizes = [len(c) + len(t) for _, c, t in docs if c is not None]
    n, avg = len(docs), sum(sizes) / len(sizes)
    df = {}
    for _, c, t in docs:
        for term in {*(c or []), *(t or [])}:
            df[term] = df.get(term, 0) + 1
    want = {}
    for q, terms in queries:
        scores = []
        for i, c, t in docs:
            s, c, t = 0.0, c or [], t or []
            for term in set(terms or []) & {*c, *t}:
                tf = c.count(term) + 3.0 * t.count(term)
                s += math.log((n - df[term] + 0.5) / (df[term] + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(c) + len(t)) / avg))
            if s:
                scores.append((i, round(s, 6)))
        if scores:
            want[q] = sorted(scores, key=lambda x: (-x[1], x[0]))[:7]
    assert got == want

    whole = frame.where("c IS NOT NULL")
    query_table.build(whole, str(tmp_path / "i"), row_id="doc", content=F.col("c"), title=F.col("t"))
    assert _lists(table_scan.lexical(whole, asked, 7, row_id="doc", content=F.col("c"), title=F.col("t")), "score") == _lists(query_table.search(spark, str(tmp_path / "i"), asked, 7), "score")


def test_vector_scan_equals_the_exact_index(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).round(2)
    x[200:260] = x[7]  # equal rows tie
    x[13] = 0
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(700, None), (701, [])]
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(5)
    asked = spark.createDataFrame([(q, rows[q * 7][1]) for q in range(40)] + [(90, None), (91, [0.0] * 8)], "qid long, vector array<float>")
    monkeypatch.setattr(table_scan, "QUERY_ROWS", 15)
    monkeypatch.setattr(table_scan, "BLOCK_SCORES", 200)
    vector_index.build(df, str(tmp_path / "i"), cells=9)
    got = _lists(table_scan.vectors(df, asked, 10, row_id="id", vector="vector"), "cosine")
    assert got == _lists(vector_index.search(spark, str(tmp_path / "i"), asked, 10, exact=True), "cosine")
    assert all(len(v) == 10 for v in got.values()) and len(got) == 41 and [i for i, _ in got[1]] == [7, *range(200, 209)]


def test_those_rows(spark):
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("x"))
    ids = spark.createDataFrame([(3,), (5,), (3,), (500,)], "id long")
    assert sorted(r.x for r in table_scan.those(rows, ids).collect()) == [6, 10]


def test_anchor_search_stores_less_than_it_reads(spark):
    d = "/root/testdata/sf0.01"
    folder = Path(scratch_folder(spark).removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet") if p.is_file())
    before = size()
    assert catalogue.QUERIES["r14_anchor_search"](spark, d).count() > 0
    assert size() - before < Path(f"{d}/documents.parquet").stat().st_size
