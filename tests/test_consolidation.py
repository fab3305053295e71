import collections
import re

from pyspark.sql import functions as F

from corvane.functions import cues, text
from corvane.operators import consolidation, graph, maintenance, ordered, retrieval


def plain_nuggets(x):
    if len(x.strip()) < 20:
        return []
    out, buffer, size = [], [], 0

    def flush():
        nonlocal buffer, size
        whole = " ".join(buffer).strip()
        if buffer and len(whole) >= 20:
            out.append(whole)
        buffer, size = [], 0

    for p in re.split(r"\n{2,}", x):
        for s in re.split(r"(?<=[。！？])\s*|(?<=[.!?])\s+(?=[A-Z\u3040-\u30ff\u3400-\u9fff])", p.strip()):
            s = s.strip()
            if not s:
                continue
            if len(s) > 500:
                flush()
                out += [c for c in (s[i : i + 500].strip() for i in range(0, len(s), 500)) if len(c) >= 20]
                continue
            if size + len(s) + 1 > 500 and buffer:
                flush()
            buffer.append(s)
            size += len(s) + 1
            if len(buffer) >= 3:
                flush()
    flush()
    return list(dict.fromkeys(out))


def test_nuggets_against_brute_force(spark):
    texts = ["", "short.", "One sentence here. Two sentences here. Three of them now. Four is the last one.", "a" * 1203, "決定した。次に進む。これは長い文章であることを示す。", "Same group of words here.\n\nB. C.\n\nSame group of words here.", ("This is a sentence of some length that repeats. " * 40), "x" * 480 + ". Next one here.", "no end at all but it is long enough", "  \n\n  Dr. who? Yes! no. ok then\n\n\nEnd of it all is here."]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, x string").select("id", consolidation.nuggets(F.col("x")).alias("n")).collect()
    assert {r.id: r.n for r in got} == {i: plain_nuggets(x) for i, x in enumerate(texts)}


def test_facts_from_texts(spark):
    rows = [(1, "We decided to choose Spark for this. I prefer tabs over spaces! ok. The pattern is always so here", "context"), (2, "nothing to see in here at all", "context"), (3, "nothing to see in here at all", "decision"), (4, "short", "lesson"), (5, "We learned a lot today here. We learned a lot, today here.", "lesson")]
    got = consolidation.extracted_facts(spark.createDataFrame(rows, "id int, x string, k string"), "id", "x", "k").orderBy("id", "place").collect()
    assert [(r.id, r.fact_type, r.confidence) for r in got] == [(1, "decision", 0.7), (1, "preference", 0.7), (1, "pattern", 0.7), (3, "decision", 0.9), (4, "lesson", 0.6), (5, "lesson", 0.9)]
    assert got[1].fact_key == "preference:prefer_tabs_over_spaces"


def test_entities_are_typed_once_and_cut_to_fifty(spark):
    x = "see src/a.ts and (lib/b.py) then npm install left-pad, function doIt and https://x.org/a). https://x.org/a " + " ".join(f"f{i}.go" for i in range(60))
    [(got,)] = spark.createDataFrame([(x,)], "x string").select(text.entities(F.col("x"))).collect()
    assert [tuple(e) for e in got[:3]] == [("file", "src/a.ts"), ("file", "lib/b.py"), ("file", "f0.go")] and len(got) == 50
    [(got,)] = spark.createDataFrame([(x.split(" f0")[0],)], "x string").select(text.entities(F.col("x"))).collect()
    assert [tuple(e) for e in got[2:]] == [("package", "left-pad,"[:-1]), ("symbol", "doIt"), ("url", "https://x.org/a")]


def test_sectors(spark):
    cases = {"We met the team": "people", "Deploy the API": "work", "so I sleep": "health", "a guitar": "hobby", "バグを直す": "work", "nothing": "meta", "taskforce": "meta", "main.py changed": "work"}
    got = spark.createDataFrame([(x,) for x in cases], "x string").select("x", text.sector(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in got} == cases


def test_links_by_words_and_titles(spark):
    rows = [(1, 1, "Fix the login page bug", "start"), (2, 1, "Fix the login page bug now", "more"), (3, 1, "Fix login elsewhere today", "x"), (4, 1, "unrelated", "However it broke"), (5, 1, "t", "it is part of this"), (6, 1, "u", "because of it"), (7, 2, "u", "first of its own")]
    got = consolidation.auto_link(spark.createDataFrame(rows, "id int, s int, t string, c string"), "id", "s", "id", "t", "c").collect()
    assert {(r.from_id, r.to_id): r.relation for r in got} == {(2, 1): "updates", (3, 2): "extends", (4, 3): "contradicts", (5, 4): "part_of", (6, 5): "causes"}


def test_newest_fifty_are_met_once(spark):
    rows = [(i, i % 2, i // 2, ["a", f"b{i}"]) for i in range(300)]
    got = consolidation.auto_supersede(spark.createDataFrame(rows, "id int, p int, k int, t array<string>"), "id", ["p"], "k", "t").collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and b[2] < a[2] <= b[2] + 50}
    assert len(got) == len(want) and {(r.from_id, r.to_id) for r in got} == want


def test_plans_meet_the_first_evidence(spark):
    rows = [(1, 1, "We will deploy search"), (2, 1, "implemented deploy of search"), (3, 1, "deploy done"), (4, 2, "deploy done"), (5, 1, "should write docs"), (0, 1, "docs finished")]
    df = spark.createDataFrame(rows, "id int, s int, x string")
    got = consolidation.completed_plans(df, "id", "s", "id", text.tokens(F.col("x")), F.col("x").rlike(consolidation.PLANNED), F.col("x").rlike(consolidation.COMPLETED)).collect()
    assert [(r.planned_id, r.evidence_id) for r in got] == [(1, 2)]


def test_state_scores(spark):
    cases = {"it is currently on": ("current", 5), "we previously had it": ("previous", 5), "no longer there": ("no_longer", 4), "right after it": ("after", 5), "the first one": ("first", 5), "newest of all": ("latest", 5)}
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    for x, (mode, score) in cases.items():
        assert df.where(F.col("x") == x).select(cues.state_score(mode, F.col("x"), F.lit(False), F.lit(False))).first()[0] == score


def test_rerank_without_signal_keeps_the_order(spark):
    df = spark.createDataFrame([(i, float(-i), i) for i in range(30)], "id int, f double, t int")
    got = retrieval.temporal_rerank(df, "id", "f", F.lit(0), "t", 5, True).orderBy("place").collect()
    assert [r.id for r in got] == [0, 1, 2, 3, 4]
    got = retrieval.temporal_rerank(df, "id", "f", F.when(F.col("id") == 20, 3).otherwise(0), "t", 3, False).orderBy("place").collect()
    assert [r.id for r in got] == [20, 0, 1]


def test_readiness_by_relation_and_next_work(spark):
    items = spark.createDataFrame([(i, s) for i, s in enumerate(["planned"] * 6 + ["closed"])], "work_id int, status string")
    deps = spark.createDataFrame([(0, 1, "blocks"), (6, 2, "blocks"), (0, 3, "checkpoint"), (6, 4, "supersedes"), (6, 5, "duplicates"), (99, 2, "blocks")], "from_id int, to_id int, relation string")
    none = items.where("work_id < 0").select("work_id")
    got = {r.work_id: r.reasons for r in graph.readiness(items, deps, none).collect()}
    assert got == {0: "", 1: "blocked_by", 2: "blocked_by", 3: "checkpoint_waiting", 4: "superseded", 5: "duplicate", 6: "status"}
    next_ = graph.next_work(items, deps, none, F.lit(None).cast("int"), F.lit(0.5), F.lit("now"), "now").collect()
    assert [(r.work_id, r.score) for r in next_] == [(0, 24 + 10 + 15 + 20)]


def test_fact_merges_go_to_the_earliest_of_equals(spark):
    rows = [(9, "p", "t", 1, ["a", "b"]), (3, "p", "t", 2, ["c", "d"]), (5, "p", "t", 3, ["a", "b", "c", "d"]), (6, "q", "t", 4, ["a", "b"]), (7, "p", "t", 5, ["z"])]
    got = ordered.merge_facts(spark.createDataFrame(rows, "fact_id long, project string, fact_type string, created_at long, tokens array<string>"), 0.3).collect()
    assert {r.fact_id: r.merged_into for r in got} == {9: None, 3: None, 5: 9, 6: None, 7: None}


def test_budget_is_packed_in_order(spark):
    rows = [(1, 0, 50, 12), (1, 1, 80, 12), (1, 2, 30, 12), (1, 3, 60, 12), (2, 0, 500, 12)]
    got = ordered.pack_budget(spark.createDataFrame(rows, "k long, o long, f long, c long"), "k", "o", "f", "c", 100).collect()
    assert {(r.k, r.o): (r.form, r.left_tokens) for r in got} == {(1, 0): ("full", 50), (1, 1): ("compact", 38), (1, 2): ("full", 8), (1, 3): ("skip", 8), (2, 0): ("compact", 88)}


def test_backup_and_archive_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id long, text string").withColumn("state", F.lit("live"))
    assert maintenance.backup({"t": (df, "id")}, str(tmp_path))
    rows, archive = maintenance.archived(df, F.col("id") % 2 == 0, "text")
    assert rows.where("text IS NULL").count() == archive.count() == 10
    back = maintenance.restored(rows, archive, archive.select("id"), "id", "text")
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter(map(tuple, df.collect()))
    assert maintenance.purged(df, "id", archive.select("id")).count() == 10
    assert graph.relation_freshness("2024-01-01 00:00:00", "a", "b") is not None


def test_running_totals_and_percentiles(spark):
    import math
    import random

    from corvane.operators import evaluation, tables

    rnd = random.Random(3)
    rows = [(rnd.choice("aab"), rnd.randrange(50), i) for i in range(500)] + [("c", None, 500), ("d", 7, 501)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = {(r.g, r.id): r.upto for r in tables.running_total(df.where("v IS NOT NULL").withColumn("one", F.lit(1)), ["g", "v", "id"], "one", "upto").collect()}
    assert got == {(g, i): k + 1 for k, (g, v, i) in enumerate(sorted(r for r in rows if r[1] is not None))}
    out = {r.g: (r.p50, r.p95) for r in evaluation.percentiles(df, "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g in "abd":
        values = sorted(v for h, v, _ in rows if h == g)
        assert out[g] == tuple(values[max(math.ceil(q * len(values)), 1) - 1] for q in (0.5, 0.95))


def test_headings_in_fences_open_nothing(spark):
    from corvane.sources import files

    x = "intro\n# One\nbody\n```sh\n# not a heading\n## nor this\n```\nafter\n## Two\n~~~\n# x\n"
    got = files.markdown_chunks(spark.createDataFrame([("f", x)], "path string, content string")).orderBy("position").collect()
    assert [(r.level, r.title) for r in got] == [(0, ""), (1, "One"), (2, "Two")] and "# not a heading\n## nor this" in got[1].body and "\x01" not in got[1].body + got[2].body
    allowed = {"http://[::1]/": False, "https://2130706433/": False, "http://u@localhost/": False, "https://example.com/a@b": True, "ftp://example.com/": False, "https://10.0.0.1": False, "http://a:b@example.com:8080": True}
    assert {u: files.url_allowed(u) for u in allowed} == allowed
    got = spark.createDataFrame([(u,) for u in allowed], "u string").select("u", text.url_allowed(F.col("u")).alias("a")).collect()
    assert {r.u: r.a for r in got} == allowed


def test_provenance_of_payloads(spark):
    import json

    from corvane.functions import provenance

    cases = [
        ({"tool_name": "Write", "file_path": " a.tsx ", "model_id": "m"}, ("a.tsx", "create", "m", "typescript")), ({"tool_name": "Edit"}, None), ({"tool_name": "Bash", "command": "rm -f x/y.log"}, ("x/y.log", "delete", None, None)),
        ({"tool_name": "Bash", "cmd": "echo a > out.md"}, ("out.md", "create", None, "markdown")), ({"tool_name": "Bash", "command": "head q.py"}, ("q.py", "read", None, "python")), ({"tool_name": "Bash", "command": "sed -i s/a/b/ m.rs"}, ("m.rs", "edit", None, "rust")),
        ({"tool_name": "Bash", "command": "ls"}, None), ({"path": "b.go", "new_string": "x"}, ("b.go", "edit", None, "go")), ({"filename": "b"}, ("b", "read", None, None)), ({"k": 1}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(cases)], "i int, p string")
    got = {r.i: r.c and tuple(r.c) for r in df.select("i", provenance.code_provenance(F.col("p")).alias("c")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
