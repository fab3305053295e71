import json

from pyspark.sql import functions as F

from corvane.sources import connector, files
from corvane.streaming import ingest


def event(i, **more):
    return {"event_id": f"e{i}", "platform": "cli", "project": "p", "session_id": "s", "event_type": "note", "ts": f"2024-01-01T00:00:{i:02d}Z", "content": f"text {i}", "tags": ["A "], **more}


def test_ingest_deduplicates_across_runs(spark, tmp_path):
    src, out, state = (tmp_path / x for x in ("in", "out", "state"))
    src.mkdir()
    rows = [event(1), event(2, tags=["block"]), event(3, tags=["mask"], content="mail a@b.org"), event(1, event_id="again"), event(4, content="x<private>y</private>")]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json")
    ingest.run_ingest(spark, str(src), str(out), str(state))
    (src / "b.json").write_text("\n".join(map(json.dumps, [event(1, event_id="late"), event(5, content="we decided to adopt it")])))
    ingest.run_ingest(spark, str(src), str(out), str(state))
    got = {r.content: r for r in spark.read.parquet(str(out)).collect()}
    assert sorted(got) == ["mail [REDACTED_EMAIL]", "text 1", "we decided to adopt it", "x"]
    assert got["we decided to adopt it"].observation_type == "decision" and got["text 1"].tags == ["a"]
    assert spark.read.parquet(str(out)).count() == 4


def test_markdown_code_and_tables(spark):
    md = "intro\n# One\nbody 1\n## Two\n\n| 1 | a \\| b | done |\n|---|---|---|\n| 2 | c | todo |\n"
    df = spark.createDataFrame([("f.md", md)], "path string, content string")
    assert [(r.level, r.title) for r in files.markdown_chunks(df).orderBy("position").collect()] == [(0, ""), (1, "One"), (2, "Two")]
    assert {(r.work_id, r.title, r.status) for r in files.plan_items(df).collect()} == {("1", "a | b", "closed"), ("2", "c", "planned")}
    code = spark.createDataFrame([("x.py", "import os\n\ndef f():\n    pass\n\nclass G:\n    x = 1\n")], "path string, content string")
    assert [r.name for r in files.code_chunks(code, "python").orderBy("position").collect()] == ["", "f", "G"]
    adr = spark.createDataFrame([("d.md", "# Use Spark\nStatus: accepted\nDate: 2024-01-01\nwhy")], "path string, content string")
    assert files.decisions(adr).select("title", "status", "date").collect()[0] == ("Use Spark", "accepted", "2024-01-01")


def test_transcripts_and_issues(spark):
    lines = [{"type": "user", "sessionId": "s", "message": {"role": "user", "content": "hi"}}, {"type": "assistant", "message": {"content": '[{"type": "text", "text": "yes"}]'}}, {"type": "assistant", "message": {"content": "yes"}}, {"type": "summary", "summary": "sum"}, {"type": "user", "isMeta": True, "message": {"content": "no"}}, {"type": "tool_result"}]
    df = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(lines)] + [("f", 9, "{broken")], "path string, position int, value string")
    assert [(r.kind, r.content) for r in files.session_transcript(df).orderBy("position").collect()] == [("user", "hi"), ("assistant", "yes"), ("summary", "sum")]
    hooks = spark.createDataFrame([('{"session_id": "s", "prompt": "p"}',), ('{"command": "ls"}',), ("x",)], "value string")
    assert {(r.event_type, r.content) for r in files.hook_events(hooks).collect()} == {("user_prompt", "p"), ("tool_use", "ls")}
    issues = spark.createDataFrame([(json.dumps([{"number": 1, "title": "t", "state": "open", "created_at": "2024-01-01T00:00:00Z", "labels": [{"name": "bug"}]}]),)], "value string")
    assert [(r.number, r.body, r.labels) for r in files.github_issues(issues).collect()] == [(1, "", ["bug"])]
    assert [files.url_allowed(u) for u in ("https://a.org/x", "http://10.0.0.1/", "ftp://a.org", "http://u@localhost:80/", "http://172.20.1.1", "http://172.32.1.1", None)] == [True, False, False, False, False, True, False]


class Notes(connector.Connector):
    name = "notes_test"

    def pages(self):
        return ["1", "2"]

    def rows(self, page):
        yield (page, "t" + page, "c", None)

    def since(self, offset):
        rows = [(str(i), "t", "c", None) for i in range(3)][offset:]
        return rows, 3


def test_connectors_read_like_tables(spark):
    connector.register(spark, Notes)
    assert sorted(r.id for r in spark.read.format("notes_test").load().collect()) == ["1", "2"]
    assert spark.read.format("notes_test").load().where(F.col("id") == "2").count() == 1
