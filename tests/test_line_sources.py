import random

from corvane.sources import files


def test_lines_of_split_files_have_exact_places(spark, tmp_path):
    """Many tasks a file, lines over block edges, \r\n, empty lines, two files, no last line end: places as in the bytes."""
    rnd, want = random.Random(3), set()
    for name in ("a.jsonl", "b.jsonl", "empty.jsonl", "one.jsonl"):
        lines = [("é" * rnd.randrange(0, 60) + str(i) * rnd.randrange(0, 3)) + rnd.choice(["", "", "\r"]) for i in range({"empty.jsonl": 0, "one.jsonl": 1}.get(name, 700))]
        lines = [*lines[:5], "x" * 5000, *lines[5:]] if len(lines) > 5 else lines
        data = "\n".join([*lines, "last"] if lines else []).encode()
        (tmp_path / name).write_bytes(data)
        at = 0
        for k, raw in enumerate(data.split(b"\n") if data else []):
            want.add((name, k, at, raw.decode().removesuffix("\r")))
            at += len(raw) + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = files.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(want) and {(r.path.rsplit("/", 1)[1], r.position, r.offset, r.value) for r in got} == want
    for r in got[::97]:
        raw = (tmp_path / r.path.rsplit("/", 1)[1]).read_bytes()[r.offset :].split(b"\n")[0]
        assert raw.decode().removesuffix("\r") == r.value


def test_histories_planner_logs_and_agent_files(spark):
    rows = ['{"role": "user", "session_id": "s", "ts": "2024-01-01T00:00:00Z", "text": "q"}', '{"role": "tool", "thread_id": "t"}', "{}", "{broken", "[1]", "", None]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(rows)], "path string, position bigint, value string")
    got = files.prompt_history(df).orderBy("position").collect()
    assert [(r.event_type, r.session_id, r.content) for r in got] == [("user_prompt", "s", "q"), ("tool_use", "t", None), ("user_prompt", "history", None)]
    assert len({r.dedupe_hash for r in got}) == 3 and got[0].ts is not None and got[1].ts is None
    log = ["2024-01-02 03:04:05.678 [info] requesting planner with 12 chat messages", "2024-01-02 03:04:05 Requesting planner with 1 chat messages.", "Requesting planner with 3 chat messages", None]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(log)], "path string, position bigint, value string")
    got = files.planner_log(df).orderBy("position").collect()
    assert [r.messages for r in got] == [12, 1] and str(got[0].ts) == "2024-01-02 03:04:05.678000"
    tree = [("/r/docs/checkpoints/one.md", "\n## \n# Done it\nx "), ("C:\\r\\docs\\checkpoints\\two.v2.md", "text"), ("/r/logs/codex-responses/Debug-3.txt", "a"), ("/r/logs/codex-responses/x", "b"), ("/r/other.md", "c"), ("/r/docs/checkpoints/blank", " \n"), ("/r/docs/checkpoints/null", None)]
    got = {r.stem: (r.kind, r.title, r.tool, r.content) for r in files.agent_files(spark.createDataFrame(tree, "path string, content string")).collect()}
    assert got == {"one": ("checkpoint", "Done it", None, "## \n# Done it\nx"), "two.v2": ("checkpoint", "checkpoint: two.v2", None, "text"), "Debug-3": ("agent_response", "debug: Debug-3", "debug", "a"), "x": ("agent_response", "review: x", "review", "b")}
