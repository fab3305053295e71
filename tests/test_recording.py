"""Recording events as one write, leases with timers, incremental consolidation."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import consolidation_run
from corvane.streaming import commits, leases, record


def event(i, session="s", **more):
    return {"event_id": f"e{i}", "platform": "cli", "project": "p", "session_id": session, "event_type": "note", "ts": f"2024-01-01T00:{i:02d}:00Z", "content": f"We decided to use parser{i} for CoreModule in src/core.py because it is faster than the old one.", "tags": ["A "], **more}


TABLES = ("observations", "tags", "entities", "relations", "links", "nuggets", "heads", "recents", "audit")


def _all(spark, target):
    out = {}
    for name in TABLES:
        folders = [m["folders"][name] for m in commits.manifests(spark, target)]
        df = spark.read.parquet(*folders)
        out[name] = sorted(map(str, df.drop("seq").collect()))
    return out


def _put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_a_killed_and_repeated_batch_leaves_every_table_exact(spark, tmp_path, monkeypatch):
    first = [event(1), event(2), event(3, "t"), event(1, event_id="again"), event(4, tags=["block"])]
    second = [event(5), event(6, "t", content="However, the plan changed."), event(7, "u")]
    for run in ("plain", "broken"):
        _put(tmp_path / run, "a.json", first)
        record.run(spark, str(tmp_path / run), str(tmp_path / f"{run}-out"), str(tmp_path / f"{run}-state"))
        _put(tmp_path / run, "b.json", second)
        if run == "broken":
            plain, dies = commits.commit, {"n": 0}

            def commit(spark, target, number, tables):
                """Dies when three tables are written and the manifest is not."""
                dies["n"] += 1
                for name in list(tables)[:3]:
                    tables[name].write.parquet(f"{target}/{name}/commit={number}/dead")
                raise RuntimeError("killed")

            monkeypatch.setattr(commits, "commit", commit)
            with pytest.raises(Exception, match="killed"):
                record.run(spark, str(tmp_path / run), str(tmp_path / f"{run}-out"), str(tmp_path / f"{run}-state"))
            monkeypatch.setattr(commits, "commit", plain)
            assert dies["n"] == 1 and len(commits.manifests(spark, str(tmp_path / "broken-out"))) == 1
        record.run(spark, str(tmp_path / run), str(tmp_path / f"{run}-out"), str(tmp_path / f"{run}-state"))
    got = _all(spark, str(tmp_path / "broken-out"))
    assert got == _all(spark, str(tmp_path / "plain-out"))
    assert len(got["observations"]) == 6 and all(got[name] for name in TABLES)
    # sessions go on over commits: e5 follows e2, e6 contradicts e3
    links = {(r.from_id, r.to_id, r.relation) for r in commits.read(spark, str(tmp_path / "plain-out"), "links", "from_id string, to_id string, relation string, weight double").collect()}
    assert {("obs_e2", "obs_e1", "causes"), ("obs_e5", "obs_e2", "causes"), ("obs_e6", "obs_e3", "contradicts"), ("obs_e5", "obs_e1", "updates")} <= links
    # the same batch once more
    before = len(got["observations"])
    done = commits.manifests(spark, str(tmp_path / "plain-out"))
    batch = spark.read.parquet(*[m["folders"]["observations"] for m in done])
    assert not commits.commit(spark, str(tmp_path / "plain-out"), done[-1]["number"], {"observations": batch})
    assert len(_all(spark, str(tmp_path / "plain-out"))["observations"]) == before


def test_replay_begins_behind_any_place(spark, tmp_path):
    for k in range(2):
        _put(tmp_path / "in", f"{k}.json", [event(10 * k + i, f"s{i % 2}") for i in range(1, 5)])
        record.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    whole = record.replay(spark, str(tmp_path / "out")).collect()
    assert len(whole) == 8
    for k in (0, 3, 5, 7):
        rest = record.replay(spark, str(tmp_path / "out"), (whole[k]["commit"], whole[k].seq)).collect()
        assert [r.event_id for r in rest] == [r.event_id for r in whole[k + 1 :]]


def _answers(spark, tmp_path, batches, ttl=20_000):
    schema = "target string, agent string, action string, ts timestamp, ttl_ms bigint, token bigint"
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        lines = [json.dumps({"target": t, "agent": a, "action": x, "ts": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z", **more}) for t, a, x, s, more in ((*r, {}) if len(r) == 4 else r for r in rows)]
        (tmp_path / f"in/{k}.json").write_text("\n".join(lines))
        stream = leases.lease_requests(spark.readStream.schema(schema).json(str(tmp_path / "in")), ttl, "1 second")
        q = stream.writeStream.foreachBatch(lambda df, n, k=k: df.withColumn("step", F.lit(k)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_leases_are_granted_fenced_and_removed(spark, tmp_path):
    first = [("t", "a", "acquire", 0), ("t", "b", "acquire", 5), ("t", "b", "release", 6), ("t", "a", "release", 7), ("t", "b", "acquire", 8), ("u", "a", "renew", 1), ("v", "a", "acquire", 3), ("w", "", "acquire", 1), ("x", "a", "acquire", 1, {"ttl_ms": 10**9})]
    got = _answers(spark, tmp_path, [first, [("t", "c", "acquire", 120), ("t", "b", "renew", 121), ("t", "c", "release", 122, {"token": 1})], [("z", "a", "acquire", 400)], [("z", "b", "acquire", 401)]])
    answers = {(r.target, r.agent, r.action, r.step): (r.granted, r.error) for r in got}
    assert answers["t", "a", "acquire", 0] == (True, None) and answers["t", "b", "release", 0] == (False, "not_owner") and answers["u", "a", "renew", 0] == (False, "lease_not_found")
    assert answers["w", "", "acquire", 0] == (False, "invalid_agent_id") and answers["x", "a", "acquire", 0] == (False, "invalid_ttl")
    assert answers["t", "c", "acquire", 1] == (True, None) and answers["t", "b", "renew", 1] == (False, "not_owner") and answers["t", "c", "release", 1] == (False, "stale_token")
    tokens = [r.token for r in sorted(got, key=lambda r: (r.step, r.expires_ms or 0)) if r.target == "t" and r.action == "acquire" and r.granted]
    assert tokens == sorted(set(tokens)) and len(tokens) == 3
    ended = {(r.target, r.agent) for r in got if r.action == "expire"}
    assert {("v", "a"), ("t", "c")} <= ended  # timers removed what nobody asked for again


def test_work_is_claimed_closed_and_handed_off(spark, tmp_path):
    rows = [("w", "a", "claim", 0), ("w", "b", "claim", 1), ("w", "b", "close", 2), ("w", "b", "handoff", 3), ("w", "a", "close", 4), ("w", "b", "claim", 5), ("w", "a", "close", 6)]
    got = {(r.agent, r.action, r.granted): (r.error, r.held_by, r.status) for r in _answers(spark, tmp_path, [rows])}
    assert got["a", "claim", True] == (None, None, "in_progress") and got["b", "close", False][0] == "not_owner" and got["b", "handoff", True] == (None, None, "in_progress")
    assert got["a", "close", True] == (None, None, "closed") and got["a", "close", False][0] == "invalid_status"
    assert {x for k, x in got.items() if k[:2] == ("b", "claim")} <= {("already_leased", "a", "in_progress"), ("invalid_status", None, "closed")}
    rate = leases.success_rate(spark.createDataFrame([("claim", True), ("claim", False), ("close", True)], "action string, granted boolean")).head()[0]
    assert rate == 0.5 and leases.success_rate(spark.createDataFrame([], "action string, granted boolean")).head()[0] == 1.0


def test_incremental_consolidation_equals_one_from_scratch(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    said = lambda i: f"We choose {words[i % 6]} {words[(i * 5 + 1) % 6]} {words[i * i % 6]} {i % 7}{i % 3} m{i} n{i}. Next action is todo {words[i % 4]} number {i % 3}."
    rows = [(i, f"p{i % 3}", f"s{i % 5}", i, i, said(i), "context") for i in range(40)]
    schema = "id long, project string, session string, seq long, at long, text string, kind string"
    frame = lambda r: spark.createDataFrame(r, schema)
    step, once = str(tmp_path / "step"), str(tmp_path / "once")
    assert consolidation_run.run(frame(rows[:25]), step, 1)
    before = {(r.project, r.fact_type): r.commit for r in commits.read(spark, step, "groups", consolidation_run.GROUPS).collect()}
    later = [r for r in rows[25:] if r[1] != "p2"]  # nothing new in p2
    changed = [(*r[:5], "Nothing to keep here at all.", "context") if r[0] == 3 else r for r in rows[:25]]  # a text was rewritten; its session has new rows
    assert consolidation_run.run(frame(changed + later), step, 2) and consolidation_run.run(frame(changed + later), once, 1)
    assert not consolidation_run.run(frame(changed + later), step, 2) and not consolidation_run.run(frame(changed + later), step, 3)
    for now in (consolidation_run.facts_now, consolidation_run.merges_now, consolidation_run.derives_now):
        assert sorted(map(str, now(spark, step).collect())) == sorted(map(str, now(spark, once).collect()))
    assert consolidation_run.merges_now(spark, step).where("merged_into IS NOT NULL").count() > 0 and consolidation_run.derives_now(spark, step).count() > 0
    second = {r.project for r in commits.read(spark, step, "groups", consolidation_run.GROUPS, after=1).collect()}
    assert second == {"p0", "p1"} and {p for p, _ in before} == {"p0", "p1", "p2"}
