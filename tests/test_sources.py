import json
import sqlite3
from datetime import datetime

import pytest
from meterlake.operators import turns
from meterlake.sources import claude, codex, sqlite, text, updates
from pyspark.sql import functions as F


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")


def said(uuid, at, kind="user", content="hello", **more):
    return {"type": kind, "uuid": uuid, "timestamp": f"2026-01-01T{at}Z", "sessionId": "s", "cwd": "/home/me/work/app", "message": {"id": f"m-{uuid}", "model": "claude-x", "content": content, **more.pop("message", {})}, **more}


@pytest.fixture
def transcript(spark, tmp_path):
    def make(rows, name="projects/-home-me-app/a.jsonl"):
        write(tmp_path / name, rows)
        return claude.rows(text.parse(text.read_lines(spark, [str(tmp_path)])), "/home/me")

    return make


def test_usage_tools_and_advisor(transcript):
    usage = {"input_tokens": 20, "output_tokens": 10, "cache_creation_input_tokens": 3, "cache_read_input_tokens": 30, "cache_creation": {"ephemeral_1h_input_tokens": 1}}
    step = {"type": "advisor_message", "model": "adv", "input_tokens": 60, "output_tokens": 2}
    tool = [{"type": "tool_use", "id": "t1", "name": "Agent", "input": {"subagent_type": "Explore"}}, {"type": "thinking"}]
    decoded = transcript([
        said("a", "10:00:00"), said("b", "10:00:05", "assistant", tool, message={"usage": usage | {"iterations": [{"type": "x"}, step], "speed": "fast"}}, effort="high"), "not json", "",
        said("c", "10:00:06", "assistant", [], message={"usage": {"input_tokens": 0, "output_tokens": "7"}}), said("d", "10:00:07", "assistant", [], message={"usage": {"input_tokens": 1.5, "output_tokens": -1}}),
    ]).cache()
    got = {r.dedupe_key: r for r in claude.usage_events(decoded).collect()}
    assert set(got) == {"message:m-b", "message:m-b:iter:1"}
    assert got["message:m-b"].volume == 63 and got["message:m-b"].w1h == 1 and got["message:m-b"].project == "work/app"
    assert got["message:m-b:iter:1"].volume == 62 and got["message:m-b:iter:1"].model == "adv"
    tools = claude.tool_events(decoded).collect()
    assert [(t.tool_name, t.subagent_type, t.dedupe_key) for t in tools] == [("Agent", "Explore", "tool:t1")]
    modes = {r.dedupe_key: (r.has_thinking, r.fast) for r in claude.mode_events(decoded).collect()}
    assert modes["mode:m-b"] == (True, True) and modes["mode:m-c"] == (False, False)
    assert [r.effort for r in claude.effort_events(decoded).collect()] == ["high"]
    assert claude.touches(decoded).count() == 4


def test_scan_counts_bad_lines(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"a": 1}, "{bad", "", "[" * 300_000 + "]" * 300_000])
    s = text.scan_stats(text.parse(text.read_lines(spark, [str(tmp_path)]))).first()
    assert (s.files, s.parse_errors) == (1, 2)


def ask(uuid, at, qid):
    return said(uuid, at, "assistant", [{"type": "tool_use", "id": qid, "name": "AskUserQuestion"}])


def reply(uuid, at, qid):
    return said(uuid, at, "user", [{"type": "tool_result", "tool_use_id": qid}])


def test_question_counts_as_waiting(transcript):
    found = turns.turns(claude.turn_rows(transcript([said("p", "10:00:00"), ask("q", "10:01:00", "t"), reply("r", "10:11:00", "t"), said("a", "10:12:00", "assistant", [])])))
    (r,) = turns.durations(found).collect()
    assert (r.duration_ms, r.wait_ms, r.duration_ms - r.wait_ms, r.dedupe_key, r.status) == (720_000, 600_000, 120_000, "claude-turn:p", "turn")


def test_interrupt_discards_and_silence_cuts(transcript):
    found = turns.turns(claude.turn_rows(transcript([
        said("p", "10:00:00"), said("a", "10:00:30", "assistant", []), said("i", "10:00:40", content="[Request interrupted by user]"),
        said("p2", "10:02:00"), said("b", "10:03:00", "assistant", []), said("p3", "10:05:00"), said("c", "10:06:00", "assistant", []), said("d", "10:50:00", "assistant", []),
        said("p3", "10:51:00"), said("g", "11:40:00", content="<task-notification> x"), said("e", "11:41:00", "assistant", []),
    ])))
    got = {r.dedupe_key: (r.duration_ms, r.model_ms, r.status) for r in turns.durations(found).collect()}
    assert got == {"claude-turn:p2": (60_000, 60_000, "turn"), "claude-turn:p3": (60_000, 60_000, "turn"), "claude-turn:g": (60_000, 60_000, "generated")}
    assert [(r.gap_ms, r.dedupe_key) for r in turns.paces(found).collect()] == [(120_000, "claude-pace:p3")]


def lengths(decoded):
    found = turns.turns(claude.turn_rows(decoded)).cache()
    return {r.dedupe_key: (r.duration_ms, r.wait_ms, r.model_ms) for r in turns.durations(found).collect()}, {r.dedupe_key: r.gap_ms for r in turns.paces(found).collect()}


def test_overlapping_questions_wait_once(transcript):
    got, _ = lengths(transcript([
        said("p", "10:00:00"), ask("q1", "10:01:00", "t1"), ask("q2", "10:02:00", "t2"), reply("r2", "10:06:00", "t2"), said("x", "10:07:00", "assistant", []),
        reply("r1", "10:10:00", "t1"), said("a", "10:12:00", "assistant", []), ask("again", "10:13:00", "t1"), said("b", "10:14:00", "assistant", []),
    ]))
    # waiting 10:01-10:10; model time 10:00-10:01, 10:10-10:14
    assert got == {"claude-turn:p": (840_000, 540_000, 300_000)}


def test_open_question_before_a_silence_and_its_late_answer(transcript):
    got, paces = lengths(transcript([
        said("p", "10:00:00"), ask("q", "10:01:00", "t"), said("n", "10:03:00", "system"), said("o", "11:00:00", "assistant", []), reply("r", "11:10:00", "t"), said("a", "11:12:00", "assistant", []),
        said("h", "11:15:00"), said("b", "11:16:00", "assistant", []), said("late", "12:30:00", "assistant", []), said("h2", "12:31:00"),
    ]))
    assert got == {"claude-turn:p": (180_000, 120_000, 60_000), "claude-turn:r": (120_000, 0, 120_000), "claude-turn:h": (60_000, 0, 60_000)}
    assert paces == {"claude-pace:h": 180_000}


def test_turns_nobody_answers_and_undated_interrupts(transcript):
    undated = said("i", "10:00:30", content="[Request interrupted by user]")
    del undated["timestamp"]
    got, paces = lengths(transcript([
        said("c", "10:00:00", content="<command-name>/compact</command-name>"), said("z", "10:00:20", "system"), said("l", "10:01:00"), said("y", "10:01:30", "system"),
        said("p", "10:02:00"), said("a", "10:03:00", "assistant", []), undated, said("b", "10:04:00", "assistant", []), said("q", "10:05:00"),
    ]))
    assert got == {"claude-turn:c": (20_000, 0, 0)} and paces == {"claude-pace:l": 40_000, "claude-pace:p": 30_000}


def test_turns_need_no_python(transcript):
    plan = turns.turns(claude.turn_rows(transcript([said("p", "10:00:00")])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_generated_prompts_are_no_human_turns(transcript):
    decoded = transcript([said("a", "10:00:00", permissionMode="plan"), said("b", "10:00:01", content="<bash-stdout>x", permissionMode="plan"), said("c", "10:00:02", origin={"kind": "task"}, permissionMode="plan"), said("i", "10:00:03", content=[{"type": "text", "text": " [Request interrupted by user] "}])])
    assert [r.dedupe_key for r in claude.permission_events(decoded).collect()] == ["claude-permission:a"]
    assert [r.dedupe_key for r in claude.interrupt_events(decoded).collect()] == ["claude-interrupt:i"]


def test_codex_usage_echo_and_fork(spark, tmp_path):
    count = lambda t, n, total: {"timestamp": f"2026-01-01T{t}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "cached_input_tokens": 40, "output_tokens": 10, "total_tokens": n + 10}, "total_token_usage": {"total_tokens": total}}, "rate_limits": {"primary": {"used_percent": 120.5}}}}
    record = lambda t, n, r: {"timestamp": f"2026-01-01T{t}Z", "type": "token_usage_record", "payload": {"thread_id": "th", "response_id": r, "usage": {"input_tokens": n, "cached_input_tokens": 40, "output_tokens": 10, "total_tokens": n + 10}}}
    write(tmp_path / "sessions/r.jsonl", [
        {"timestamp": "2026-01-01T10:00:00Z", "type": "session_meta", "payload": {"id": "th", "cwd": "/home/me/x"}},
        {"timestamp": "2026-01-01T10:00:01Z", "type": "turn_context", "payload": {"model": "gpt-x", "effort": "low", "approval_policy": "never"}},
        count("10:00:02", 100, 110), record("10:00:03", 200, "r1"), count("10:00:04", 200, 320),
        {"timestamp": "2026-01-01T10:00:05Z", "type": "event_msg", "payload": {"type": "task_complete", "duration_ms": 12345}},
        {"timestamp": "2026-01-01T10:00:06Z", "type": "response_item", "payload": {"name": "shell", "call_id": "c1"}},
        {"timestamp": "2026-01-01T11:00:00Z", "type": "session_meta", "payload": {"id": "parent"}}, count("11:00:00.400", 500, 900), count("11:00:02", 60, 990),
    ])
    decoded = codex.rows(text.parse(text.read_lines(spark, [str(tmp_path)])), "/home/me").cache()
    got = {(r.input, r.cache_read, r.output, r.volume, r.model, r.project, r.session_id) for r in codex.usage_events(decoded).collect()}
    # the second meta moves the session and the project
    assert got == {(20, 40, 10, 70, "gpt-x", None, "parent"), (60, 40, 10, 110, "gpt-x", "x", "th"), (160, 40, 10, 210, "gpt-x", "x", "th")}
    assert [r.duration_ms for r in codex.durations(decoded).collect()] == [12345]
    assert {r.used_percent for r in codex.rate_limits(decoded).collect()} == {100.0}
    assert [r.tool_name for r in codex.tool_events(decoded).collect()] == ["shell"]


def test_codex_forks_and_origin(spark, tmp_path):
    at = lambda t, kind, payload: {"timestamp": f"2026-01-01T{t}Z", "type": kind, "payload": payload}
    use = lambda t, owner, r: at(t, "token_usage_record", {"thread_id": owner, "response_id": r, "usage": {"input_tokens": 9, "output_tokens": 1, "total_tokens": 10}})
    write(tmp_path / "a.jsonl", [at("10:00:00", "session_meta", {"id": "c", "forked_from_id": "p", "source": {"subagent": {"thread_spawn": {"agent_role": "scout"}}}}), use("10:00:00.200", "p", "copy"), use("10:00:00.300", "c", "own"), use("10:00:01.500", "c", "later")])
    write(tmp_path / "b.jsonl", [at("10:00:00", "session_meta", {"id": "h", "forked_from_id": "p", "history_base": {"x": 1}}), use("10:00:00.200", "h", "kept")])
    write(tmp_path / "c.jsonl", [use("10:00:00.200", "q", "alone")])
    got = {r.dedupe_key.split(":")[-1]: (r.session_id, r.model, r.source_kind, r.agent) for r in codex.usage_events(codex.rows(text.parse(text.read_lines(spark, [str(tmp_path)])), "/home/me")).collect()}
    assert got == {"own": ("c", "codex", "subagent", "scout"), "later": ("c", "codex", "subagent", "scout"), "kept": ("h", "codex", "main", None), "alone": ("c", "codex", "main", None)}


def test_grok_and_copilot(spark, tmp_path):
    done = {"timestamp": 1767261600, "params": {"update": {"sessionUpdate": "turn_completed", "prompt_id": "p", "usage": {"apiDurationMs": 500, "modelUsage": {"g1": {"inputTokens": 100, "cachedReadTokens": 30, "cacheCreationTokens": 20, "outputTokens": 5}}}}}}
    write(tmp_path / "g/cwd/sess/updates.jsonl", [done, {"timestamp": 1.5}])
    rows = updates.grok_rows(text.parse(text.read_lines(spark, [str(tmp_path / "g")]))).cache()
    (r,) = updates.grok_usage(rows).collect()
    assert (r.input, r.cache_read, r.cache_creation, r.volume, r.dedupe_key, r.session_id) == (50, 30, 20, 105, "grok:p:g1", "sess")
    assert updates.grok_durations(rows).first().duration_ms == 500
    ev = lambda i, t, kind, data: {"id": i, "timestamp": f"2026-01-01T10:0{t}:00Z", "type": kind, "data": data}
    shut = lambda n: {"modelMetrics": {"m": {"usage": {"inputTokens": n, "outputTokens": n, "cacheReadTokens": 0}}}}
    write(tmp_path / "c/session-state/s1/events.jsonl", [
        ev("1", 0, "assistant.turn_start", {"turnId": "t"}), ev("2", 1, "assistant.turn_end", {"turnId": "t"}), ev("3", 2, "assistant.turn_end", {"turnId": "t"}), ev("4", 3, "session.shutdown", shut(100)),
        ev("5", 4, "session.shutdown", shut(150)), ev("x", 4, "session.shutdown", {"modelMetrics": {"m": {"usage": {"cacheReadTokens": 3}}}}), ev("6", 5, "session.shutdown", shut(40)), ev("7", 5, "session.usage_checkpoint", {"totalNanoAiu": 7}), ev("8", 6, "session.usage_checkpoint", {"totalNanoAiu": 9}),
    ])
    rows = updates.copilot_rows(text.parse(text.read_lines(spark, [str(tmp_path / "c")]))).cache()
    assert sorted(r.volume for r in updates.copilot_usage(rows).collect()) == [80, 100, 200]
    assert [r.duration_ms for r in updates.copilot_turns(rows).collect()] == [60_000]
    write(tmp_path / "d/session-state/s2/events.jsonl", [ev(None, 1, "session.shutdown", shut(10)), ev(None, 2, "session.shutdown", shut(30))])
    other = updates.copilot_rows(text.parse(text.read_lines(spark, [str(tmp_path / "d")])))
    assert sorted(r.dedupe_key for r in updates.copilot_usage(other).collect()) == ["copilot:s2:m:0", "copilot:s2:m:1"]
    assert sorted(r.nano_aiu for r in updates.copilot_credits(rows).collect()) == [2, 7]


def test_sqlite_stores(spark, tmp_path):
    path = str(tmp_path / "a.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE message(id TEXT, session_id TEXT, time_created INT, data TEXT)")
    db.execute("CREATE VIEW sneaky AS SELECT * FROM message")
    body = {"role": "assistant", "modelID": "m", "tokens": {"input": 5, "output": 6, "reasoning": 2, "cache": {"read": 3, "write": 1}}, "time": {"created": 1000, "completed": 4000}}
    db.executemany("INSERT INTO message VALUES (?,?,?,?)", [("x", "s", 1000, json.dumps(body)), ("y", "s", 10, "{bad"), ("z", "s", 5, json.dumps(body))])
    db.execute("CREATE TABLE sessions(id TEXT, cwd TEXT)")
    db.execute("CREATE TABLE assistant_usage_events(id TEXT, session_id TEXT, model TEXT, input_tokens INT, output_tokens INT, cache_read_tokens INT, created_at TEXT)")
    db.execute("INSERT INTO sessions VALUES ('s', '/w')")
    db.execute("INSERT INTO assistant_usage_events VALUES ('c', 's', 'm', 100, 5, 30, '2026-01-01 10:00:00')")
    db.commit()
    db.close()
    got = {r.id: r for r in sqlite.messages(spark, [path, str(tmp_path / "none.db")]).collect()}
    assert set(got) == {"x", "z"} and got["x"].output == 8 and got["x"].volume == 17 and got["x"].duration_ms == 3000
    assert [r.id for r in sqlite.messages(spark, [path], since_ms=500).collect()] == ["x"]
    assert sqlite.read_table(spark, [path], "sneaky", "id string").count() == 0
    call = sqlite.ledger_calls(spark, [path]).first()
    assert (call.input, call.cwd, call.at) == (70, "/w", datetime(2026, 1, 1, 10)) and call.dedupe_key == "copilot-call:c"


def test_plain_file_beats_compressed(spark):
    files = spark.createDataFrame([("a.jsonl.zst", 90), ("a.jsonl", 5), ("b.jsonl.zst", 7)], "path string, size long")
    assert {r.path for r in text.prefer_plain(files).collect()} == {"a.jsonl", "b.jsonl.zst"}
    assert files.where(F.col("size") > 0).count() == 3
