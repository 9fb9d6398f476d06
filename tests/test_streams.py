
import json
import random
import sqlite3

from datetime import date, datetime, timedelta

import pytest
import zstandard
from meterlake.plans import reports, streams
from meterlake.plans.adapter import Window
from meterlake.plans.agy_logs import encode
from pyspark.sql import functions as F

WINDOW = Window(date(2026, 1, 1), date(2026, 1, 10), date(2025, 12, 22))


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")


def claude_rows():
    def row(i, at, kind, content, **message):
        return {"type": kind, "uuid": f"u{i}", "timestamp": f"2026-01-02T{at}Z", "sessionId": "c1", "cwd": "/home/me/app", "permissionMode": "plan", "effort": "high", "message": {"id": f"m{i}", "model": "claude-opus-4-8", "content": content, **message}}

    usage = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 20, "server_tool_use": {"web_search_requests": 3, "none": 0}}
    tool = [{"type": "tool_use", "id": "t1", "name": "Agent", "input": {"subagent_type": "Explore"}}, {"type": "thinking"}]
    return [row(1, "10:00:00", "user", "go"), row(2, "10:00:40", "assistant", tool, usage=usage), row(2, "10:00:50", "assistant", tool, usage=usage | {"output_tokens": 9}), row(3, "10:02:00", "user", "more"), row(4, "10:03:00", "assistant", [], usage=usage | {"speed": "fast"}), row(5, "10:03:30", "user", "[Request interrupted by user]")]


def codex_rows():
    e = lambda s, **p: {"timestamp": f"2026-01-03T12:{s // 60:02d}:{s % 60:02d}Z", "type": "event_msg", "payload": p}
    usage = {"input_tokens": 100, "cached_input_tokens": 40, "output_tokens": 10, "total_tokens": 110}
    return [
        {"timestamp": "2026-01-03T12:00:00Z", "type": "session_meta", "payload": {"id": "x1", "cwd": "/home/me/lib"}}, {"timestamp": "2026-01-03T12:00:00Z", "type": "turn_context", "payload": {"effort": "low", "approval_policy": "never", "turn_id": "a"}}, e(1, type="task_started"),
        e(5, type="token_count", info={"last_token_usage": usage, "total_token_usage": usage}, rate_limits={"primary": {"used_percent": 42.5}}), {"timestamp": "2026-01-03T12:00:06Z", "type": "response_item", "payload": {"name": "shell", "call_id": "k", "arguments": '{"command":["bash","-lc","ls"]}'}},
        e(8, type="item_completed", started_at_ms=0, completed_at_ms=3000, item={"id": "i", "type": "X"}), e(9, type="task_complete", duration_ms=8000), e(60, type="user_message"), e(70, type="turn_aborted", reason="interrupted", turn_id="b"),
    ]


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    top = tmp_path_factory.mktemp("agents")
    write(top / "claude/projects/-home-me-app/c1.jsonl", claude_rows())
    write(top / "claude/projects/-claude-mem-observer-x/noise.jsonl", claude_rows())
    write(top / "codex/sessions/2026/x1.jsonl", codex_rows())
    packed = top / "codex/archived_sessions/x2.jsonl.zst"
    packed.parent.mkdir(parents=True)
    second = json.dumps(codex_rows()).replace("x1", "x2").replace('"k"', '"k2"').replace("2026-01-03", "2026-01-04")
    packed.write_bytes(zstandard.compress("\n".join(map(json.dumps, json.loads(second))).encode()))
    (top / "codex/sessions/2026/x1.jsonl.zst").write_bytes(zstandard.compress(json.dumps(codex_rows()[3]).replace("42.5", "99").encode()))
    turn = lambda s, p: {"timestamp": 1767614400 + s, "params": {"update": {"sessionUpdate": "turn_completed", "prompt_id": p, "usage": {"inputTokens": 50, "outputTokens": 5, "apiDurationMs": 2000}}}}
    write(top / "grok/sessions/w/g1/updates.jsonl", [turn(0, "p"), turn(9, "q")])
    write(top / "grok/sessions/a/g2/updates.jsonl", [turn(86400, "p"), turn(86401, "r")])
    (top / "grok/sessions/a/g2/summary.json").write_text(json.dumps({"session_kind": "fork", "parent_session_id": "g1"}))
    c = lambda at, kind, **d: {"id": f"{kind}{at}", "timestamp": f"2026-01-05T{at}Z", "type": kind, "data": d}
    shot = {"modelMetrics": {"gpt-5.5": {"usage": {"inputTokens": 30, "outputTokens": 3}}}}
    write(top / "copilot/session-state/p1/events.jsonl", [c("09:00:00", "assistant.turn_start", turnId="1"), c("09:00:07", "assistant.turn_end", turnId="1"), c("09:00:08", "session.usage_checkpoint", totalNanoAiu=2_500_000_000), c("09:00:09", "session.shutdown", **shot), c("09:00:10", "tool.execution_start", toolName="view", toolCallId="z")])
    db = sqlite3.connect(top / "copilot/session-store.db")
    db.execute("CREATE TABLE sessions(id TEXT, cwd TEXT)")
    db.execute("CREATE TABLE assistant_usage_events(id INT, session_id TEXT, model TEXT, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, reasoning_tokens INT, agent_id TEXT, initiator TEXT, created_at TEXT)")
    db.execute("INSERT INTO assistant_usage_events VALUES (1, 'p1', 'gpt-5.5', 40, 4, 0, 0, 0, NULL, 'user', '2026-01-05 09:00:05')")
    db.commit()
    (top / "opencode").mkdir()
    db = sqlite3.connect(top / "opencode/opencode.db")
    db.execute("CREATE TABLE message(id TEXT, session_id TEXT, time_created INT, data TEXT)")
    db.execute("INSERT INTO message VALUES ('m', 'o1', 1767700800000, ?)", (json.dumps({"role": "assistant", "modelID": "claude-opus-4-8", "tokens": {"input": 7, "output": 1}, "time": {"created": 1767700800000, "completed": 1767700803000}}),))
    db.commit()
    (top / "agy/antigravity/conversations").mkdir(parents=True)
    db = sqlite3.connect(top / "agy/antigravity/conversations/a1.db")
    db.execute("CREATE TABLE gen_metadata(idx INT, data BLOB)")
    db.execute("INSERT INTO gen_metadata VALUES (0, ?)", (encode([(1, [(4, [(2, 9), (3, 2), (9, 2)]), (9, [(4, [(1, 1767787200)])]), (21, "Gemini 3.5 Flash")])]),))
    db.commit()
    write(top / "agy/antigravity-cli/history.jsonl", [{"timestamp": 1767787201000, "conversationId": "h1"}])
    write(top / "agy/antigravity-cli/log/cli-20260107_1.log", ["I0107 13:00:00.5 1 Responding to tool confirmation convID=h2 command(git x)"])
    return {name: [str(top / name)] for name in ("claude", "codex", "grok", "copilot", "opencode", "agy")}


@pytest.fixture(scope="module")
def stream(spark, roots):
    made = streams.read(spark, roots, "/home/me", WINDOW)
    return made._replace(usage=made.usage.cache(), events=made.events.cache())


def test_every_report_runs_on_a_stream(spark, stream):
    for name in reports.OF_STREAMS:
        rows = getattr(reports, name)(spark, stream).collect()
        assert rows or name in ("session_report", "tier_pricing", "concurrency_levels", "skill_stats"), name
    assert [r.volume for r in reports.session_report(spark, stream, "x1").collect()] == [110]


def test_numbers_of_all_agents(spark, stream):
    volume = {r.provider: r.volume for r in stream.usage.groupBy("provider").agg(F.sum("volume").alias("volume")).collect()}
    # a replayed message, a forked prompt, a packed copy and a snapshot under a ledger count once
    assert volume == {"claude": 139 + 135, "codex": 220, "grok": 165, "copilot": 44, "opencode": 8, "agy": 11}
    tools = {r.tool_name: r.calls for r in reports.tool_stats(spark, stream).collect()}
    assert tools == {"ls": 2, "Agent": 1, "view": 1, "command:git": 1}
    turns = {r.provider: (r.turns, r.active_ms, r.model_ms) for r in reports.active_time(spark, stream).collect()}
    assert turns == {"claude": (1, 50_000, 50_000), "codex": (2, 16_000, 10_000), "grok": (3, 6000, None), "copilot": (1, 7000, None), "opencode": (1, 3000, None)}
    assert {r.provider: r.interrupts for r in reports.interrupts(spark, stream).collect()} == {"claude": 1, "codex": 2}
    assert [(r.kind, r.label, r.n) for r in reports.modes_summary(spark, stream).collect()] == [("mode", "turns", 2), ("mode", "thinking", 1), ("mode", "fast", 1), ("effort", "high", 2), ("effort", "low", 2), ("permission", "plan", 3), ("permission", "never", 2)]
    limits = {str(r.d): (r.used, r.state) for r in reports.limits_history(spark, stream).collect()}
    assert limits["2026-01-03"] == (42.5, "measured") and limits["2026-01-05"][1] == "no_use" and len(limits) == 10
    credits = {str(r.d): r.credits for r in reports.credits_history(spark, stream).collect() if r.is_peak}
    assert credits == {"2026-01-05": 2.5}
    gaps = reports.pace_stats(spark, stream).first()
    assert (gaps.gaps, gaps.p50, gaps.p90, gaps["mean"]) == (3, 51_000, 70_000, 57_333)
    assert reports.distinct_sessions(spark, stream).first().sessions == 10 and {str(r.d): r.sessions for r in reports.daily_sessions(spark, stream).collect()}["2026-01-07"] == 3
    used = stream.usage.where("server_tools is not null").select(F.explode("server_tools")).groupBy("key").agg(F.sum("value").alias("n")).collect()
    assert [(r.key, r.n) for r in used] == [("web_search_requests", 6)]


def folded(rows):
    """The merge rules, row by row in arrival order."""
    out = {}
    for i, r in enumerate(sorted(rows, key=lambda r: (r["rank"], r["path"], r["pos"]))):
        key = (r["provider"], r["kind"], r["dedupe_key"] if r["dedupe_key"] is not None else ("", i))
        if key not in out:
            out[key] = dict(r)
            continue
        old, early = out[key], [t for t in (out[key]["at"], r["at"]) if t is not None]
        if r["kind"] == "usage":
            win, lose = (dict(r), old) if r["volume"] > old["volume"] else (old, r)
            for c in ("session_id", "model", "project", "agent", "skill"):
                win[c] = win[c] if win[c] is not None else lose[c]
            out[key] = win | {"at": min(early, default=None)}
        elif r["kind"] == "turn":
            if r["duration_ms"] > old["duration_ms"]:
                out[key] = dict(r)
            elif r["duration_ms"] == old["duration_ms"]:
                old["at"] = min(early, default=None)
        elif r["kind"] == "mode":
            out[key] = old | {"has_thinking": old["has_thinking"] or r["has_thinking"], "fast": old["fast"] or r["fast"], "at": min(early, default=None)}
        elif r["kind"] != "pace":
            old["at"] = min(early, default=None)
    return out.values()


def test_merge_of_all_kinds_equals_a_fold(spark):
    rng = random.Random(6)
    maybe = lambda x: x if rng.random() < 0.7 else None
    rows = []
    for n in range(900):
        kind = rng.choice(["usage", "turn", "mode", "pace", "tool", "limit", "effort"])
        rows.append({
            "provider": rng.choice(["a", "b"]), "kind": kind, "path": rng.choice("xyz"), "pos": n, "rank": (rng.randint(0, 1), rng.randint(0, 1)), "at": maybe(datetime(2026, 1, 1) + timedelta(minutes=rng.randint(0, 500))), "dedupe_key": maybe(f"k{rng.randint(0, 25)}"),
            "session_id": maybe(f"s{n}"), "model": maybe(f"m{n}"), "project": maybe(f"p{n}"), "agent": maybe("g"), "skill": maybe("t"), "volume": rng.randint(0, 9) if kind == "usage" else 0, "input": n, "duration_ms": rng.randint(1, 5) if kind == "turn" else None,
            "has_thinking": rng.random() < 0.2 if kind == "mode" else None, "fast": rng.random() < 0.2 if kind == "mode" else None, "tool_name": f"t{n}" if kind == "tool" else None, "gap_ms": n if kind == "pace" else None, "used_percent": float(n) if kind == "limit" else None,
        })
    plain = ["provider", "kind", "path", "pos", "at", "dedupe_key", "session_id", "model", "project", "agent", "skill", "volume", "input", "duration_ms", "has_thinking", "fast", "tool_name", "gap_ms", "used_percent"]
    kinds = {"pos": "struct<block:long,n:long>", "at": "timestamp", "volume": "long", "input": "long", "duration_ms": "long", "has_thinking": "boolean", "fast": "boolean", "gap_ms": "long", "used_percent": "double"}
    data = [tuple((0, r[c]) if c == "pos" else r[c] for c in plain) + (r["rank"],) for r in rows]
    frame = spark.createDataFrame(data, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in plain) + ", rank struct<fork:int,depth:int>").repartition(5)
    every = None
    for provider in "ab":
        for kind in {r["kind"] for r in rows}:
            part = streams.tagged(frame.where((F.col("provider") == provider) & (F.col("kind") == kind)), provider, kind)
            every = part if every is None else every.unionByName(part)
    shown = [c for c in plain if c not in ("path", "pos")]
    some = lambda rs: sorted((tuple(str(r[c]) for c in shown) for r in rs))
    got = some(streams.merged(every).collect())
    want = some(folded(rows))
    assert got == want and len(got) < len(rows)


def test_merge_moves_rows_once(spark):
    empty = streams.tagged(spark.createDataFrame([], "path string"), "a", "usage")
    plan = streams.merged(empty)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Python" not in plan


def test_usage_alone_says_so(spark, stream):
    with pytest.raises(ValueError, match="usage alone"):
        reports.tool_stats(spark, stream._replace(events=None))



def test_a_stream_of_some_kinds_decodes_no_others(spark):
    rows = [("/s/x1.jsonl", (0, n), json.dumps(r)) for n, r in enumerate(codex_rows())]
    lines = spark.createDataFrame(rows, "path string, pos struct<block:long,n:long>, line string")
    whole = streams.from_lines({"codex": lines}, "/home/me", WINDOW)
    some = streams.from_lines({"codex": lines}, "/home/me", WINDOW, kinds=("limit", "pace"))
    assert some.events.columns == whole.events.columns and {r.kind for r in some.events.select("kind").distinct().collect()} == {"limit", "pace"}
    shown = lambda s: sorted(map(repr, s.events.where("kind in ('limit', 'pace')").collect()))
    assert shown(some) == shown(whole) and len(shown(some)) == 2
    assert reports.pace_stats(spark, some).collect() == reports.pace_stats(spark, whole).collect()
    with pytest.raises(ValueError, match="without turn"):
        reports.turn_length(spark, some)
    with pytest.raises(ValueError, match="without usage"):
        reports.daily_usage(spark, some)
