import json
import random

import pytest
from meterlake.functions import command
from meterlake.sources import codex, text
from pyspark.sql import functions as F

META = json.dumps({"timestamp": "2026-06-01T00:00:00Z", "type": "session_meta", "payload": {"id": "s1", "cwd": "/home/me/p"}})


def told(second, **payload):
    return json.dumps({"timestamp": f"2026-06-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z", "type": "event_msg", "payload": payload})


def item(second, start, end, name, kind):
    return told(second, type="item_completed", started_at_ms=start, completed_at_ms=end, item={"id": name, "type": kind})


@pytest.fixture
def decode(spark):
    def make(*files):
        rows = [(f"/sessions/f{n}.jsonl", {"block": 0, "n": i}, line) for n, lines in enumerate(files) for i, line in enumerate([META, *lines])]
        return codex.rows(text.parse(spark.createDataFrame(rows, "path string, pos struct<block:long,n:long>, line string").repartition(3)), "/home/me")

    return make


def test_model_time_of_turns(decode):
    tool = item(15, 5000, 15000, "i2", "CommandExecution")
    decoded = decode([
        told(1, type="task_started"), item(5, 1000, 4000, "i1", "Reasoning"), tool, tool, told(16, type="user_message"), item(18, 10000, 18000, "i3", "McpToolCall"), item(20, 18000, 19000, "i4", "AgentMessage"), told(21, type="task_complete", duration_ms=20000),
        told(60, type="task_started"), told(65, type="task_complete", duration_ms=5000), item(120, 120000, 123000, "i5", "CommandExecution"), told(124, type="task_complete"), tool, item(180, 170000, 172000, "i6", "Reasoning"), item(182, 172000, 174000, "i7", "WebSearch"),
        told(1, type="task_started"), item(9, 6000, 9000, "leak", "CommandExecution"), told(185, type="task_complete", duration_ms=9000), told(240, type="task_started"), tool, told(245, type="task_complete", duration_ms=3000),
    ])
    got = codex.turns(codex.messages(decoded)).orderBy("pos").collect()
    assert [(r.duration_ms, r.model_ms, r.session_id) for r in got] == [(20_000, 7_000, "s1"), (5_000, None, "s1"), (9_000, 7_000, "s1"), (3_000, None, "s1")]


def folded(rows):
    """The rules, line by line."""
    newest, seen, spans, timed, turns = None, set(), [], False, []
    over, pending, gaps = None, None, []
    for kind, at, x in rows:
        if kind in ("start", "abort", "done"):
            live = newest is None or at > newest
            newest = max(at, newest) if newest is not None else at
            if live:
                if kind == "done" and x is not None:
                    busy = set().union(*[range(a, b) for a, b in spans]) if spans else set()
                    turns.append((at, x, max(x - len(busy), 0) if timed else None))
                spans, timed = [], False
            if kind == "done" and (over is None or at > over):
                over = pending = at
        elif kind == "item":
            a, b, name, tool = x
            if (newest is None or at >= newest) and name not in seen:
                seen |= {name} - {None}
                timed = True
                spans += [(a, b)] if tool and b > a else []
        elif kind == "say" and pending is not None and 0 < at - pending <= 1800:
            gaps.append((at, (at - pending) * 1000))
            pending = None
    return turns, gaps


def test_turns_and_paces_equal_a_fold(decode):
    rng = random.Random(11)
    files, want = [], ([], [])
    for _ in range(6):
        at, rows, lines = 100, [], []
        for _ in range(120):
            at += rng.choice([0, 1, 5, 40, 900, 2000])
            when = at - rng.choice([0, 0, 0, 0, 90, 3000]) if at > 3000 else at
            kind = rng.choice(["start", "abort", "done", "done", "item", "item", "item", "say"])
            x = None
            if kind == "item":
                a = rng.randint(0, 60)
                x = (a, a + rng.randint(-2, 20), rng.choice([None, *map(str, range(40))]), rng.random() < 0.7)
                lines.append(item(when, x[0], max(x[1], 0), x[2], "Tool" if x[3] else "Reasoning"))
                x = (x[0], max(x[1], 0), *x[2:])
            elif kind == "done":
                x = rng.choice([None, 15, 60])
                lines.append(told(when, type="task_complete", duration_ms=x))
            else:
                lines.append(told(when, type={"start": "task_started", "abort": "turn_aborted", "say": "user_message"}[kind]))
            rows.append((kind, when, x))
        files.append(lines)
        for all_, own in zip(want, folded(rows), strict=True):
            all_ += own
    told_rows = codex.messages(decode(*files)).cache()
    begin = 1780272000  # 2026-06-01
    turns = [(int(r.t) - begin, r.duration_ms, r.model_ms) for r in codex.turns(told_rows).select(F.unix_seconds("at").alias("t"), "duration_ms", "model_ms").collect()]
    gaps = [(int(r.t) - begin, r.gap_ms) for r in codex.paces(told_rows).select(F.unix_seconds("at").alias("t"), "gap_ms").collect()]
    some = lambda rows: sorted(rows, key=str)
    assert some(turns) == some(want[0]) and some(gaps) == some(want[1]) and len(turns) > 50 and len(gaps) > 10


def test_no_python_in_turns(decode):
    decoded = decode([told(1, type="task_started")])
    plan = codex.turns(codex.messages(decoded))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_replayed_rows_leave_paces_alone(decode):
    rows = ((60, "task_complete"), (120, "user_message"), (180, "task_complete"), (60, "task_complete"), (120, "user_message"), (240, "user_message"), (180, "task_complete"), (300, "user_message"))
    got = codex.paces(codex.messages(decode([told(s, type=k, duration_ms=1000) for s, k in rows]))).orderBy("pos").collect()
    assert [r.gap_ms for r in got] == [60_000, 60_000]


CASES = {
    '{"command":["bash","-lc","grep -rn foo src"]}': "grep", '{"command":["cargo","build"]}': "cargo", "not json": None, '{"command":["/usr/bin/cat","README.md"]}': "cat", '{"command":["bash","-c","grep x"]}': "grep",
    '{"command":["sudo","cargo","build"]}': "cargo", '{"command":["env","FOO=1","grep","x"]}': "grep", '{"command":["bash","--norc","-lc","cat y"]}': "cat", '{"cmd":"ls -la"}': "ls", '{"command":null,"cmd":"ls"}': None,
    '{"command":"\'ls\' z"}': "ls", '{"command":["bash","-lc"]}': None, '{"command":["bash","-lc","  "]}': None, '{"command":["bash"]}': "bash", '{"command":"(cd x)"}': None, '{"command":[1,"time","make"]}': "make",
    '{"command":"' + "A=1 " * 64 + 'grep x"}': None, '{"command":[]}': None, '{"command":""}': None, '{"command":{"a":1}}': None, '{"command":["ls"],"pad":[' + "[]," * 200_000 + "1]}": None,
    '{"command":["bash","-lc","grep ' + "y" * 5000 + '"]}': "grep", '{"cmd":"' + "x" * 1100 + '"}': None,
}


def test_commands_of_shell_calls(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, a string")
    got = {r.i: r.n for r in rows.select("i", command.command_name(text.bounded_json(F.col("a"))).alias("n")).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())


def test_tools_interrupts_and_contexts(decode):
    def call(**payload):
        return json.dumps({"timestamp": "2026-06-01T00:01:00Z", "type": "response_item", "payload": payload})

    def context(second, **payload):
        return json.dumps({"timestamp": f"2026-06-01T00:00:{second:02d}Z", "type": "turn_context", "payload": payload})

    decoded = decode([
        call(name="exec_command", call_id="c1", arguments='{"command":["cargo","build"]}'), call(name="shell", arguments="{"), call(name="view", call_id="c2", arguments='{"cmd":"ls"}'), call(call_id="c3"),
        told(70, type="turn_aborted", reason="interrupted", turn_id="t7"), told(71, type="turn_aborted", reason="interrupted", turn_id="t7"), told(72, type="turn_aborted", reason="replaced", turn_id="t8"), told(73, type="turn_aborted", reason="interrupted"),
        context(1, effort="high", approval_policy="never", turn_id="t1"), context(2, effort="high", turn_id="t2"), context(59, effort="high", approval_policy="never", turn_id="t1"), context(3, effort="low"),
        told(80, type="token_count", info={"last_token_usage": {"total_tokens": 1}, "total_token_usage": {"total_tokens": 2}}, rate_limits={"primary": {"used_percent": 137.5, "resets_at": 9}}), told(81, type="token_count", rate_limits={"primary": {"used_percent": 5}}),
    ]).cache()
    assert {(r.tool_name, r.dedupe_key) for r in codex.tool_events(decoded).collect()} == {("cargo", "tool:c1"), ("shell", "/sessions/f0.jsonl:3:shell"), ("view", "tool:c2")}
    assert [r.dedupe_key for r in codex.interrupts(decoded).collect()] == ["codex-interrupt:v2:s1:t7"] * 2
    assert {r.dedupe_key for r in codex.efforts(decoded).collect()} == {"codex-effort:v2:s1:t1", "codex-effort:v2:s1:t2", "codex-effort:s1:1780272003000000:13"}
    assert {r.dedupe_key for r in codex.permissions(decoded).collect()} == {"codex-permission:v2:s1:t1"}
    limits = {r.dedupe_key: r.used_percent for r in codex.rate_limits(decoded).collect()}
    assert limits == {"codex-limit:v2:s1:0:0:0:0:0:1:0:0:0:0:0:2:100.0:0:9": 100.0, "codex-limit:s1:1780272081000000:15": 5.0}
    assert codex.touches(decoded).count() == 15
