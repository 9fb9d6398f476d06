import json
import random
import sqlite3

import pytest
from meterlake.operators import ancestry
from meterlake.plans import fork_logs
from meterlake.sources import copilot, grok, opencode, sqlite, text
from pyspark.sql import functions as F

SHAPES = {
    "message": "id TEXT, session_id TEXT, time_created INT, data TEXT", "part": "id TEXT, message_id TEXT, session_id TEXT, time_created INT, data TEXT", "session": "id TEXT, directory TEXT",
    "session_message": "id TEXT, session_id TEXT, type TEXT, seq INT, time_created INT, data TEXT", "session_v2": "id TEXT, directory TEXT, fork_session_id TEXT, fork_boundary TEXT",
}


@pytest.fixture
def store(tmp_path):
    def make(name, shapes=SHAPES, **tables):
        path = str(tmp_path / name)
        db = sqlite3.connect(path)
        for table, shape in shapes.items():
            db.execute(f"CREATE TABLE {table}({shape})")
            for row in tables.get(table, []):
                db.execute(f"INSERT INTO {table} VALUES ({', '.join('?' * len(row))})", row)
        db.commit()
        db.close()
        return path

    return make


def said(created=1000, completed=None, **more):
    return json.dumps({"time": {"created": created} | ({"completed": completed} if completed else {}), "tokens": {"input": 10, "output": 5, "reasoning": 2, "cache": {"read": 30, "write": 4}}} | more)


def new(i, session, seq, kind="assistant", **more):
    return (i, session, kind, seq, 1000 + seq, said(1000 + seq, **more))


def test_generations_and_stores_count_a_message_once(spark, store):
    tool = json.dumps({"type": "tool", "tool": "bash", "state": {"time": {"start": 1234}}})
    first = store("opencode-a.db", message=[("m1", "s", 1000, said(role="assistant", modelID="old", path={"cwd": "/home/me/app"}, finish="stop", completed=5000)), ("m2", "s", 1000, "{bad"), ("m3", "s", 1000, said(role="user")), ("m4", None, 1000, said(role="assistant")), (None, "s", 1000, "{}")],
                  part=[("p1", "m1", "s", 1000, tool), ("p2", "m2", "s", 1001, tool), ("p3", "m1", "s", 1000, json.dumps({"type": "text"})), ("p4", None, None, 1002, json.dumps({"type": "tool", "tool": "read"}))])
    blocks = [{"type": "tool", "name": "grep"}, {"type": "text"}, {"type": "tool"}]
    second = store("opencode-b.db", session_message=[new("m1", "s", 1, content=blocks), new("m2", "s", 2, content=blocks, model={"id": "new"}), new("m5", "s", 3, "compaction"), ("m6", "s", "compaction", 4, 1004, json.dumps({"time": {}})), new("m7", "s", 5, "user"), new("m8", None, 6)],
                   part=[("p1", "m1", "s", 1000, tool), ("p5", "m2", "s", 1000, tool)], session_v2=[("s", None, None, None)], session=[("s", "/home/me/other")])
    tables = opencode.read_tables(spark, [second, first])
    told = opencode.messages(tables, "/home/me").cache()
    got = {r.dedupe_key[9:]: (r.session_id, r.model, r.project, r.output, r.volume) for r in opencode.usage_events(told).collect()}
    assert got == {"m1": ("s", "old", "app", 7, 51), "m4": ("", None, None, 7, 51), "m2": ("s", "new", "other", 7, 51), "m5": ("s", None, "other", 7, 51)}
    assert [(r.duration_ms, r.status) for r in opencode.durations(told).collect()] == [(4000, "stop")] and opencode.touches(told).count() == 7
    # the second store's parts of m2 come before its session messages
    calls = sorted((r.tool_name, r.session_id, r.ms) for r in opencode.tool_events(tables, told).withColumn("ms", F.unix_millis("at")).collect())
    assert calls == [("bash", "s", 1234)] * 3 + [("read", "", 1002)]
    s = opencode.scan_stats(tables).first()
    assert (s.stores, s.rows, s.parse_errors, s.cut_stores) == (2, 17, 3, 0)


def test_forks_drop_what_they_copied(spark, store):
    bound = lambda kind, message: json.dumps({"type": kind, "messageID": message})
    rows = [new(f"p{n}", "parent", n) for n in (1, 3, 5)]
    for fork in ("through", "before", "odd", "lost", "orphan"):
        rows += [new(f"{fork}{n}", fork, n) for n in (1, 3, 4, 9)]
    forks = [("through", None, "parent", bound("through", "p3")), ("before", None, "parent", bound("before", "p3")), ("odd", None, "parent", bound("x", "p3")), ("lost", None, "parent", bound("through", "gone")), ("orphan", None, "none", bound("through", "p3"))]
    path = store("opencode.db", session_message=rows, session_v2=forks)
    for since in (None, 1004):  # a floor hides rows, never the parent's places
        told = opencode.messages(opencode.read_tables(spark, [path], since), "/home/me")
        left = {r.id for r in told.collect()}
        want = {f"p{n}" for n in (1, 3, 5)} | {"through4", "through9", "before3", "before4", "before9"} | {f"{f}{n}" for f in ("odd", "lost", "orphan") for n in (1, 3, 4, 9)}
        assert left == {x for x in want if since is None or int(x[-1]) >= 4}


def test_losses_of_a_store_are_told(spark, store, tmp_path):
    path = store("opencode-a.db", message=[(f"m{n}", "s", n, said()) for n in range(50)])
    db = sqlite3.connect(path)
    db.execute("CREATE VIEW part2 AS SELECT * FROM message")
    db.close()
    (tmp_path / "opencode-bad.db").write_bytes(b"not a store" * 100)
    paths = [path, str(tmp_path / "opencode-bad.db"), str(tmp_path / "none.db")]
    rows = sqlite.read_store(spark, paths, "message", "id string, data string", most_bytes=str(len(said()) * 20)).cache()
    assert 15 <= rows.where("problem is null").count() < 20
    lost = {r.store.rsplit("/", 1)[1]: r.problem for r in sqlite.losses(rows).collect()}
    assert set(lost) == {"opencode-a.db", "opencode-bad.db", "none.db"} and "bytes" in lost["opencode-a.db"] and lost["none.db"] == "not a file"
    assert sqlite.losses(sqlite.read_store(spark, [path], "part2", "id string")).first().problem == "no plain table"
    assert sqlite.losses(sqlite.read_store(spark, [path], "absent", "id string")).count() == 0
    assert "time" in sqlite.losses(sqlite.read_store(spark, [path], "message", "id string, data string", seconds="-1")).first().problem
    s = opencode.scan_stats(opencode.read_tables(spark, paths)).first()
    assert (s.stores, s.rows, s.cut_stores) == (3, 50, 2)


def test_depths_equal_walks(spark):
    rng = random.Random(3)
    parent = {n: rng.choice([None, n - 1, rng.randrange(400), n + 1, 10_000 + n]) if n % 3 else n - 1 for n in range(400)}
    chain = {1000 + n: 999 + n if n else None for n in range(90)}
    parent |= chain

    def walk(n):
        depth, at = 0, parent[n]
        while at is not None:
            depth += 1
            if depth >= 64:
                break
            at = parent.get(at)
        return depth

    frame = spark.createDataFrame(list(parent.items()), "node long, parent long").repartition(3)
    got = {r.node: r.depth for r in ancestry.depths(frame).collect()}
    assert got == {n: walk(n) for n in parent} and {0, 1, 63, 64} <= set(got.values())
    assert ancestry.depths(frame.where("false")).count() == 0


def test_fork_order_of_updates(spark):
    line = lambda second, prompt: json.dumps({"timestamp": second, "params": {"update": {"sessionUpdate": "turn_completed", "prompt_id": prompt, "usage": {"inputTokens": 100, "outputTokens": 5, "apiDurationMs": 9}}}})
    call = json.dumps({"timestamp": 5, "params": {"update": {"sessionUpdate": "tool_call", "title": "run", "toolCallId": "c1"}}})
    files = {"a/child": [line(900, "x")], "b/fork": [line(800, "x"), line(801, "y")], "z/main": [line(1, "x")], "c/agent": [line(2, "w"), call], "d/broken": [line(3, "v")]}
    rows = [(f"/g/{k}/updates.jsonl", {"block": 0, "n": i}, x) for k, lines in files.items() for i, x in enumerate(lines)]
    told = {"a/child": {"session_kind": "worktree", "parent_session_id": "fork"}, "b/fork": {"session_kind": "fork", "parent_session_id": "main"}, "z/main": {"info": {"cwd": "/home/me/w"}}, "c/agent": {"session_kind": "subagent_x", "parent_session_id": "main"}}
    summaries = spark.createDataFrame([(f"/g/{k}/summary.json", json.dumps(x)) for k, x in told.items()] + [("/g/d/broken/summary.json", "{")], "path string, text string")
    lines = spark.createDataFrame(rows, "path string, pos struct<block:long,n:long>, line string")
    known = grok.sessions(lines.select("path"), summaries, "/home/me")
    decoded = grok.rows(text.parse(lines), known).cache()
    used = [(r.session_id, r.dedupe_key, r.project) for r in grok.usage_events(decoded).orderBy("rank", "path", "pos").collect()]
    assert used == [("main", "grok:x", "w"), ("fork", "grok:x", None), ("fork", "grok:y", None), ("child", "grok:x", None)]
    assert grok.durations(decoded).count() == 4 and grok.touches(decoded).count() == 6
    assert [(r.tool_name, r.source_kind, r.dedupe_key) for r in grok.tool_events(decoded).collect()] == [("run", "subagent", "grok-tool:c1")]


LEDGER = {
    "assistant_usage_events": "id INT, session_id TEXT, model TEXT, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, reasoning_tokens INT, agent_id TEXT, initiator TEXT, created_at TEXT",
    "sessions": "id TEXT, cwd TEXT",
}


def call(i, session, hour, model="m", **x):
    return (i, session, model, x.get("n", 100), 5, 30, 10, 0, x.get("agent"), x.get("by", "user"), f"2026-01-01 {hour:02d}:00:00" if hour is not None else "soon")


def test_ledger_replaces_snapshots(spark, store):
    shot = lambda key, session, hour: (key, session, f"2026-01-01 {hour:02d}:00:00", 7)
    shots = [shot("k1", "s", 1), shot("k2", "s", 5), shot("k2", "fork", 2), shot("k3", "fork", 2), shot("k4", "torn", 5), shot("k5", "torn", 3), (None, "s", "2026-01-01 06:00:00", 7), ("k6", "s", None, 7)]
    snapshots = spark.createDataFrame(shots, "dedupe_key string, session_id string, at string, volume long").withColumn("at", F.to_timestamp("at"))
    calls = [call(1, "s", 4), call(2, "s", 9, agent="x"), call(3, "torn", 4), call(4, "torn", None), call(5, "torn", 8, by="sub-agent"), call(6, "late", None), call(7, "late", 9), call(8, "zero", 1, n=-5)]
    path = store("session-store.db", LEDGER, assistant_usage_events=calls, sessions=[("s", "/home/me/w")])
    book = copilot.ledger(*copilot.read_ledger(spark, [path]), "/home/me")
    kept, used = copilot.reconcile(snapshots, book)
    assert sorted(r.dedupe_key for r in kept.collect()) == ["k1", "k3", "k4", "k5"]
    got = {r.dedupe_key[13:]: (r.session_id, r.project, r.source_kind, r.volume) for r in used.collect()}
    assert got == {"1": ("s", "w", "main", 105), "2": ("s", "w", "subagent", 105), "5": ("torn", None, "subagent", 105), "7": ("late", None, "main", 105), "8": ("zero", None, "main", 45)}
    # a row without a session makes every session of the store incomplete
    path = store("other.db", LEDGER, assistant_usage_events=[*calls, call(9, None, 1)])
    kept, used = copilot.reconcile(snapshots, copilot.ledger(*copilot.read_ledger(spark, [path]), "/home/me"))
    assert kept.count() == len(shots) and sorted(r.dedupe_key[13:] for r in used.collect()) == ["2", "5", "7", "8"]


def test_small_stores_share_a_partition(spark, tmp_path, monkeypatch):
    paths = []
    for n in range(7):
        db = sqlite3.connect(tmp_path / f"{n}.db")
        db.execute("CREATE TABLE t(a INT)")
        db.executemany("INSERT INTO t VALUES (?)", [(n * 10 + i,) for i in range(n)])
        db.commit()
        db.close()
        paths.append(str(tmp_path / f"{n}.db"))
    rows = sqlite.read_store(spark, [*paths, str(tmp_path / "gone.db")], "t", "a long")
    assert rows.rdd.getNumPartitions() == 1
    want = [(p, i, n * 10 + i, None) for n, p in enumerate(paths) for i in range(n)] + [(str(tmp_path / "gone.db"), 0, None, "not a file")]
    assert sorted(((r.store, r.pos, r.a, r.problem) for r in rows.collect()), key=repr) == sorted(want, key=repr)
    reader = sqlite.SqliteReader(rows.schema, {"paths": "\n".join(paths), "table": "t"})
    monkeypatch.setattr(sqlite, "PART_STORES", 3)
    assert [len(p.paths) for p in reader.partitions()] == [3, 3, 1]
    monkeypatch.setattr(sqlite, "PART_BYTES", 1)
    assert [p.paths for p in reader.partitions()] == [[p] for p in paths]


def test_usage_of_forks_takes_each_value_once(spark):
    """Lines of odd turns by hand; no line of a subagent is parsed, and no value is decoded again by a filter."""
    line = lambda usage, at="5", name="p": f'{{"timestamp":{at},"params":{{"update":{{"sessionUpdate":"turn_completed","prompt_id":"{name}","usage":{usage}}}}}}}'
    bodies = [
        '{"modelUsage":{"m":{"inputTokens":9,"cachedReadTokens":3,"cacheCreationTokens":2,"outputTokens":1},"n":{"inputTokens":-4,"outputTokens":2.5},"o":{"outputTokens":7}}}', '{"inputTokens":6,"modelUsage":{}}', '{"inputTokens":5,"modelUsage":[1]}',
        '{"modelUsage":{"m":null}}', '"text"', "null", '{"modelUsage":{"' + "k" * 2000 + '":{"outputTokens":7}}}', '{"inputTokens":"8","outputTokens":99999999999999999999}',
    ]
    texts = [line(b) for b in bodies] + [line('{"inputTokens":1}', at, name) for at, name in (("-5", "q"), ("1.5", "r"), ('"5"', "s"), ("32503680000", "t"), ("5", ""))] + ["{", "", '{"params":{"update":{"sessionUpdate":5,"prompt_id":"p","usage":{"inputTokens":1}}}}']
    lines = spark.createDataFrame([(f"/g/{f}/updates.jsonl", (0, n), x) for f in ("main", "agent", "torn") for n, x in enumerate(texts)], "path string, pos struct<block: long, n: long>, line string")
    told = [("/g/main/summary.json", '{"info":{"cwd":"/home/me/w"}}'), ("/g/agent/summary.json", '{"session_kind":"subagent"}'), ("/g/torn/summary.json", "{")]
    known = grok.sessions(lines.select("path"), spark.createDataFrame(told, "path string, text string"), "/home/me")
    used = grok.usage_of(lines, known)
    got = [(r.pos.n, r.at and r.at.timestamp(), r.dedupe_key, r.model, r.input, r.output, r.reasoning, r.cache_creation, r.cache_read, r.volume, r.project) for r in used.orderBy("pos", "model").collect()]
    assert got == [
        (0, 5.0, "grok:p:m", "m", 4, 1, 0, 2, 3, 10, "w"), (0, 5.0, "grok:p:o", "o", 0, 7, 0, 0, 0, 7, "w"), (1, 5.0, "grok:p", None, 6, 0, 0, 0, 0, 6, "w"), (2, 5.0, "grok:p", None, 5, 0, 0, 0, 0, 5, "w"),
        *[(n, None, f"grok:{k}", None, 1, 0, 0, 0, 0, 1, "w") for n, k in ((8, "q"), (9, "r"), (10, "s"), (11, "t"))],
    ]
    before = grok.usage_events(grok.rows(text.parse(lines), known))
    assert before.exceptAll(used.select(before.columns)).count() == used.select(before.columns).exceptAll(before).count() == 0
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.params.update.usage.modelUsage") == 1 and plan.count("$.timestamp, LongType") == 1


def test_forks_read_their_table_once(spark):
    lines, summaries = fork_logs._forked(spark, "/root/testdata/sf0.001")
    scans = lambda rows: rows._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert scans(lines) == 1 and "events.parquet" not in "".join(summaries.inputFiles())
