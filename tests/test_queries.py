"""Queries against their DuckDB twins on small tables of one's own."""

import json
from datetime import datetime, timedelta

import duckdb
from meterlake.functions import scalar
from meterlake.plans import catalogue, ingest, logs, streams
from meterlake.sources import agy, codex, text
from pyspark.sql import functions as F


def twin(name: str, folder, *tables: str) -> list[tuple]:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in tables:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(db.execute(catalogue.oracle_sql()[name]).fetchall(), key=repr)


def ours(spark, name: str, folder) -> list[tuple]:
    return sorted((tuple(r) for r in catalogue.queries()[name](spark, str(folder)).collect()), key=repr)


def events(spark, folder, n: int = 60) -> None:
    kinds = ("view", "click", "signup", "purchase", "error")
    rows = [(i, datetime(2024, 1, 16) + timedelta(hours=7 * i, microseconds=i * 1009), i % 9, kinds[i % 5], i * 1.5, f'{{"k": {i * 7 % 100}}}') for i in range(n)]
    made = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    made.write.parquet(f"{folder}/events.parquet")


def test_depths_of_more_halvings_than_recursive_sql_takes(spark, tmp_path):
    spark.range(70_000).select(F.col("id").alias("c_custkey")).union(spark.sql("SELECT * FROM VALUES (9223372036854775807L), (null), (5L)")).write.parquet(f"{tmp_path}/customer.parquet")
    got = catalogue.queries()["ancestry_depth"](spark, str(tmp_path))
    assert got.count() == 70_003 and dict(got.dtypes) == {"id": "bigint", "depth": "int"}
    want = {i: max(i.bit_length() - 1, 0) for i in (*range(70_000), 2**63 - 1)} | {None: None}
    assert {r.id: r.depth for r in got.collect()} == want


def test_session_bounds_of_logs_need_usage_alone(spark, tmp_path):
    events(spark, tmp_path)
    got = ours(spark, "log_session_bounds", tmp_path)
    assert got and got == twin("log_session_bounds", tmp_path, "events")


def test_bands_weigh_all_tokens_of_their_calls(spark, tmp_path):
    events(spark, tmp_path)
    got = ours(spark, "context_bands", tmp_path)
    assert got == twin("context_bands", tmp_path, "events")
    summary = catalogue.queries()["context_summary"](spark, str(tmp_path)).collect()
    # the bands' weighted tokens are all but the remainder, their cached part is the summary's
    assert sum(r[3] for r in got) == sum(int(r.effective_tokens) - int(r.unclassified_tokens) for r in summary)
    assert sum(r[4] for r in got) == sum(int(r[f"band{n}_cached"]) for r in summary for n in range(4))


def test_history_lines_are_numbered_across_blocks(spark):
    """Blocks of places of one file and of another; places with gaps, given in any order."""
    places = [("/h", 0, n) for n in (0, 3, 65535, 65536, 200000)] + [("/h", 7, n) for n in (1, 65540)] + [("/k", 0, 5)]
    rows = [(path, (block, n), '{"timestamp":1767312000000}') for path, block, n in reversed(places)]
    lines = spark.createDataFrame(rows, "path string, pos struct<block:long,n:long>, line string")
    made = agy.history_touches(lines)
    got = sorted((r.path, r.pos.block, r.pos.n, r.session_id) for r in made.collect())
    assert got == [(*p, f"history:{i + 1}") for i, p in enumerate(places[:7])] + [("/k", 0, 5, "history:1")]
    # no window orders the lines of a whole path: the one over paths alone sees sums of blocks
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(path" in plan and "__part" in plan.split("row_number() windowspecdefinition(", 1)[1].split("]")[0]


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"a": "x"}',), ("{",), ("",)], "line string")
    read = text.parse(lines).where("v is not null").select(text.text_at(F.col("v"), "$.a").alias("a"))
    assert [r.a for r in read.collect()] == ["x"] and text.parse(lines).count() == 3
    assert read._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_windows_of_rollouts_are_two(spark):
    lines = spark.createDataFrame([("/s/a.jsonl", (0, 1), "{}")], "path string, pos struct<block:long,n:long>, line string")
    plan = codex.rows(text.parse(lines), "/home/me")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("+- Window") + plan.startswith("Window") == 2


def test_messages_of_rollouts_are_read_before_lines_are_ordered(spark):
    e = lambda s, kind, **p: f'{{"timestamp":"2026-01-03T12:00:{s:02d}Z","type":"{kind}","payload":{json.dumps(p)}}}'
    fork = [e(1, "session_meta", id="x", forked_from_id="y"), e(2, "session_meta", id="y"), e(2, "event_msg", type="task_complete", duration_ms=5), e(9, "event_msg", type="task_complete", duration_ms=6), '{"payload":{"type":"task_started"}}']
    plain = [e(3, "event_msg", type="token_count"), e(4, "event_msg", type="item_completed", started_at_ms=1, completed_at_ms=4, item={"id": "i", "type": "X"}), e(5, "response_item", type="user_message"), e(6, "event_msg", type="user_message"), "{"]
    lines = spark.createDataFrame([(f"/s/{name}.jsonl", (0, n), x) for name, own in (("a", fork), ("b", plain)) for n, x in enumerate(own)], "path string, pos struct<block:long,n:long>, line string")
    parsed = text.parse(lines)
    made = codex.told(parsed, "/home/me")
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(made) == shown(codex.messages(codex.rows(parsed, "/home/me"))) and [r.duration_ms for r in made.where("kind = 'task_complete'").collect()] == [6]
    # no variant is sorted
    sort = made._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(path", 1)
    assert len(sort) == 2 and " v#" not in sort[0].split("Sort [path", 1)[1].split("\n", 1)[0] and "variant" not in sort[0]


def test_common_instants_take_one_step(spark):
    texts = ["2026-01-02T03:04:05Z", "2026-01-02 03:04:05.123456+05:30", "2026-01-02t03:04:05z", "2026-01-02T03:04:05.1234567Z", "1970-01-01T00:00:00+05:00", "1969-12-31T23:00:00-05:00", "3000-01-01T00:00:00Z", "3000-01-01T00:00:00+05:00", "2026-13-02T03:04:05Z", "2026-01-02T03:04:05", "", None]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.unix_micros(scalar.parse_instant(F.col("t"))).alias("us"))
    got = {r.i: r.us for r in made.collect()}
    us = lambda *a: int((datetime(*a) - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    noon = us(2026, 1, 2, 3, 4, 5)
    assert [got[i] for i in range(12)] == [noon, us(2026, 1, 1, 21, 34, 5, 123456), noon, noon + 123456, None, us(1970, 1, 1, 4), None, us(2999, 12, 31, 19), None, None, None, None]


def test_events_are_dealt_out_before_they_become_lines(spark, tmp_path):
    events(spark, tmp_path)
    plan = logs.transcript_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [ordinal") == 2


def echoing(spark, folder) -> None:
    """Events of three users; those of one user that are 11 apart have the same counters, which rollouts then repeat as echoes."""
    kinds = ("view", "click", "signup", "purchase", "error")
    rows = [(i, datetime(2024, 1, 16) + timedelta(hours=2 * i, microseconds=i * 1009), i // 11 % 9 // 3, kinds[i % 5], 7.5, f'{{"k": {30 + i // 99}}}') for i in range(198)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")


def written(monkeypatch, module) -> list[str]:
    """Plans of the tables that the module's steps write."""
    plans, real = [], module.stored
    monkeypatch.setattr(module, "stored", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or real(rows))
    return plans


def test_echoes_of_rollouts_meet_their_records_without_a_join(spark):
    e = lambda s, kind, **p: f'{{"timestamp":"2026-01-03T12:00:{s:02d}Z","type":"{kind}","payload":{json.dumps(p)}}}'
    use = lambda n: {"input_tokens": n, "output_tokens": 1, "total_tokens": n + 1}
    record = lambda s, n, owner="a": e(s, "token_usage_record", thread_id=owner, response_id=f"r{s}", usage=use(n))
    count = lambda s, n: e(s, "event_msg", type="token_count", info={"last_token_usage": use(n)})
    one = [e(0, "session_meta", id="a"), count(1, 10), record(2, 10), count(3, 10), count(4, 10), record(5, 20, "other"), count(6, 20), count(7, 30), count(8, 0), record(9, 10)]
    two = [e(0, "session_meta", id="b"), count(1, 10), e(2, "token_usage_record", usage={"input_tokens": 40, "output_tokens": 1}), count(3, 40), record(4, 50, "b")]
    lines = spark.createDataFrame([(f"/s/{name}.jsonl", (0, n), x) for name, own in (("a", one), ("b", two)) for n, x in enumerate(own)], "path string, pos struct<block:long,n:long>, line string")
    made = codex.usage_events(codex.rows(text.parse(lines), "/home/me"))
    # a count is left out after a record of its file with its counters, also another thread's; not before one, and not for a line without a total
    assert sorted((r.path[3], r.pos.n, r.input, r.dedupe_key.split(":")[0]) for r in made.collect()) == [
        ("a", 1, 10, "codex"), ("a", 2, 10, "codex-usage"), ("a", 7, 30, "codex"), ("a", 8, 0, "codex"), ("a", 9, 10, "codex-usage"),
        ("b", 1, 10, "codex"), ("b", 3, 40, "codex"), ("b", 4, 50, "codex-usage"),
    ]
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_model_stats_of_logs_broadcast_no_records(spark, tmp_path, monkeypatch):
    echoing(spark, tmp_path)
    plans = written(monkeypatch, ingest)
    got = ours(spark, "log_model_stats", tmp_path)
    assert got and got == twin("log_model_stats", tmp_path, "events")
    assert plans and not [p for p in plans if "Join" in p]


def test_session_bounds_of_logs_broadcast_no_records(spark, tmp_path, monkeypatch):
    echoing(spark, tmp_path)
    plans = written(monkeypatch, ingest)
    got = ours(spark, "log_session_bounds", tmp_path)
    assert got and got == twin("log_session_bounds", tmp_path, "events")
    assert plans and not [p for p in plans if "Join" in p]


def test_limits_of_a_stream_broadcast_no_records(spark, tmp_path, monkeypatch):
    echoing(spark, tmp_path)
    plans = written(monkeypatch, streams)
    got = ours(spark, "stream_limits", tmp_path)
    assert got and got == twin("stream_limits", tmp_path, "events")
    assert plans and not [p for p in plans if "Join" in p]
