import json
import random
from datetime import datetime

import pytest
from meterlake.functions import labels, scalar
from meterlake.operators import context, dedupe, pricing, sequence
from meterlake.plans import catalogue
from meterlake.streaming import sessions
from pyspark.sql import functions as F


def test_every_report_has_a_twin():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql()) and len(catalogue.queries()) > 50


def test_merge_identity_equals_the_fold(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(60), i, rng.randrange(6), rng.randrange(9), rng.choice([None, "a", "b"]), rng.choice([None, "x", "y"])) for i in range(400)]
    frame = spark.createDataFrame(rows, "key long, ordinal long, volume long, at long, project string, model string")
    got = {r.key: (r.at, r.volume, r.project, r.model) for r in dedupe.merge_usage(frame, ["key"], "volume", ["ordinal"], "at", [], ["project", "model"]).collect()}
    want = {}
    for key, _, volume, at, project, model in rows:
        if key not in want:
            want[key] = (at, volume, project, model)
            continue
        a, v, p, m = want[key]
        new = (min(a, at), volume, project or p, model or m) if volume > v else (min(a, at), v, p or project, m or model)
        want[key] = new
    assert got == want


def test_longest_duration_keeps_the_first_of_equals(spark):
    rows = [(1, 0, 5, 9, "a"), (1, 1, 7, 8, "b"), (1, 2, 7, 3, "c"), (1, 3, 6, 1, "d")]
    r = dedupe.keep_longest(spark.createDataFrame(rows, "key long, n long, duration long, at long, who string"), ["key"], "duration", ["n"], "at", ["who"]).first()
    assert (r.duration, r.at, r.who) == (7, 3, "b")


def test_null_keys_are_kept(spark):
    frame = spark.createDataFrame([(None, 1), (None, 2), ("k", 3), ("k", 4)], "key string, n long")
    assert dedupe.keyed(frame, "key", lambda f: dedupe.keep_first(f, ["key"], ["n"], None, ["n"])).count() == 3


def spans(spark, rows):
    return spark.createDataFrame(rows, "d int, first_at string, last_at string").select("d", *[F.to_timestamp(c).alias(c) for c in ("first_at", "last_at")])


@pytest.mark.parametrize(("rows", "peak", "levels"), [
    ([(1, "2026-01-01 10:00:00", "2026-01-01 12:00:00"), (1, "2026-01-01 10:30:00", "2026-01-01 11:30:00")], 2, {0: 3600, 1: 3600}),
    ([(1, "2026-01-01 10:00:00", "2026-01-01 11:00:00"), (1, "2026-01-01 11:00:00", "2026-01-01 12:00:00")], 1, {0: 7200}),
])
def test_sweep(spark, rows, peak, levels):
    s = sequence.sweep(spans(spark, rows), ["d"], "first_at", "last_at")
    assert s.agg(F.max("open")).first()[0] == peak
    got = {r.level: r.s for r in s.where("open > 0 and seconds > 0").groupBy(sequence.level(F.col("open")).alias("level")).agg(F.sum("seconds").alias("s")).collect()}
    assert got == levels


def test_sweep_equals_brute_force(spark):
    rng = random.Random(3)
    clock = lambda s: f"2026-01-01 10:{s // 60:02d}:{s % 60:02d}"
    # few instants, so that many meet; the null group and a group of one span stand alone
    rows = [(rng.choice([None, 1, 2, 2, 2]), *sorted(rng.choices(range(0, 600, 7), k=2))) for _ in range(400)] + [(3, 5, 200)]
    got = sequence.sweep(spans(spark, [(d, clock(a), clock(b)) for d, a, b in rows]).repartition(5), ["d"], "first_at", "last_at").collect()
    want = []
    for d in {r[0] for r in rows}:
        mine = [(a, b) for x, a, b in rows if x == d and a < b]
        at = sorted({t for pair in mine for t in pair})
        want += [(d, clock(t), sum(a <= t < b for a, b in mine), (n - t) if n is not None else None) for t, n in zip(at, [*at[1:], None], strict=True)]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.d, str(r.t), r.open, r.seconds) for r in got), key=key) == sorted(want, key=key)
    assert sequence.sweep(spans(spark, []), ["d"], "first_at", "last_at").count() == 0


def test_price_keys(spark):
    models = spark.createDataFrame([("claude-opus-4-8-latest",), ("claude-opus-4-8-20260101",), ("claude-opus-4-8-fast",), ("claude-opus-4-80",), ("gpt-5-5",), ("codex",), ("Claude-Opus-4-8[1m]",), ("GPT-5.5 (fast)",), (None,)], "model string")
    got = {r.model: r.price_model for r in pricing.resolve(models, pricing.price_table(spark)).collect()}
    assert got == {"claude-opus-4-8-latest": "claude-opus-4-8", "claude-opus-4-8-20260101": "claude-opus-4-8", "claude-opus-4-8-fast": None, "claude-opus-4-80": None, "gpt-5-5": None, "Claude-Opus-4-8[1m]": "claude-opus-4-8", "GPT-5.5 (fast)": "gpt-5.5", "codex": "gpt-6.1-sol", None: None}


def test_cost_of_a_call_and_its_tier(spark):
    row = lambda m, i, o, r, w: (m, i, o, r, w, 0, 0, "call", i + o + r + w)
    rows = [row("claude-opus-4-8", 1_000_000, 1_000_000, 10_000_000, 1_000_000), row("claude-haiku-5-5", 100_000, 0, 0, 0), row("claude-haiku-5-5", 100_001, 0, 0, 0), row("nobody", 5, 0, 0, 0), row("nobody", 0, 0, 0, 0)]
    usage = spark.createDataFrame(rows, "model string, input long, output long, cache_read long, cache_creation long, w5m long, w1h long, granularity string, volume long")
    got = sorted((r.usd if r.usd is not None else -1.0) for r in pricing.with_cost(usage, pricing.price_table(spark)).collect())
    assert got == pytest.approx([-1.0, 0.0, 0.01, 0.0500005, 41.25])


def test_price_table_decoder(spark, tmp_path):
    table = {
        "a": {"mode": "chat", "input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6, "input_cost_per_token_above_200k_tokens": 3e-6},
        "xai/b": {"mode": "chat", "input_cost_per_token": 5e-6, "output_cost_per_token": 1e-6, "cache_creation_input_token_cost": 0.0},
        "b": {"mode": "responses", "input_cost_per_token": 4e-6, "output_cost_per_token": 1e-6},
        "us/c": {"mode": "chat", "input_cost_per_token": 1e-6, "output_cost_per_token": 1e-6}, "d": {"mode": "embedding", "input_cost_per_token": 1e-6},
        "e": {"mode": "chat", "input_cost_per_token": 0.5, "output_cost_per_token": 1e-6}, "f": "text",
    }
    (tmp_path / "p.json").write_text(json.dumps(table))
    got = {r.price_model: (round(r.r_in, 9), round(r.r_5m, 9), r.tier, r.t_in and round(r.t_in, 9)) for r in pricing.decode_price_table(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"a": (1.0, 1.0, 200_000, 3.0), "b": (4.0, 4.0, None, None)}


def test_context_reasons(spark):
    call = lambda n, at, i, w, r, kind="main": (n, f"2026-01-01 {at}", "claude", "s", "m", i, w, r, kind, "call")
    rows = [call(0, "10:00:00", 100, 0, 0), call(1, "10:10:00", 10, 0, 90), call(2, "12:00:00", 80, 0, 20), call(3, "12:01:00", 90, 0, 10), call(4, "09:00:00", 5, 0, 5, "subagent")]
    frame = spark.createDataFrame(rows, "ordinal long, at string, provider string, session_id string, model string, input long, cache_creation long, cache_read long, source_kind string, granularity string").withColumn("at", F.to_timestamp("at"))
    assert [r.reason for r in context.classify(frame).orderBy("ordinal").collect()] == ["cold_start", "uncached", "expired", "uncached"]


def test_interval_union_and_deltas(spark):
    spans_ = spark.sql("SELECT array(named_struct('start', 1L, 'end', 5L), named_struct('start', 3L, 'end', 8L), named_struct('start', 10L, 'end', 12L)) AS s")
    assert spans_.select(sequence.union_length(F.col("s"))).first()[0] == 9
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 3)], "k long, n long, c long")
    assert [r.d_c for r in sequence.deltas(rows, ["k"], ["n"], ["c"]).orderBy("n").collect()] == [5, 4, 3]


def test_scalars(spark):
    frame = spark.createDataFrame([("Claude Opus[1m] (x)", "/home/me/a/b", "2026-01-01T10:00:00.123456789+02:00", "a​b\x07"), ("GPT", "/home/me", "10000-01-01T00:00:00Z", "ok"), ("x", "/home/mean", "nonsense", "")], "m string, c string, t string, s string")
    got = frame.select(scalar.normalize_model(F.col("m")).alias("m"), scalar.project_from_cwd(F.col("c"), "/home/me").alias("c"), scalar.parse_instant(F.col("t")).cast("string").alias("t"), scalar.strip_invisible(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("claude-opus", "a/b", "2026-01-01 08:00:00.123456", "ab"), ("gpt", "~", None, "ok"), ("x", "home/mean", None, "")]
    big = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,), (2**63 - 1,)], "n long")
    assert int(big.agg(scalar.saturating_sum(F.col("n"))).first()[0]) == scalar.U64_MOST
    ten = spark.range(1, 11).agg(*[scalar.nearest_rank("id", p).alias(f"p{p}") for p in (50, 90)]).first()
    assert tuple(ten) == (5, 9)
    local = spark.sql("SELECT timestamp'2026-01-01 23:30:00Z' AS t").select(scalar.local_time(F.col("t"), 3600).cast("string").alias("x")).first().x
    assert local == "2026-01-02 00:30:00"


def test_streams(spark, tmp_path):
    rows = [(i, f"2026-01-01 {10 + i // 6}:{i % 6}0:00", f"k{i % 20}", "claude", f"s{i % 2}", i) for i in range(30)]
    events = spark.createDataFrame(rows, "n long, at string, dedupe_key string, provider string, session_id string, volume long").withColumn("at", F.to_timestamp("at"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = sessions.read_stream(spark, str(tmp_path / "in"), events.schema)
    hours = sessions.run_once(sessions.hourly_volume(stream), "hours", str(tmp_path / "c1"), "complete")
    assert hours.agg(F.sum("volume")).first()[0] == sum(range(30)) and hours.count() == 5
    assert sessions.run_once(sessions.first_of_key(stream), "firsts", str(tmp_path / "c2")).count() == 20
    stretches = sessions.run_once(sessions.inactivity_stretches(stream), "stretches", str(tmp_path / "c3"), "complete")
    assert stretches.agg(F.sum("events")).first()[0] == 30


def test_reports_run_without_python(spark):
    for name in ("model_stats", "context_calls", "concurrency_levels", "dedupe_usage"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_ordered_turn_lengths_cover_all_users_and_undated_turns(spark, tmp_path):
    rows = [(i, at, u, "view", 6.0, '{"k": 1}') for i, (at, u) in enumerate([(None, 7), ("2024-01-20 10:00:00", 7), ("2024-01-18 10:00:00", 7), ("2024-02-20 10:00:00", 7), ("2024-01-21 10:00:00", 4000), (None, 4000)])]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.queries()["ordered_turn_lengths"](spark, str(tmp_path)).collect()
    want = {("s7", 1, "2024-01-18 10:00:00"), ("s7", 2, "2024-01-20 10:00:00"), ("s7", 3, "None"), ("s4000", 1, "2024-01-21 10:00:00"), ("s4000", 2, "None")}
    assert len(got) == 5 and {(r.session_id, r.n, str(r["at"])) for r in got} == want


def test_calls_without_session_are_uncached_and_totals_are_checked(spark):
    """Null sessions have no cold start and never expire; sums beyond 64 bits drop the breakdown."""
    at = lambda h: datetime(2026, 1, 1, h)
    call = ("main", "call")
    rows = [
        ("claude", None, "m", at(1), 1, 100, 0, 900, *call), ("claude", None, "m", at(5), 2, 900, 0, 0, *call), ("claude", "s", "m", at(1), 3, 10, 0, 990, *call), ("claude", "s", "m", at(5), 4, 700, 0, 300, *call),
        ("claude", "s", "m", at(6), 5, 50, 0, 0, "subagent", "call"), ("claude", "s", "m", None, 6, 50, 0, 0, *call), ("agy", None, "x", at(1), 7, 1000, 0, 0, *call), ("big", "s", "m", at(1), 8, 1 << 62, 0, 0, *call), ("big", "s", "m", at(2), 9, 1 << 62, 0, 0, *call),
        ("big", "s", "m", at(2), 10, 1 << 62, 0, 0, *call), ("big", "s", "m", at(2), 11, 1 << 62, 0, 0, *call),
    ]
    frame = spark.createDataFrame(rows, "provider string, session_id string, model string, at timestamp, ordinal long, input long, cache_creation long, cache_read long, source_kind string, granularity string")
    frame = frame.withColumns({"w5m": F.lit(0).cast("long"), "w1h": F.lit(0).cast("long")})
    reasons = {r.ordinal: r.reason for r in context.classify(frame).collect()}
    assert reasons == {1: "uncached", 2: "uncached", 3: "cold_start", 4: "expired", 7: "uncached", 8: "cold_start", 9: "uncached", 10: "uncached", 11: "uncached"}
    rates = {f"r_{c}": F.lit(None).cast("double") for c in ("in", "out", "read", "5m", "1h")}
    got = {r.provider: r for r in context.summary(context.classify(frame).withColumns(rates), context.others(frame).withColumns(rates)).collect()}
    c = got["claude"]
    assert (c.calls, c.context_tokens, c.cached_tokens, c.unclassified_tokens) == (4, 3950, 2190, 50)
    assert (c.band0_calls, c.band0_cached, c.cold_start_calls, c.cold_start_tokens, c.expired_calls, c.expired_tokens, c.uncached_calls, c.uncached_tokens) == (4, 219, 1, 10, 1, 700, 2, 1000)
    assert c.effective_tokens == 219 + 10 + 700 + 1000 + 50
    a = got["agy"]
    assert (a.cold_start_calls, a.expired_calls, a.uncached_tokens, a.effective_tokens) == (None, None, 1000, 1000)
    b = got["big"]
    assert b.effective_tokens == 2**64 - 1 and b.cold_start_calls is None and (b.band3_calls, b.uncached_calls, b.uncached_tokens) == (0, 0, 0) and b.context_tokens == 2**64 - 1


def test_model_labels(spark):
    cases = {
        "claude-opus-4-8": "Opus 4.8", "claude-sonnet-4-5-20250929": "Sonnet 4.5", "claude-3-5-sonnet-latest": "Sonnet 3.5", "claude-haiku": "Haiku", "anthropic/claude-fable-5": "Fable 5", "opus4-8-1-2": "Opus 4.8", "claude-3opus": "Opus 3", "claude-opus-4.8": "Opus",
        "gpt-5.5-codex-mini": "GPT 5.5 Codex Mini", "my-gpt-4": "my-gpt-4", "openai": "Codex", "codex": "Codex", "OpenAI/gpt-6.1-sol": "GPT 6.1 Sol", "Gemini 3.5 Flash (High)": "Gemini 3.5 Flash (High)", "qwen3:8b": "qwen3:8b", "org/repo": "Other", "gemini/Users/alice": "Other",
        "": "Other", None: "Other", "x" * 30: "x" * 24, "a b " + "c" * 19 + " d": "a b " + "c" * 19, "gpt-ß": "Other", "meta/": "Other",
    }
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(cases)], "i int, m string")
    got = {r.i: r.label for r in rows.select("i", labels.model_label(F.col("m")).alias("label")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
