import json
from datetime import date

from meterlake.plans import documents, streams
from meterlake.plans.adapter import Window


def test_a_session_as_one_document(spark, tmp_path):
    def row(i, at, kind, content, **message):
        return json.dumps({"type": kind, "uuid": f"u{i}", "timestamp": f"2026-01-02T{at}Z", "sessionId": "c1", "cwd": "/home/me/app", "attributionSkill": "pdf", "message": {"id": f"m{i}", "model": "claude-opus-4-8", "content": content, **message}})

    usage = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 20}
    tool = [{"type": "tool_use", "id": "t1", "name": "Agent", "input": {"subagent_type": "Explore"}}]
    lines = [row(1, "10:00:00", "user", "go"), row(2, "10:00:40", "assistant", tool, usage=usage), row(3, "10:02:00", "user", "more"), row(4, "10:25:00", "assistant", [], usage=usage), row(5, "10:26:00", "user", "again")]
    frame = spark.createDataFrame([("/logs/projects/-x/c1.jsonl", {"block": 0, "n": n}, x) for n, x in enumerate(lines)], "path string, pos struct<block:long,n:long>, line string")
    stream = streams.from_lines({"claude": frame}, "/home/me", Window(date(2026, 1, 1), date(2026, 1, 10), date(2025, 12, 22)))
    documents.write_session_documents(spark, stream, str(tmp_path / "out"))
    (text,) = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert json.loads(text) == {
        "schema_version": 3, "session": {"id": "c1", "first_at": "2026-01-02T10:00:00.000000", "last_at": "2026-01-02T10:26:00.000000"},
        "total": {
            "cost": {"estimated_usd": 0.0007, "unpriced_tokens": 0},
            "working_time": {"active_ms": 1_420_000, "human_wait_ms": 0, "model_share": 1.0, "measured_ms": 1_420_000, "pace": {"gaps": 1, "p50_ms": 80_000, "p90_ms": 80_000, "mean_ms": 80_000}},
            "turn_length": {"turns": 2, "p50_ms": 40_000, "p90_ms": 1_380_000, "max_ms": 1_380_000, "long_from_ms": 1_200_000, "long_turns": 1, "lengths_ms": [40_000, 1_380_000]},
            "context": {"cached_share": 0.769231, "expired": {"calls": 0}, "cold_start": {"calls": 1}}, "tools": [{"name": "Agent", "calls": 1}], "subagents": [{"name": "Explore", "calls": 1}], "skills": [{"name": "pdf"}], "models": [{"label": "Opus 4.8", "share": 1.0}],
        },
    }
    assert documents.session_documents(spark, stream._replace(window=Window(date(2025, 1, 1), date(2025, 1, 2), date(2024, 12, 30)))).count() == 0
