import json
from datetime import date

from meterlake.plans import ingest, reports
from meterlake.plans.adapter import Window


def test_folders_of_two_agents_give_one_report(spark, tmp_path):
    said = lambda i, out: {"type": "assistant", "uuid": f"u{i}{out}", "timestamp": f"2026-01-0{i}T23:30:00Z", "sessionId": "s", "cwd": "/home/me/app", "message": {"id": f"m{i}", "model": "claude-opus-4-8", "content": [], "usage": {"input_tokens": 10, "output_tokens": out}}}
    done = {"timestamp": 1767312000, "params": {"update": {"sessionUpdate": "turn_completed", "prompt_id": "p", "usage": {"modelUsage": {"g1": {"inputTokens": 100, "cachedReadTokens": 30, "outputTokens": 5}}}}}}
    files = {"a/projects/-home-me-app/s.jsonl": [said(1, 1), said(1, 7), said(2, 3), said(9, 3)], "b/cwd/sess/updates.jsonl": [done, done]}
    for name, rows in files.items():
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)) + "\n{bad\n", encoding="utf-8")
    window = Window(date(2026, 1, 1), date(2026, 1, 3), date(2025, 12, 29))
    roots = {"claude": [str(tmp_path / "a")], "grok": [str(tmp_path / "b")]}
    stream = ingest.usage_stream(spark, roots, "/home/me", window, offset_seconds=3600)
    # an hour east the evening of the first is the second; the replayed records count once
    daily = {str(r.d): (r.input, r.output, r.volume) for r in reports.daily_usage(spark, stream).collect()}
    assert daily == {"2026-01-01": (0, 0, 0), "2026-01-02": (80, 12, 122), "2026-01-03": (10, 3, 13)}
    models = {r.model: (r.events, r.volume, r.usd, r.unpriced_volume) for r in reports.model_stats(spark, stream).collect()}
    assert models == {"claude-opus-4-8": (2, 30, 0.00035, 0), "g1": (1, 105, None, 105)}
