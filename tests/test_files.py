import json
import os

import pytest
import zstandard
from meterlake.plans import streams
from meterlake.sources import files, text

ROW = json.dumps({"a": "x" * 40})


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def names(frame, column="path"):
    return sorted(r[column].rsplit("/", 1)[1] for r in frame.collect())


def test_overlong_lines_are_passed_over_and_counted(spark, tmp_path):
    put(tmp_path / "in/a.jsonl", f"{ROW}\n{'y' * 5000}\n{ROW}\r\n\n  \n{'z' * 100}\n{'w' * 101}")
    put(tmp_path / "in/b.jsonl", "")
    got = [r.line for r in text.read_lines(spark, [str(tmp_path / "in")], most=100).orderBy("path", "pos").collect()]
    assert got == [ROW, ROW, "", "  ", "z" * 100]
    found = {r.path.rsplit("/", 1)[1]: r for r in files.census(files.listed(spark, [str(tmp_path / "in")], "*.jsonl"), most=100).collect()}
    assert tuple(found["a.jsonl"])[1:] == (7, 2, 2, None) and list(found) == ["a.jsonl"]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_census_does_not_depend_on_chunks(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(files, "CHUNK", chunk)
    body = f"{ROW}\n\r\n{' ' * 20}\n{' ' * 101}\n{'q' * 100}\r\n{'q' * 99}\r\nend".encode()
    lines = body.split(b"\n")
    want = (len(lines), sum(not x.strip(b" \r") and len(x) <= 100 for x in lines), sum(len(x) > 100 for x in lines), None)
    put(tmp_path / "plain.jsonl", body)
    put(tmp_path / "packed.jsonl.zst", zstandard.compress(body[:50]) + zstandard.compress(body[50:]))
    assert files._count(str(tmp_path / "plain.jsonl"), 100) == want == files._count(str(tmp_path / "packed.jsonl.zst"), 100)


def test_census_of_what_cannot_be_read(tmp_path):
    packed = zstandard.compress((ROW + "\n").encode() * 9)
    put(tmp_path / "broken.jsonl.zst", packed + b"no frame")
    lines, _, _, problem = files._count(str(tmp_path / "broken.jsonl.zst"), 100)
    assert problem and lines <= 9
    os.mkfifo(tmp_path / "pipe.jsonl")
    assert files._count(str(tmp_path / "pipe.jsonl"), 100) == (0, 0, 0, "not a regular file")
    assert files._count(str(tmp_path / "none.jsonl"), 100)[3]
    with pytest.raises(ValueError, match="mounted"):
        files._count("s3a://x/y.jsonl", 100)


def test_one_copy_of_each_rollout(spark, tmp_path):
    top = tmp_path / "agent of mine"
    put(top / "sessions/2026/a.jsonl", ROW)
    put(top / "sessions/2026/a.jsonl.zst", zstandard.compress(ROW.encode() * 50))
    put(top / "archived_sessions/2026/a.jsonl", ROW + "\n" + ROW)  # the larger plain one
    put(top / "archived_sessions/a.jsonl", ROW)  # another inner path
    put(top / "archived_sessions/b.jsonl.zst", zstandard.compress(ROW.encode()))
    roots = files.with_archives(spark, [str(top / "sessions")])
    assert len(roots) == 2 and files.with_archives(spark, [str(top)]) == [str(top)]
    found = files.listed(spark, roots, "*.jsonl*")
    assert sorted(r.inner for r in found.collect()) == ["2026/a.jsonl", "2026/a.jsonl", "2026/a.jsonl.zst", "a.jsonl", "b.jsonl.zst"]
    gone = files.second_copies(found)
    assert {"/".join(r.path.split("/")[-3:]) for r in gone.collect()} == {"sessions/2026/a.jsonl", "sessions/2026/a.jsonl.zst"}
    lines = streams.rollout_lines(spark, [str(top / "sessions")])
    assert lines.count() == 4
    # files that a condition names are not opened at all; beyond the bound they are joined away
    assert lines.select("path").distinct().count() == 3 and len(lines.inputFiles()) == 5
    all_lines = text.read_lines(spark, roots, "*.jsonl*")
    assert files.without(all_lines, gone, named=1).count() == 4
    assert files.without(all_lines, gone.limit(0)) is all_lines


def test_scan_summary(spark, tmp_path):
    said = {"type": "assistant", "uuid": "u", "timestamp": "2026-01-01T10:00:00Z", "sessionId": "s", "message": {"id": "m", "model": "claude-x", "role": "assistant", "content": [], "usage": {"input_tokens": 1, "output_tokens": 1}}}
    put(tmp_path / "c/projects/p/a.jsonl", f"{json.dumps(said)}\n{{bad\n\n" + '{"pad":"' + "x" * (text.LINE_BYTES + 1) + '"}\n' + json.dumps({**said, "uuid": "v", "message": {**said["message"], "id": "n"}}) + "\n")
    put(tmp_path / "c/projects/claude-mem-observer/b.jsonl", "{bad\n")
    put(tmp_path / "x/sessions/r.jsonl.zst", zstandard.compress((ROW + "\n").encode() * 3)[:-4] + b"????")
    put(tmp_path / "x/sessions/t.jsonl", ROW + "\n")
    put(tmp_path / "x/sessions/t.jsonl.zst", b"never opened")
    roots = {"claude": [str(tmp_path / "c")], "codex": [str(tmp_path / "x/sessions")], "opencode": [str(tmp_path)]}
    stream = streams.read(spark, roots, "/home/me", None, tolerant=True)
    got = {r.provider: r for r in streams.scan_summary(spark, roots, stream.events).collect()}
    claude = got["claude"]
    assert (claude.files, claude.lines, claude.parse_errors, claude.unreadable_files, claude.usage_events) == (1, 5, 2, 0, 2)
    codex = got["codex"]
    assert codex.files == 2 and codex.unreadable_files == 1 and codex.parse_errors >= 1
    assert got[None].files == 3 and got[None].usage_events == 2 and got[None].parse_errors == 2 + codex.parse_errors
