import json
import os
import random
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from meterlake.plans.agy_logs import encode, number
from meterlake.sources import agy, wire
from pyspark.sql import functions as F


def first(message, field, kind):
    """The reader's rules, byte by byte."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(message):
                return None
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value & (2**64 - 1)
            shift += 7
            if shift >= 64:
                return None

    while at < len(message):
        tag = varint()
        if tag is None:
            return None
        if tag & 7 == 0:
            value = varint()
            if value is None:
                return None
            found = "number"
        elif tag & 7 in (1, 5):
            at += 8 if tag & 7 == 1 else 4
            if at > len(message):
                return None
            value, found = 0, "number"
        elif tag & 7 == 2:
            size = varint()
            if size is None or at + size > len(message):
                return None
            value, found = message[at : at + size], "part"
            at += size
        else:
            return None
        if tag >> 3 == field and found == kind:
            return value
    return None


def test_reader_equals_a_walk():
    rng = random.Random(8)
    messages = [b"", None, b"\x80" * 12, number(1 << 3) + b"\xff" * 9 + b"\x01", number(1 << 3) + b"\xff" * 10 + b"\x01", number(2 << 3 | 2) + number(2**63) + b"x", number(2 << 3 | 2) + number(2**64 - 1)]
    for _ in range(3000):
        parts = [(rng.randint(1, 4), rng.choice([rng.randrange(1 << rng.choice([3, 20, 63])), rng.randbytes(rng.randint(0, 12))])) for _ in range(rng.randint(0, 6))]
        body = encode(parts) + rng.choice([b"", number(3 << 3 | 1) + bytes(8), number(3 << 3 | 5) + bytes(4), number(9 << 3 | 3), b"\x80"]) + encode(parts[:2])
        messages.append(body[: rng.randint(0, len(body))] if rng.random() < 0.3 else body)
    messages += [rng.randbytes(rng.randint(0, 20)) for _ in range(2000)]
    got, parts = wire.fields(wire.spans(pa.array(messages, pa.binary())[3:]), (1, 2, 3), (1, 2, 4))
    for i, m in enumerate(messages[3:]):
        for f in (1, 2, 3):
            value = first(m or b"", f, "number")
            assert (int(got[f][0][i]) if got[f][1][i] else None) == value, (m, f)
        for f in (1, 2, 4):
            s = parts[f]
            assert (s.data[s.start[i] : s.end[i]].tobytes() if s.known[i] else None) == first(m or b"", f, "part"), (m, f)
    assert wire.texts(wire.Spans(np.frombuffer(b"ok\xffbad", np.uint8), np.array([0, 2, 0]), np.array([2, 6, 2]), np.array([True, True, False]))).to_pylist() == ["ok", None, None]


def stamp(ms):
    return [(1, ms // 1000), (2, ms % 1000 * 1_000_000)]


def gen(text=30, think=12, total=None, system=5, fresh=100, cache=7, rid=None, ms=None, served=None, shown=None, picked=None):
    usage = [(1, system), (2, fresh), (3, text + think if total is None else total), (5, cache), (9, text), (10, think), (11, rid)]
    return encode([(1, [(4, usage), (9, [(4, stamp(ms))] if ms else None), (19, served), (21, shown)]), (3, [(28, picked)] if picked else None)])


@pytest.fixture
def conversation(tmp_path):
    def make(name, rows, steps=(), head=None):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        db = sqlite3.connect(path)
        db.execute("CREATE TABLE gen_metadata(idx INT, data BLOB)")
        db.execute("CREATE TABLE steps(idx INT, metadata BLOB)")
        db.execute("CREATE TABLE trajectory_metadata_blob(id TEXT, data BLOB)")
        db.executemany("INSERT INTO gen_metadata VALUES (?, ?)", rows)
        db.executemany("INSERT INTO steps VALUES (?, ?)", steps)
        if head:
            db.execute("INSERT INTO trajectory_metadata_blob VALUES ('x', ?)", (head,))
        db.commit()
        db.close()
        os.utime(path, (1_700_000_000, 1_700_000_000))
        return str(path)

    return make


DAY = 1_750_000_000_000


def test_generations_of_two_roots(spark, conversation):
    step = lambda i, ms, rid: (i, encode([(1, stamp(ms)), (9, [(11, rid)])]))
    head = encode([(1, [(1, "file:///home/me/app")]), (2, stamp(DAY))])
    cli = conversation("cli/conversations/c1.db", [
        (0, gen(ms=DAY + 5, rid="a", shown="Gemini (High)")), (1, gen(rid="b", served="flash-n", picked="flash-high")), (2, gen(served="flash")), (3, gen(total=1)), (4, gen(text=0, think=0, system=0, fresh=0, cache=0)), (5, encode([(1, [(4, [(1, 5)])])])),
        (6, b"\x80"), (7, gen(rid="d", ms=32_503_680_000_001)), (8, gen(rid=" ", served="other-n")), (9, None), (10, gen(text=2**63 + 5, think=0, total=2**63 - 1)),
    ], [step(3, DAY + 90, "b"), step(2, DAY + 80, "b"), step(4, 0, "d"), (5, None)], head)
    app = conversation("app/conversations/c1.db", [(0, gen(rid="a")), (1, gen(rid="b", ms=DAY + 7, fresh=1)), (2, gen(rid="e"))])
    told = agy.read_conversations(spark, [[cli], [app]])
    got = {r.dedupe_key: (r.session_id, r.evidence, r.ms, r.model, r.project, r.input, r.output) for r in agy.usage_events(told, "/home/me").withColumn("ms", F.unix_millis("at")).collect()}
    assert got == {
        "a": ("c1", 3, DAY + 5, "Gemini (High)", "app", 105, 42), "b": ("c1", 3, DAY + 7, None, None, 6, 42), "c1#2": ("c1", 1, DAY, "flash", "app", 105, 42), "d": ("c1", 1, DAY, None, "app", 105, 42), "e": ("c1", 0, 1_700_000_000_000, None, None, 105, 42),
        "c1#8": ("c1", 1, DAY, "other-n", "app", 105, 42), "c1#10": ("c1", 1, DAY, None, "app", 105, 2**63 - 1),
    }
    s = agy.scan_stats(told).first()
    assert (s.rows, s.parse_errors, s.cut_stores) == (14, 2, 0)
    # without the second root's stamp the first step of the response counts, and the served tag folds into the selection
    alone = {r.dedupe_key: r for r in agy.usage_events(agy.read_conversations(spark, [[cli]]), "/home/me").withColumn("ms", F.unix_millis("at")).collect()}
    assert (alone["b"].evidence, alone["b"].ms, alone["b"].model) == (2, DAY + 80, "flash")


def test_history_and_logs(spark):
    history = [{"timestamp": 1_750_000_000_999, "conversationId": "c"}, {"timestamp": 1_750_000_001_000}, {"timestamp": "x"}, {"timestamp": -5, "conversationId": "c"}]
    rows = [("/r/history.jsonl", {"block": 0, "n": n}, x if isinstance(x, str) else json.dumps(x)) for n, x in enumerate(["", *history, "{"])]
    shape = "path string, pos struct<block:long,n:long>, line string"
    got = sorted((r.session_id, r.s) for r in agy.history_touches(spark.createDataFrame(rows, shape)).withColumn("s", F.unix_seconds("at")).collect())
    assert got == [("c", 1_750_000_000), ("history:3", 1_750_000_001)]
    lines = [
        'I0609 11:27:22.646388  8577 a.go:34] HandleUserInput called with text: "x"', "I0609 11:27:23.5 1 a.go:1] Responding to tool confirmation convID=abc, command( git status )", "I0609 11:27:24 1 Responding to tool confirmation", "I0609 11:27:25.1 HandleUserInput called with text",
        "I0230 11:27:25.1 HandleUserInput called with text", "I0609 11:60:25.1 HandleUserInput called with text", "I0609 11:27:60.1 HandleUserInput called with text", "I06099 11:27:25.1 HandleUserInput called with text", "I0609 11:27:25.1234567 HandleUserInput called with text", "I0609", "",
        "I0610 00:10:00.000001 Responding to tool confirmation convID= command() convID=zzz", "I0610 00:10:01.000001 Responding to tool confirmation convID=next x command(unclosed",
    ]
    rows = [(p, {"block": 0, "n": n}, x) for p in ("/r/log/cli-20260609_1.log", "/r/log/other.log") for n, x in enumerate(lines)]
    found = agy.log_rows(spark.createDataFrame(rows, shape), 3600).withColumn("us", F.unix_micros("at")).orderBy("pos").collect()
    begin = 1_780_999_200_000_000  # 2026-06-09 10:00 UTC, 11:00 an hour east
    at = lambda minute, second, micro=0: begin + (minute * 60 + second) * 1_000_000 + micro
    assert [(r.us, r.session_id, r.tool_name) for r in found] == [
        (at(27, 22, 646388), "cli-20260609_1", None), (at(27, 23, 5), "abc", "command:git"), (at(27, 24), "abc", "ToolConfirmation"), (at(27, 25, 1), "abc", None), (at(770 + 20, 0, 1), "abc", "ToolConfirmation"), (at(770 + 20, 1, 1), "next", "ToolConfirmation"),
    ]
    assert agy.log_tools(agy.log_rows(spark.createDataFrame(rows, shape))).count() == 4
