"""Sinks: the event export and the nested summary document."""

from __future__ import annotations

import json
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.plans import reports
from meterlake.plans.adapter import WINDOW

SCHEMA_VERSION = 3
INVISIBLE = re.compile("[\x7f-\x9f؜​-‏ -‮⁠-⁤⁦-⁯﻿\U000e0000-\U000e007f]")


def export_events(events: DataFrame, path: str, kind: str = "json") -> None:
    """Writes dated events in time order, each file sorted, files in ranges of time."""
    dated = events.where("at is not null").repartitionByRange("at", "ordinal").sortWithinPartitions("at", "ordinal")
    dated.write.mode("overwrite").format(kind).save(path)


def _escape(match: re.Match) -> str:
    point = ord(match[0])
    if point < 0x10000:
        return f"\\u{point:04x}"
    point -= 0x10000
    return f"\\u{0xD800 + (point >> 10):04x}\\u{0xDC00 + (point & 0x3FF):04x}"


def dumps(document: dict) -> str:
    """Indented JSON with invisible characters escaped."""
    return INVISIBLE.sub(_escape, json.dumps(document, ensure_ascii=False, indent=2, default=str)) + "\n"


def summary_document(spark: SparkSession, sf_dir: str) -> dict:
    """The report of the window as one nested document; every part is a bounded report."""
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    return {
        "schema_version": SCHEMA_VERSION,
        "window": {"days": WINDOW.days, "start": str(WINDOW.start), "end": str(WINDOW.end)},
        "tokens": rows(reports.total_usage(spark, sf_dir))[0],
        "daily": rows(reports.daily_usage(spark, sf_dir).orderBy("d")),
        "hourly": rows(reports.hourly_profile(spark, sf_dir).orderBy("h")),
        "models": rows(reports.model_stats(spark, sf_dir)),
        "projects": rows(reports.project_stats(spark, sf_dir).orderBy(F.desc("volume"), "label")),
        "tools": rows(reports.tool_stats(spark, sf_dir).orderBy(F.desc("calls"), "tool_name")),
        "turn_length": rows(reports.turn_length(spark, sf_dir).orderBy("provider")),
        "context": rows(reports.context_merged(spark, sf_dir).orderBy("reason")),
        "parallel": rows(reports.concurrency_peak(spark, sf_dir))[0],
    }


def write_replacing(text: str, path: str) -> None:
    """Writes beside the target and renames over it."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(name, path)
