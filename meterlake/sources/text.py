"""Line sources: JSON lines as variants, with their place in the file."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.scalar import ID_BYTES

# The longest line in bytes, and the most structural bytes of a line.
LINE_BYTES, STRUCTURE = 64 << 20, 262_144


def read_lines(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl", since: datetime | None = None, most: int = LINE_BYTES, tolerant: bool = False) -> DataFrame:
    """path, pos and line of every text file below ``roots`` (``.zst`` and ``.gz`` by extension).

    ``pos`` orders the lines of a file: the block they were read from, then their order in
    it. A file may be read by several tasks, and no task needs it whole. The record reader
    passes over a line of more than ``most`` bytes while reading it, so that it is never in
    memory whole; at the end of a block the head of such a line is dropped after the read, and
    its tail may be left, which no JSON parser takes. ``tolerant`` ends a file at a read error (a broken frame) instead of failing;
    ``files.census`` counts both kinds of losses.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").option("ignoreCorruptFiles", tolerant)
    # the limit of the reader counts the line's end and is itself too long
    reader = reader.option("mapreduce.input.linerecordreader.line.maxlength", most + 2)
    if since is not None:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    lines = reader.text(roots)
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return lines.where(F.octet_length("value") <= most).select(F.col("_metadata.file_path").alias("path"), pos.alias("pos"), F.rtrim(F.col("value"), F.lit("\r")).alias("line"))


def bounded_json(line: Column) -> Column:
    """The variant of a JSON text: null if blank, overlong, overly nested or malformed."""
    # two plain passes: one pattern for escapes and strings recurses for each character of a long text
    bare = F.regexp_replace(F.regexp_replace(line, r"\\[\s\S]", ""), '"[^"]*"', "")
    marks = F.length(bare) - F.length(F.translate(bare, "[]{},:", ""))
    # a line of no more bytes than marks are allowed needs no count
    plain = (F.octet_length(line) <= STRUCTURE) | ((F.octet_length(line) <= LINE_BYTES) & (marks <= STRUCTURE))
    return F.when(plain & (F.trim(line) != ""), F.try_parse_json(line))


def parse(lines: DataFrame) -> DataFrame:
    """Adds the variant ``v``: null for blank, overlong, overly nested and malformed lines."""
    # a list of one as rows: a filter on the variant then stays above it, so that no line is parsed twice
    return lines.select("*", F.explode_outer(F.array(bounded_json(F.col("line")))).alias("v"))


def scan_stats(parsed: DataFrame) -> DataFrame:
    """Files, lines and lines that are neither blank nor readable."""
    return parsed.agg(F.countDistinct("path").alias("files"), F.count("*").alias("lines"), F.count_if(F.col("v").isNull() & (F.trim("line") != "")).alias("parse_errors"))


def prefer_plain(files: DataFrame) -> DataFrame:
    """One physical file for each logical path: plain before ``.zst``, then the larger."""
    packed = F.col("path").endswith(".zst").cast("int")
    logical = F.regexp_replace("path", r"\.zst$", "")
    order = F.struct(packed, -F.col("size"), F.col("path"))
    return files.groupBy(logical.alias("logical")).agg(F.min_by("path", order).alias("path"))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text_at(v: Column, path: str, most: int = ID_BYTES) -> Column:
    """A non-empty JSON string, null when longer than ``most`` bytes; other types are no text."""
    value = F.try_variant_get(v, path, "string")
    # the type costs more than the value, so it is asked once, and only of values that may stay
    return F.when(F.octet_length(value).between(1, most) & (_kind(v, path) == "STRING"), value)


def plain_text_at(v: Column, path: str) -> Column:
    """A JSON string of any length."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def count_at(v: Column, path: str) -> Column:
    """A JSON integer from 0 to 2**63 - 1; fractions, texts and negatives are none."""
    value = F.try_variant_get(v, path, "bigint")
    return F.when((value >= 0) & (_kind(v, path) == "BIGINT"), value)


def long_at(v: Column, path: str) -> Column:
    """A JSON integer that a long holds, negative ones too."""
    return F.when(_kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def number_at(v: Column, path: str) -> Column:
    numeric = _kind(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(v, path, "double"))


def flag_at(v: Column, path: str) -> Column:
    return F.coalesce(F.when(_kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False))


def array_at(v: Column, path: str) -> Column:
    """The elements of a JSON array as variants, else null."""
    return F.try_variant_get(v, path, "array<variant>")
