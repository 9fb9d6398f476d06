"""Column functions shared by the decoders and the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length bounds in bytes, the counter clamp, the largest unsigned counter.
ID_BYTES, PATH_BYTES = 1024, 4096
COUNTER_MOST = 1 << 50
U64_MOST = 18446744073709551615


def bounded(text: Column, most: int = ID_BYTES) -> Column:
    """Null when the text is longer than ``most`` bytes."""
    return F.when(F.octet_length(text) <= most, text)


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clamp_counter(value: Column) -> Column:
    """Missing and negative counters are 0, large ones are cut."""
    return F.least(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)), F.lit(COUNTER_MOST)).cast("long")


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("long"))


def saturating_sum(value: Column) -> Column:
    """Sum of non-negative counters that stops at the largest unsigned 64-bit number; null without any."""
    total, most = F.sum(value.cast("decimal(20,0)")), F.lit(str(U64_MOST)).cast("decimal(38,0)")
    return F.when(total < most, total.cast("decimal(38,0)")).when(total.isNotNull(), most)


def plausible(instant: Column) -> Column:
    """Null outside [1970, 3000)."""
    begin, end = (F.lit(f"{year}-01-01T00:00:00Z").cast("timestamp") for year in (1970, 3000))
    # a list of one, so that a parsed text is parsed once and not for each comparison
    return F.get(F.filter(F.array(instant), lambda t: (t >= begin) & (t < end)), F.lit(0))


def parse_instant(text: Column) -> Column:
    """RFC 3339 text to a timestamp; null if malformed or implausible."""
    # the common form, in years that no offset makes implausible, needs no other step
    common = text.rlike(r"^(19[89]\d|2[0-8]\d\d)-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)$")
    shaped = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), text)
    # Spark keeps microseconds
    trimmed = F.regexp_replace(shaped, r"(\.\d{6})\d+", "$1")
    return F.when(common, F.try_to_timestamp(text)).otherwise(plausible(F.try_to_timestamp(F.translate(trimmed, "tz", "TZ"))))


def from_millis(value: Column) -> Column:
    most = 32503680000000
    return F.when((value >= 0) & (value < most), F.timestamp_millis(value))


def from_seconds(value: Column) -> Column:
    return from_millis(F.when((value >= 0) & (value < 32503680000), value * 1000))


def local_time(instant: Column, offset_seconds: int) -> Column:
    """The instant in a fixed offset, as a zone-free timestamp that no session zone can shift."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant) + offset_seconds * 1_000_000, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def normalize_model(model: Column) -> Column:
    """Lower case, cut at ``[`` and ``(``, runs of white space to one hyphen."""
    cut = F.split_part(F.split_part(F.lower(model), F.lit("["), F.lit(1)), F.lit("("), F.lit(1))
    return F.regexp_replace(F.trim(cut), r"\s+", "-")


def project_from_cwd(cwd: Column, home: str) -> Column:
    """The path below the home folder; the home folder itself is ``~``."""
    plain = home.rstrip("/\\")
    below = F.when(cwd == plain, F.lit("")).when(cwd.startswith(plain + "/") | cwd.startswith(plain + "\\"), F.substr(cwd, F.lit(len(plain) + 1))).otherwise(cwd)
    trimmed = F.regexp_replace(below, r"^[/\\]+", "")
    return F.when(trimmed == "", "~").otherwise(trimmed)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def nearest_rank(column: str, percent: int) -> Column:
    """The value at rank ceil(n * percent / 100), counted from 1; no interpolation."""
    return F.expr(f"CAST(percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {column}) AS BIGINT)")


def strip_invisible(text: Column) -> Column:
    """Without control, zero-width, direction and tag characters."""
    return F.regexp_replace(text, "[\\x00-\\x1f\\x7f-\\x9f\\u061c\\u200b-\\u200f\\u2028-\\u202e\\u2060-\\u2064\\u2066-\\u206f\\ufeff\\x{e0000}-\\x{e007f}]", "")


def heat_level(value: Column, q1: Column, q2: Column, q3: Column) -> Column:
    above = lambda q: F.when(value > q, 1).otherwise(0)
    return F.when(value == 0, 0).otherwise(1 + above(q1) + above(q2) + above(q3))
