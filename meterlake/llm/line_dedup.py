"""Line dedup by site-relative frequency, in DataFrame operations only.

A site's boilerplate is every line that stands on more than ``max_ratio`` of its pages
(a line counts once for each page). Lines are compared without surrounding spaces and
identified by two 64-bit hashes. A site cannot have more boilerplate lines than
1 / max_ratio times the mean number of lines on its pages, so the list that joins the
pages is short. It is written and counted: up to ``BROADCAST_LINES`` lines are broadcast,
and pages do not move; beyond that, pages and lists are joined by site and one of
``SALTS`` salts, so a large site spreads over as many tasks.

Defined cases: null text has no lines and stays null; blank lines stay; pages of a null
site and of sites with fewer than ``min_pages`` pages are unchanged; rows repeating a
page count as pages of their own; a caller's column named like a result stays, and the
result's name gets an underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm._spark import free_name, stage_table

MAX_RATIO, MIN_PAGES = 0.1, 10
BROADCAST_LINES, SALTS = 500_000, 32  # 16 bytes a line


def _mark(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h0"), F.xxhash64(F.lit(1), line).alias("h1"))


def drop_boilerplate(pages: DataFrame, site: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """All columns of ``pages`` with boilerplate lines gone from ``text``, then n_lines, n_dropped."""
    lines = F.split(F.col(text), "\n", -1)
    bare = F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""))
    own = pages.where(F.col(site).isNotNull()).select(F.col(site).alias("__site"), bare.alias("bare"))
    totals = own.groupBy("__site").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    marks = own.select("__site", F.explode("bare").alias("line")).select("__site", _mark(F.col("line")).alias("mark"))
    counts = marks.groupBy("__site", "mark").agg(F.count("*").alias("n")).where("n > 1")
    often = counts.join(totals, "__site").where(F.col("n") > F.col("pages") * F.lit(max_ratio))
    often = stage_table(often.select("__site", "mark"), "boilerplate")
    lists = often.groupBy("__site").agg(F.collect_list("mark").alias("__often"))
    if often.count() <= broadcast_lines:
        joined = pages.join(F.broadcast(lists), F.col(site) == F.col("__site"), "left").drop("__site")
    else:
        lists = lists.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")
        joined = pages.withColumn("__salt", salt).join(lists, (F.col(site) == F.col("__site")) & (F.col("__salt") == F.col("__of")), "left").drop("__site", "__salt", "__of")
    kept = F.when(F.col("__often").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("__often", _mark(F.trim(x)))))
    made = joined.withColumn("__kept", kept)
    total = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    dropped = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).cast("long")
    columns = [F.array_join("__kept", "\n").alias(c) if c == text else F.col(c) for c in pages.columns]
    return made.select(*columns, total.alias(free_name(pages, "n_lines")), dropped.alias(free_name(pages, "n_dropped")))


HOST = r"^[a-zA-Z]+://([^/:?#]+)"
TAG = "<[^>]*>"


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, host and the text of html pages, each tag a line's end."""
    host = F.nullif(F.regexp_extract("url", HOST, 1), F.lit(""))
    return pages.select("page_id", host.alias("host"), F.regexp_replace("html", TAG, "\n").alias("text"))


ORACLE = rf"""
WITH p AS (
  SELECT row_number() OVER () AS k, page_id, nullif(regexp_extract(url, '{HOST}', 1), '') AS host, string_split(regexp_replace(html, '{TAG}', chr(10), 'g'), chr(10)) AS lines FROM pages
), totals AS (
  SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL GROUP BY host HAVING count(*) >= {MIN_PAGES}
), often AS (
  SELECT host, line FROM (SELECT DISTINCT k, host, trim(unnest(lines)) AS line FROM p) JOIN totals USING (host)
  WHERE line <> '' GROUP BY host, line, pages HAVING count(*) > 1 AND count(*) > pages * {MAX_RATIO}::double
), lists AS (SELECT host, list(line) AS bad FROM often GROUP BY host), cut AS (
  SELECT page_id, p.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(bad, trim(x))) END AS kept
  FROM p LEFT JOIN lists ON p.host = lists.host
)
SELECT page_id, host, coalesce(len(lines), 0)::bigint AS n_lines, coalesce(len(lines) - len(kept), 0)::bigint AS n_dropped, sha256(array_to_string(kept, chr(10))) AS text_sha256 FROM cut
"""
