"""Turns of a transcript, cut by window sums over prompts, silences and interrupts.

All order-dependent facts are running sums and maxima along a file, in DataFrame operations:

* a *span* begins with every new human prompt and every interrupt (running count);
* a *stretch* of a span ends where the next row comes more than 30 minutes after the latest
  instant before it (running maximum);
* a stretch has one turn at most: from its human prompt; where it has none, from the first
  generated prompt or late answer. Rows before that belong to no turn.

A question is open from its first sighting to its first answer in the span. Waiting is the
union of a turn's open questions, clipped to the turn; model time is the sum of the gaps that
end in an assistant row while no question is open. Prompts whose uuid occurred before are
copies: human ones fall away, generated ones open nothing. Rows without time fall away,
interrupts excepted. A turn that nobody answered, or without length, is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.tables import stored
from meterlake.operators.sequence import union_length

# Fixed value: silence that ends a turn, in microseconds.
SILENCE = 30 * 60 * 1_000_000
SPAN, STRETCH = ["path", "span"], ["path", "span", "stretch"]


def _upto(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _stretches(rows: DataFrame) -> DataFrame:
    """Rows with their span and stretch; copies of prompts removed."""
    rows = rows.where(F.col("at").isNotNull() | _is("interrupt")).withColumn("at", F.when(~_is("interrupt"), F.col("at")))
    prompt = _is("human", "generated") & F.col("uuid").isNotNull()
    rows = rows.withColumn("prompt", prompt).withColumn("copies", F.count("*").over(_upto(["path", "prompt", "uuid"])))
    copied = F.col("prompt") & (F.col("copies") > 1)
    rows = rows.where(~(copied & _is("human"))).withColumn("kind", F.when(copied, "other").otherwise(F.col("kind"))).drop("prompt", "copies")
    rows = rows.withColumn("span", F.count_if(_is("human", "interrupt")).over(_upto(["path"])))
    rows = rows.withColumn("by_prompt", F.max(_is("human")).over(Window.partitionBy(*SPAN)))
    late = F.col("at") - F.max("at").over(_before(SPAN)) > SILENCE
    return rows.withColumn("late", F.coalesce(late, F.lit(False))).withColumn("stretch", F.count_if("late").over(_upto(SPAN))).drop("late")


def _questions(rows: DataFrame) -> DataFrame:
    """Each question asked within a turn: where, when, and its first answer in the span."""
    begun = F.count_if(_is("generated") | (F.size("answered") > 0)).over(_before(STRETCH)) > 0
    seen = rows.withColumn("begun", begun | (F.col("by_prompt") & (F.col("stretch") == 0)))
    asked = seen.select(*STRETCH, "pos", "at", "begun", F.explode("asked").alias("id"))
    asked = asked.withColumn("nth", F.row_number().over(Window.partitionBy("path", "id").orderBy("pos"))).where("nth = 1 and begun").drop("nth", "begun")
    answers = rows.select(*SPAN, F.col("pos").alias("answer_pos"), F.col("at").alias("answer_at"), F.col("stretch").alias("answer_stretch"), F.explode("answered").alias("id"))
    both = asked.join(answers, [*SPAN, "id"], "left").where("answer_pos is null or answer_pos > pos")
    first = F.min(F.struct("answer_pos", "answer_at", "answer_stretch")).alias("x")
    one = both.where("answer_pos is not null").groupBy(*SPAN, "id").agg(first).select(*SPAN, "id", "x.*")
    return asked.join(one, [*SPAN, "id"], "left")


def _members(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """The rows of turns: with their turn's first place and the number of questions open before them."""
    opened = questions.select("path", "pos", F.lit(1).alias("opens"), F.lit(0).alias("closes"))
    closed = questions.where("answer_pos is not null").select("path", F.col("answer_pos").alias("pos"), F.lit(0), F.lit(1))
    marks = opened.union(closed).groupBy("path", "pos").agg(F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))
    rows = rows.join(marks, ["path", "pos"], "left").na.fill(0, ["opens", "closes"])
    rows = rows.withColumn("open", F.coalesce(F.sum(F.col("opens") - F.col("closes")).over(_before(SPAN)), F.lit(0)))
    begins = _is("human") | ~(F.col("by_prompt") & (F.col("stretch") == 0)) & (_is("generated") | (F.col("closes") > 0))
    whole = Window.partitionBy(*STRETCH)
    rows = rows.withColumn("first", F.min(F.when(begins, F.struct("pos", "kind", "open"))).over(whole)).where(F.col("pos") >= F.col("first.pos"))
    # a generated prompt that opens a turn ends all older questions
    fresh = F.when(F.col("first.kind") == "generated", F.col("first.open")).otherwise(0)
    rows = rows.withColumn("open", F.col("open") - fresh)
    gap = F.col("at") - F.max("at").over(_before(STRETCH))
    return rows.withColumn("model", F.when(_is("assistant") & (F.col("open") <= 0) & (gap > 0), F.floor(gap / 1000)))


def turns(rows: DataFrame) -> DataFrame:
    """Turns and paces of ``rows`` (see the decoder's turn_rows): path, event, key, session_id, end_us, duration_ms, wait_ms, model_ms, status."""
    rows = stored(_stretches(rows))  # read by each of the parts below
    questions = stored(_questions(rows))
    known = F.max_by("session_id", F.when(F.col("session_id").isNotNull(), F.col("pos"))).over(_upto(SPAN))
    members = _members(rows.withColumn("session_id", F.coalesce("session_id", known)), questions)
    at_first = lambda c: F.min_by(c, "pos").alias(c)
    found = stored(members.groupBy(*STRETCH).agg(
        at_first("kind"), at_first("uuid"), at_first("session_id"), at_first("compact"), F.min("pos").alias("pos"), F.min_by("at", "pos").alias("start"), F.max("at").alias("last"),
        F.max(_is("assistant")).alias("answered"), F.sum("model").alias("model_ms"),
    ))
    asked = questions.select(*SPAN, F.col("stretch").alias("from"), F.coalesce("answer_stretch", F.lit(1 << 60)).alias("to"), F.col("at").alias("asked_at"), "answer_at")
    carried = ~_is("human", "generated") & (F.col("from") < F.col("stretch"))
    waits = found.join(asked, SPAN).where(((F.col("from") == F.col("stretch")) | carried) & (F.col("stretch") <= F.col("to")))
    begin, end = F.greatest("asked_at", "start"), F.least(F.coalesce("answer_at", "last"), "last")
    waits = waits.where(end > begin).groupBy(*STRETCH).agg(F.collect_list(F.struct(begin.alias("start"), end.alias("end"))).alias("spans"))
    full = found.join(waits, STRETCH, "left")
    took = F.floor((F.col("last") - F.col("start")) / 1000)
    wait = F.when(F.col("spans").isNotNull(), F.floor(union_length(F.col("spans")) / 1000)).otherwise(0)
    done = full.where((F.col("answered") | F.col("compact")) & (took > 0)).select(
        *STRETCH, F.lit("turn").alias("event"), F.concat(F.lit("claude-turn:"), "uuid").alias("key"), "session_id", F.col("last").alias("end_us"), took.alias("duration_ms"),
        F.least(wait, took).alias("wait_ms"), F.least(F.coalesce("model_ms", F.lit(0)), took).alias("model_ms"), F.when(_is("generated"), "generated").otherwise("turn").alias("status"),
    )

    # an interrupt discards the turn that is open; a human prompt comes after its end
    final = rows.groupBy(*SPAN).agg(F.max("stretch").alias("stretch"))
    ended = rows.where(_is("interrupt")).select("path", (F.col("span") - 1).alias("span"))
    done = done.join(final.join(ended, SPAN, "left_semi"), STRETCH, "left_anti").drop("span", "stretch")
    open_ = found.join(final, STRETCH, "left_semi").select("path", (F.col("span") + 1).alias("span"), "last")
    gap = F.col("at") - F.col("last")
    paces = rows.where(_is("human")).join(open_, SPAN).where((gap > 0) & (gap <= SILENCE))
    none = F.lit(None)
    paces = paces.select("path", F.lit("pace").alias("event"), F.concat(F.lit("claude-pace:"), "uuid").alias("key"), "session_id", F.col("at").alias("end_us"), F.floor(gap / 1000), none.cast("long"), none.cast("long"), none.cast("string"))
    return done.union(paces)


def durations(found: DataFrame) -> DataFrame:
    return found.where("event = 'turn'").select(F.timestamp_micros("end_us").alias("at"), "session_id", "duration_ms", "wait_ms", "model_ms", "status", F.col("key").alias("dedupe_key"))


def paces(found: DataFrame) -> DataFrame:
    return found.where("event = 'pace'").select(F.timestamp_micros("end_us").alias("at"), F.col("duration_ms").alias("gap_ms"), F.col("key").alias("dedupe_key"))
