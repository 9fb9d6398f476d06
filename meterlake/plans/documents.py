"""Nested session documents, one for each session of a window, assembled and written by Spark.

Every part is an aggregate by provider and session, so the parts meet by joins on that key and
nothing passes through the driver; the documents are text, one a row, for any text writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.labels import model_label
from meterlake.functions.scalar import ratio
from meterlake.operators import context, pricing
from meterlake.plans.adapter import Stream, in_window, kind_of, usage_events, window_of

SCHEMA_VERSION = 3
# Fixed value: turns of this length on count as long, in milliseconds.
LONG_TURN = 20 * 60_000
KEY = ["provider", "session_id"]


def _listed(rows: DataFrame, order: list[Column], shown: Column, name: str) -> DataFrame:
    """The rows of each session as an array in ``order``."""
    ranked = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], shown.alias("x")))).alias("a"))
    return ranked.select(*KEY, F.transform("a", lambda r: r["x"]).alias(name))


def _rank(lengths: Column, percent: int) -> Column:
    """The value at rank ceil(n * percent / 100) of a sorted array."""
    return F.get(lengths, (F.ceil(F.size(lengths) * percent / 100) - 1).cast("int"))


def _paces(source: str | Stream, spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Pauses before the prompts that open a session's turns, of the first provider alone."""
    if not isinstance(source, Stream):
        return turns.select(*KEY).where("false").withColumn("pace", F.lit(None).cast("array<bigint>"))
    starts = turns.where("provider = 'claude'").select("provider", "session_id", F.timestamp_add("MILLISECOND", -F.col("duration_ms"), F.col("at")).alias("at")).distinct()
    paces = in_window(kind_of(spark, source, "pace"), window_of(source)).select("provider", "at", "gap_ms")
    return paces.join(starts, ["provider", "at"]).groupBy(*KEY).agg(F.sort_array(F.collect_list("gap_ms")).alias("pace"))


def session_structs(spark: SparkSession, source: str | Stream) -> DataFrame:
    """provider, session_id and ``document``, a struct, for each session with an event in the window."""
    usage, prices, window = usage_events(spark, source).where("session_id is not null"), pricing.price_table(spark), window_of(source)
    w = in_window(usage, window)
    tools, touches, turns = (in_window(kind_of(spark, source, k), window).where("session_id is not null") for k in ("tool", "touch", "turn"))
    every = w.select(*KEY, "at")
    for part in (tools, touches, turns):
        every = every.union(part.select(*KEY, "at"))
    bounds = every.groupBy(*KEY).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    cost = pricing.with_cost(w, prices).groupBy(*KEY).agg(F.sum("volume").alias("volume"), *pricing.tally())
    labels = w.where("volume > 0").groupBy(*KEY, "model").agg(F.sum("volume").alias("v")).groupBy(*KEY, model_label(F.col("model")).alias("label")).agg(F.sum("v").alias("v"))
    labels = labels.join(cost.select(*KEY, "volume"), KEY)
    models = _listed(labels, [-F.col("v"), F.col("label")], F.struct("label", F.round(ratio(F.col("v"), F.col("volume")), 6).alias("share")), "models")
    calls = tools.groupBy(*KEY, F.col("tool_name").alias("name")).agg(F.count("*").alias("calls"))
    named = _listed(calls, [-F.col("calls"), F.col("name")], F.struct("name", "calls"), "tools")
    agent = lambda c: F.coalesce(c, F.lit("subagent")).alias("name")
    helpers = w.where("source_kind = 'subagent' or agent is not null").select(*KEY, agent(F.col("agent")), "volume", F.lit(0).alias("calls"))
    helpers = helpers.union(tools.where("tool_name = 'Agent'").select(*KEY, agent(F.col("subagent_type")), F.lit(0), F.lit(1))).groupBy(*KEY, "name").agg(F.sum("volume").alias("volume"), F.sum("calls").alias("calls"))
    subagents = _listed(helpers, [-F.col("volume"), -F.col("calls"), F.col("name")], F.struct("name", "calls"), "subagents")
    skilled = w.where("skill is not null and volume > 0").groupBy(*KEY, F.col("skill").alias("name")).agg(F.sum("volume").alias("volume"))
    skills = _listed(skilled, [-F.col("volume"), F.col("name")], F.struct("name"), "skills")

    active = F.greatest(F.col("duration_ms") - F.col("wait_ms"), F.lit(0).cast("long"))
    timed = turns.where("duration_ms > 0").withColumn("active", active)
    known = F.col("model_ms").isNotNull()
    work = timed.groupBy(*KEY).agg(
        F.sum("active").alias("active_ms"), F.sum("wait_ms").alias("human_wait_ms"), F.sum(F.when(known, F.least("model_ms", "active")).otherwise(0)).alias("model"), F.sum(F.when(known, F.col("active")).otherwise(0)).alias("measured_ms"),
        F.sort_array(F.collect_list(F.when(F.col("active") > 0, F.col("active")))).alias("lengths"),
        F.array_sort(F.collect_list(F.when(F.col("active") > 0, F.struct("at", "ordinal", "active")))).alias("ordered"),
    )
    context_rows = in_window(context.classify(usage), window).select(*KEY, "context", "cache_read", "reason", F.col("keep").isNotNull().alias("classifiable"))
    rest = in_window(context.others(usage), window).select(*KEY, "context", "cache_read", F.lit("rest").alias("reason"), F.lit(False).alias("classifiable"))
    is_ = lambda r: F.col("reason") == r
    held = context_rows.union(rest).groupBy(*KEY).agg(
        F.round(ratio(F.sum("cache_read"), F.sum("context")), 6).alias("cached_share"), F.when(F.max("classifiable"), F.count_if(is_("expired"))).alias("expired"), F.when(F.count_if(~is_("rest")) > 0, F.count_if(is_("cold_start"))).alias("cold")
    )
    out = bounds
    for part in (cost, models, named, subagents, skills, work, held, _paces(source, spark, turns)):
        out = out.join(part, KEY, "left")
    lengths = F.coalesce("lengths", F.array().cast("array<bigint>"))
    none = lambda name, shape: F.coalesce(name, F.array().cast(shape))
    gap = F.when(F.size("pace") > 0, F.struct(F.size("pace").alias("gaps"), _rank(F.col("pace"), 50).alias("p50_ms"), _rank(F.col("pace"), 90).alias("p90_ms"), F.floor(F.aggregate("pace", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("pace")).alias("mean_ms")))
    total = F.struct(
        F.struct(F.col("usd").alias("estimated_usd"), F.coalesce("unpriced_volume", F.lit(0)).alias("unpriced_tokens")).alias("cost"),
        F.when(F.col("active_ms").isNotNull(), F.struct("active_ms", "human_wait_ms", F.round(ratio(F.col("model"), F.col("measured_ms")), 6).alias("model_share"), "measured_ms", gap.alias("pace"))).alias("working_time"),
        F.struct(
            F.size(lengths).alias("turns"), _rank(lengths, 50).alias("p50_ms"), _rank(lengths, 90).alias("p90_ms"), F.array_max(lengths).alias("max_ms"), F.lit(LONG_TURN).alias("long_from_ms"), F.size(F.filter(lengths, lambda x: x >= LONG_TURN)).alias("long_turns"),
            F.coalesce(F.transform("ordered", lambda r: r["active"]), F.array().cast("array<bigint>")).alias("lengths_ms"),
        ).alias("turn_length"),
        F.when(F.col("cached_share").isNotNull(), F.struct("cached_share", F.when(F.col("expired").isNotNull(), F.struct(F.col("expired").alias("calls"))).alias("expired"), F.when(F.col("cold").isNotNull(), F.struct(F.col("cold").alias("calls"))).alias("cold_start"))).alias("context"),
        none("tools", "array<struct<name:string,calls:bigint>>").alias("tools"), none("subagents", "array<struct<name:string,calls:bigint>>").alias("subagents"), none("skills", "array<struct<name:string>>").alias("skills"), none("models", "array<struct<label:string,share:double>>").alias("models"),
    )
    return out.select(*KEY, F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(F.col("session_id").alias("id"), "first_at", "last_at").alias("session"), total.alias("total")).alias("document"))


def session_documents(spark: SparkSession, source: str | Stream) -> DataFrame:
    """The documents as JSON text, absent facts as null."""
    return session_structs(spark, source).select(*KEY, F.to_json("document", {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("document"))


def write_session_documents(spark: SparkSession, source: str | Stream, folder: str) -> None:
    """One JSON line a session, in files below a folder for each provider."""
    session_documents(spark, source).select("provider", F.col("document").alias("value")).write.partitionBy("provider").text(folder)


def document_facts(spark, sf_dir):
    """Facts read back from the documents of all sessions."""
    at = lambda path: F.get_json_object("document", f"$.{path}")
    long = lambda path: at(path).cast("long")
    calls = F.aggregate(F.from_json(at("total.tools"), "array<struct<name:string,calls:bigint>>"), F.lit(0).cast("long"), lambda a, x: a + x["calls"])
    return session_documents(spark, sf_dir).select(
        *KEY, at("session.first_at").alias("first_at"), at("session.last_at").alias("last_at"), F.round(at("total.cost.estimated_usd").cast("double"), 4).alias("usd"), long("total.cost.unpriced_tokens").alias("unpriced"), long("total.working_time.active_ms").alias("active_ms"),
        at("total.working_time.model_share").cast("double").alias("model_share"), long("total.turn_length.turns").alias("turns"), long("total.turn_length.p90_ms").alias("p90_ms"), long("total.turn_length.long_turns").alias("long_turns"), at("total.context.cached_share").cast("double").alias("cached_share"),
        long("total.context.cold_start.calls").alias("cold"), at("total.tools[0].name").alias("tool"), calls.alias("calls"), at("total.models[0].label").alias("label"), at("total.models[0].share").cast("double").alias("share"), at("total.subagents[0].name").alias("subagent"),
    )


def oracle_sql() -> dict[str, str]:
    from meterlake.plans import twins  # their rates and classes
    from meterlake.plans.adapter import USAGE_SQL

    cost = twins.COST
    short = "CASE model WHEN 'claude-opus-4-8' THEN 'Opus 4.8' WHEN 'claude-haiku-5-5' THEN 'Haiku 5.5' WHEN 'claude-sonnet-4-5-20250929' THEN 'Sonnet 4.5' WHEN 'gpt-6.1-sol' THEN 'GPT 6.1 Sol' ELSE model END"
    return {
        "document_facts": f"""WITH {USAGE_SQL}, {cost}, {twins.CLASSIFIED},
          b AS (SELECT provider, session_id, strftime(min([at]), '%Y-%m-%dT%H:%M:%S.%f') AS first_at, strftime(max([at]), '%Y-%m-%dT%H:%M:%S.%f') AS last_at, sum(volume) AS volume, count(*) AS calls FROM w GROUP BY ALL),
          tally AS (SELECT provider, session_id, {twins.TALLY} FROM p GROUP BY ALL),
          t AS (SELECT provider, session_id, greatest(duration_ms - wait_ms, 0) AS active, model_ms FROM w WHERE duration_ms > 0),
          l AS (SELECT provider, session_id, sum(active)::bigint AS active_ms, round(sum(least(model_ms, active)) FILTER (WHERE model_ms IS NOT NULL) / sum(active) FILTER (WHERE model_ms IS NOT NULL), 6) AS model_share, count(*) FILTER (WHERE active > 0) AS turns,
            quantile_disc(active, 0.9) FILTER (WHERE active > 0) AS p90_ms, count(*) FILTER (WHERE active >= {LONG_TURN}) AS long_turns FROM t GROUP BY ALL),
          x AS (SELECT provider, session_id, round(sum(cache_read) / sum(input + cache_creation + cache_read), 6) AS cached_share FROM w WHERE input + cache_creation + cache_read > 0 GROUP BY ALL),
          f AS (SELECT provider, session_id, count(*) FILTER (WHERE reason = 'cold_start') AS cold FROM cw GROUP BY ALL),
          n AS (SELECT provider, session_id, tool_name AS tool FROM w GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY provider, session_id ORDER BY count(*) DESC, tool_name) = 1),
          labelled AS (SELECT provider, session_id, {short} AS label, sum(volume) AS v FROM w WHERE volume > 0 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY provider, session_id ORDER BY sum(volume) DESC, {short}) = 1),
          h AS (SELECT provider, session_id, coalesce(agent, 'subagent') AS name, sum(CASE WHEN source_kind = 'subagent' OR agent IS NOT NULL THEN volume ELSE 0 END) AS hv, count(*) FILTER (WHERE tool_name = 'Agent') AS hk
            FROM w WHERE source_kind = 'subagent' OR agent IS NOT NULL OR tool_name = 'Agent' GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY provider, session_id ORDER BY hv DESC, hk DESC, 3) = 1)
          SELECT b.provider, b.session_id, first_at, last_at, round(usd, 4) AS usd, unpriced_volume AS unpriced, active_ms, model_share, coalesce(turns, 0)::bigint AS turns, p90_ms, coalesce(long_turns, 0)::bigint AS long_turns, cached_share, cold, tool, calls, label, round(v / volume, 6) AS share, name AS subagent
          FROM b LEFT JOIN tally USING (provider, session_id) LEFT JOIN l USING (provider, session_id) LEFT JOIN x USING (provider, session_id) LEFT JOIN f USING (provider, session_id) LEFT JOIN n USING (provider, session_id)
            LEFT JOIN labelled USING (provider, session_id) LEFT JOIN (SELECT provider, session_id, name FROM h) USING (provider, session_id)""".replace("[at]", '"at"'),
    }
