"""What a call's context cost: cold starts, expired caches, uncached input, cached reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.scalar import U64_MOST, saturating_sum
from meterlake.operators.pricing import write_split

# Cache retention in minutes, size bands of a context in tokens.
RETENTION = {"claude": 60, "codex": 30}
BANDS = (("<100K", 100_000), ("100-200K", 200_000), ("200-500K", 500_000), ("500K+", None))
# Beginnings of model names with the shorter retention.
FAMILIES = ("gpt", "codex", "o1", "o3", "o4")
# Cache multipliers where a model has no rates, and the largest that counts.
READ, WRITE_5M, WRITE_1H, MOST = 0.1, 1.25, 2.0, 10.0


def effective(rated: DataFrame) -> tuple[Column, Column]:
    """A call's uncached and cached part in uncached tokens, weighted by its model's own rates (see pricing.resolve)."""

    def weight(rate: str, default: float) -> Column:
        ratio = F.when(F.col("r_in") > 0, F.col(rate) / F.col("r_in"))
        return F.when((ratio >= 0) & (ratio <= MOST), ratio).otherwise(default)

    def weighted(tokens: Column, by: Column) -> Column:
        return F.round(tokens * by).cast("long")

    short, long = write_split()
    return F.col("input") + weighted(short, weight("r_5m", WRITE_5M)) + weighted(long, weight("r_1h", WRITE_1H)), weighted(F.col("cache_read"), weight("r_read", READ))


def retention_minutes(provider: Column, model: Column) -> Column:
    family = F.lower(model)
    own = F.coalesce(*[F.when(provider == p, m) for p, m in RETENTION.items()])
    return F.coalesce(own, F.when(family.contains("claude"), RETENTION["claude"]).when(family.rlike("^(" + "|".join(FAMILIES) + ")"), RETENTION["codex"]))


def classify(calls: DataFrame) -> DataFrame:
    """Adds context, uncached, ``reason`` (cold_start, expired, uncached), ``band`` and ``keep``, the retention in minutes.

    Over the whole history: only dated main calls with context count; the first of a session is
    its cold start; a later one whose uncached part is half of the context or more, after a gap
    to the previous call of the same session and model of the retention time or more, found
    an expired cache. Calls without a session are uncached whatever came before, so they skip
    the ordering and never meet in one task. Window filters belong after this.
    """
    context = F.col("input") + F.col("cache_creation") + F.col("cache_read")
    main = calls.withColumn("context", context).where((F.col("source_kind") == "main") & (F.col("granularity") == "call") & (F.col("context") > 0) & F.col("at").isNotNull())
    main = main.withColumn("uncached", F.col("input") + F.col("cache_creation")).withColumn("keep", retention_minutes(F.col("provider"), F.col("model")))
    band = F.coalesce(*[F.when(F.lit(True) if most is None else F.col("context") < most, name) for name, most in BANDS])
    main = main.withColumn("band", band)
    known = main.where("session_id is not null")
    sessions = Window.partitionBy("provider", "session_id").orderBy("at", "ordinal")
    models = Window.partitionBy("provider", "session_id", "model").orderBy("at", "ordinal")
    gap = F.timestamp_diff("MICROSECOND", F.lag("at").over(models), F.col("at"))
    known = known.withColumn("__first", F.row_number().over(sessions) == 1).withColumn("__gap", gap)
    # twice the uncached part reaches the context where it reaches the cached part
    expired = (F.col("uncached") >= F.col("cache_read")) & (F.col("__gap") >= F.col("keep").cast("long") * 60_000_000)
    reason = F.when(F.col("__first"), "cold_start").when(F.coalesce(expired, F.lit(False)), "expired").otherwise("uncached")
    return known.withColumn("reason", reason).drop("__first", "__gap").unionByName(main.where("session_id is null").withColumn("reason", F.lit("uncached")))


def others(calls: DataFrame) -> DataFrame:
    """Dated rows with context that are no main calls: aggregates and subagents' calls."""
    context = F.col("input") + F.col("cache_creation") + F.col("cache_read")
    main = F.coalesce((F.col("source_kind") == "main") & (F.col("granularity") == "call"), F.lit(False))
    return calls.withColumn("context", context).where((F.col("context") > 0) & F.col("at").isNotNull() & ~main)


def summary(main: DataFrame, rest: DataFrame) -> DataFrame:
    """One row a provider from rated calls of :func:`classify` and :func:`others`, window applied.

    A band holds its calls and their cached part, a reason its calls and their uncached part,
    the remainder all of the rest. Cold starts are null where no call has a session, expired
    ones where no call with a session has a known retention. ``effective_tokens`` is the checked
    sum of all these; where it exceeds an unsigned 64-bit number, the breakdown is dropped.
    """
    whole = lambda c: saturating_sum(c)
    new, old = effective(main)
    rows = main.select("provider", "context", "cache_read", "band", "reason", new.alias("new"), old.alias("old"), F.col("session_id").isNotNull().alias("sessionful"), (F.col("session_id").isNotNull() & F.col("keep").isNotNull()).alias("classifiable"))
    new, old = effective(rest)
    none = F.lit(None)
    rows = rows.unionByName(rest.select("provider", "context", "cache_read", none.cast("string").alias("band"), F.lit("rest").alias("reason"), new.alias("new"), old.alias("old"), F.lit(False).alias("sessionful"), F.lit(False).alias("classifiable")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,0)"))
    is_ = lambda r: F.col("reason") == r
    found = [whole(F.col("context")).alias("context_tokens"), whole(F.col("cache_read")).alias("cached_tokens"), F.count_if(~is_("rest")).alias("calls"), F.max("sessionful").alias("sessionful"), F.max("classifiable").alias("classifiable")]
    for n, (name, _) in enumerate(BANDS):
        found += [F.count_if(F.col("band") == name).alias(f"band{n}_calls"), zero(whole(F.when(F.col("band") == name, F.col("old")))).alias(f"band{n}_cached")]
    for reason in ("cold_start", "expired", "uncached"):
        found += [F.count_if(is_(reason)).alias(f"{reason}_calls"), zero(whole(F.when(is_(reason), F.col("new")))).alias(f"{reason}_tokens")]
    found.append(zero(whole(F.when(is_("rest"), F.col("new").cast("decimal(20,0)") + F.col("old")))).alias("unclassified_tokens"))
    sums = rows.groupBy("provider").agg(*found).where("context_tokens > 0")
    for reason, known in (("cold_start", "sessionful"), ("expired", "classifiable")):
        sums = sums.withColumns({c: F.when(F.col(known), F.col(c)) for c in (f"{reason}_calls", f"{reason}_tokens")})
    parts = [f"band{n}_cached" for n in range(len(BANDS))] + ["cold_start_tokens", "expired_tokens", "uncached_tokens", "unclassified_tokens"]
    total = zero(F.col(parts[0]))
    for c in parts[1:]:
        total = total + zero(F.col(c))
    most = F.lit(str(U64_MOST)).cast("decimal(38,0)")
    sums = sums.withColumn("effective_tokens", total.cast("decimal(38,0)"))
    over = F.col("effective_tokens") > most
    lost = {c: F.when(over, none if c.startswith(("cold", "expired")) else F.lit(0)).otherwise(F.col(c)).cast(kind) for c, kind in sums.dtypes if c in parts or c.endswith("_calls")}
    return sums.withColumns(lost).withColumn("effective_tokens", F.least("effective_tokens", most)).drop("sessionful", "classifiable")
