"""Pricing: rates for each distinct model, then cost for each call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.scalar import normalize_model

# Test rates in USD for a million tokens (model, input, output, cache read,
# 5-minute write, 1-hour write, tier threshold, the same five rates above it).
RATES = [
    ("claude-opus-4-8", 5.0, 25.0, 0.5, 6.25, 10.0, None, None, None, None, None, None),
    ("claude-fable-5", 8.0, 40.0, 0.8, 10.0, 16.0, None, None, None, None, None, None),
    ("claude-sonnet-4-5", 3.0, 15.0, 0.3, 3.75, 6.0, None, None, None, None, None, None),
    ("claude-haiku-5-5", 0.1, 0.5, 0.01, 0.125, 0.2, 100000, 0.5, 2.5, 0.05, 0.625, 1.0),
    ("gpt-5.5", 5.0, 30.0, 0.5, 0.0, 0.0, None, None, None, None, None, None),
    ("gpt-6.1-sol", 2.0, 10.0, 0.1, 0.0, 0.0, 272000, 4.0, 15.0, 0.2, 0.0, 0.0),
    ("gemini-3.5-flash", 1.5, 9.0, 0.15, 0.0, 0.0, None, None, None, None, None, None),
]
RATE_COLUMNS = "price_model string, r_in double, r_out double, r_read double, r_5m double, r_1h double, tier long, t_in double, t_out double, t_read double, t_5m double, t_1h double"
# Names that stand for one default model.
ALIASES = {"codex": "gpt-6.1-sol", "openai": "gpt-6.1-sol", "codex-auto-review": "gpt-6.1-sol"}


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, RATE_COLUMNS)


def resolve(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Rates of each distinct ``model``: the longest key that equals its normal form or is followed
    in it by ``-latest`` or ``-`` and a digit; failing that, the same with the name's dots (not
    the key's) written as hyphens.

    Both sides are distinct model names: the price table has at most 50,000 rows by its
    decoder's limit, so it is marked for broadcast.
    """
    keys = F.broadcast(prices)
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    names = models.select("model").distinct().withColumn("name", normalize_model(F.col("model")))
    names = names.withColumn("name", F.coalesce(alias[F.col("name")], F.col("name")))
    rest = F.expr("substr(name, length(price_model) + 1)")
    plain = (F.col("name") == F.col("price_model")) | (F.startswith("name", "price_model") & rest.rlike("^-(latest|[0-9])"))
    dotted_name = F.translate("name", ".", "-")
    dotted = (dotted_name == F.col("price_model")) | (F.startswith(dotted_name, F.col("price_model")) & F.expr("substr(translate(name, '.', '-'), length(price_model) + 1)").rlike("^-(latest|[0-9])"))
    met = names.join(keys, plain | dotted, "left").withColumn("exact", F.coalesce(plain, F.lit(False)))
    rates = [c for c in prices.columns]
    best = met.groupBy("model").agg(F.max_by(F.struct(*rates), F.struct("exact", F.length("price_model"), "price_model")).alias("p"))
    return best.select("model", *[F.col(f"p.{c}").alias(c) for c in rates])


def _at(rate: str) -> Column:
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_creation")
    above = (F.col("granularity") == "call") & F.col("tier").isNotNull() & (prompt > F.col("tier"))
    return F.when(above, F.coalesce(f"t_{rate}", f"r_{rate}")).otherwise(F.col(f"r_{rate}"))


def write_split() -> tuple[Column, Column]:
    """Five-minute and one-hour cache writes; a split that is empty or exceeds the whole is none."""
    split = F.col("w5m") + F.col("w1h")
    valid = (split > 0) & (split <= F.col("cache_creation"))
    return F.when(valid, F.col("cache_creation") - F.col("w1h")).otherwise(F.col("cache_creation")), F.when(valid, F.col("w1h")).otherwise(F.lit(0).cast("long"))


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``usd`` (null where unpriced) to each event; the tier is chosen call by call.

    Writes that the split leaves out count as five-minute ones; see :func:`write_split`.
    """
    short, long = write_split()
    writes = short * _at("5m") + long * _at("1h")
    usd = (F.col("input") * _at("in") + F.col("output") * _at("out") + F.col("cache_read") * _at("read") + writes) / 1e6
    return usage.join(resolve(usage, prices), "model", "left").withColumn("usd", F.when(F.col("volume") == 0, 0.0).otherwise(usd))


def tally(digits: int = 6) -> list[Column]:
    """Priced dollars (null when nothing could be priced) and unpriced volume of a group."""
    unpriced = F.sum(F.when(F.col("usd").isNull(), F.col("volume")).otherwise(0))
    priced = F.sum(F.when(F.col("usd").isNotNull() & (F.col("volume") > 0), 1).otherwise(0))
    usd = F.when((priced > 0) | (unpriced == 0), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), digits))
    return [usd.alias("usd"), unpriced.alias("unpriced_volume")]


def write_rate(write: Column, fallback: Column) -> Column:
    """A missing or zero write rate is the fallback's."""
    return F.coalesce(F.nullif(write, F.lit(0.0)), fallback)


def decode_price_table(spark: SparkSession, path: str) -> DataFrame:
    """Rates from a JSON object of model to rate fields (dollars a token), in millions.

    Kept: chat, completion and responses models with plausible base rates (0 to 0.01 a
    token). Provider prefixes ``xai/`` and ``gemini/`` are cut; other names with a slash are
    dropped; a bare name hides its prefixed duplicate. Of up to four long-context tiers the
    lowest with an input rate counts; an implausible tier falls away.
    """
    text = spark.read.option("wholetext", True).text(path)
    fields = "mode string, input_cost_per_token double, output_cost_per_token double, cache_read_input_token_cost double, cache_creation_input_token_cost double, cache_creation_input_token_cost_above_1hr double"
    whole = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("name", "body"))
    rows = whole.select("name", F.from_json("body", fields).alias("f"), F.from_json("body", "map<string, string>").alias("raw"))
    rows = rows.where(F.coalesce(F.col("f.mode").isin("chat", "completion", "responses"), F.lit(False)))
    bare = F.regexp_replace("name", "^(xai|gemini)/", "")
    rows = rows.withColumn("price_model", bare).where(~F.contains(F.col("price_model"), F.lit("/"))).withColumn("prefixed", (F.col("name") != F.col("price_model")).cast("int"))
    slots = F.map_filter("raw", lambda k, v: k.rlike("_above_[0-9]+k?_tokens$"))
    sizes = F.array_sort(F.array_distinct(F.transform(F.map_keys(F.map_filter(slots, lambda k, v: k.startswith("input_cost_per_token"))), _threshold)))
    every = F.array_distinct(F.transform(F.map_keys(slots), _threshold))
    rows = rows.withColumn("slots", slots).withColumn("tier", F.when(F.size(every) <= 4, F.get(F.filter(sizes, lambda x: x >= 1000), F.lit(0))))
    names = {"in": "input_cost_per_token", "out": "output_cost_per_token", "read": "cache_read_input_token_cost", "5m": "cache_creation_input_token_cost", "1h": "cache_creation_input_token_cost_above_1hr"}
    for short, field in names.items():
        value = F.map_values(F.map_filter("slots", _slot_of(field)))
        rows = rows.withColumn(f"r_{short}", F.col(f"f.{field}") * 1e6).withColumn(f"t_{short}", F.get(value, F.lit(0)).try_cast("double") * 1e6)
    good = lambda c: F.col(c).between(0, 1e4)
    rows = rows.where(good("r_in") & good("r_out") & F.coalesce(good("r_read"), F.lit(True)))
    rows = rows.withColumn("r_read", F.coalesce("r_read", F.lit(0.0))).withColumn("r_5m", write_rate(F.col("r_5m"), F.col("r_in"))).withColumn("r_1h", write_rate(F.col("r_1h"), F.col("r_5m")))
    fine = F.col("tier").isNotNull()
    for short in names:
        fine = fine & F.coalesce(good(f"t_{short}"), F.lit(True))
    rows = rows.withColumn("tier", F.when(fine, F.col("tier")))
    best = rows.groupBy("price_model").agg(F.min_by(F.struct(*[c.split()[0] for c in RATE_COLUMNS.split(", ")[1:]]), "prefixed").alias("p"))
    return best.select("price_model", "p.*")


def _slot_of(field: str):
    return lambda k, v: k.startswith(f"{field}_above_") & (_threshold(k) == F.col("tier"))


def _threshold(key: Column) -> Column:
    digits = F.regexp_extract(key, "_above_([0-9]+)k?_tokens$", 1).try_cast("long")
    return F.when(key.rlike("k_tokens$"), digits * 1000).otherwise(digits)
