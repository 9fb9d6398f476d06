"""The decoder of price tables as a query: brands and types of parts written as one price document.

A price document has 50,000 entries at most; there are as many entries here as pairs of brand
and type, whatever the number of parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.tables import shared_folder
from meterlake.operators import pricing
from meterlake.plans.adapter import read
from meterlake.plans.logs import _named


def price_document(spark, sf_dir):
    """One row with the JSON text: dropped modes and names, implausible rates, missing and zero write rates, tiers."""
    p = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("k"), F.min("p_retailprice").alias("price"))
    n, price = F.col("k") % 12, F.col("price")
    name = F.concat(F.when(n == 1, "xai/").when(n == 2, "other/").otherwise(""), F.translate(F.lower(F.concat_ws("-", "p_brand", "p_type")), " #", "-"))
    body = _named(
        mode=F.when(n == 0, "image_generation").when(n % 2 == 0, "chat").otherwise("completion"), input_cost_per_token=F.when(n == 3, 0.02).otherwise(price * 1e-9), output_cost_per_token=price * 5e-9, cache_read_input_token_cost=F.when(n != 4, price * 1e-10),
        cache_creation_input_token_cost=F.when(n == 5, 0.0).when(n != 9, price * 1.25e-9), cache_creation_input_token_cost_above_1hr=F.when(n == 6, price * 2e-9), input_cost_per_token_above_200k_tokens=F.when(n == 7, price * 2e-9), output_cost_per_token_above_200k_tokens=F.when(n == 7, price * 8e-9),
        input_cost_per_token_above_128k_tokens=F.when(n == 8, 0.5).when(n == 10, price * 3e-9), input_cost_per_token_above_256000_tokens=F.when(n == 10, price * 4e-9),
    )
    return p.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(name.alias("name"), body.alias("body"))))).alias("value"))


def price_table_rates(spark, sf_dir):
    """Rates in dollars a million tokens, with the tier that counts."""
    folder = shared_folder(spark)
    price_document(spark, sf_dir).write.text(folder)
    rates = pricing.decode_price_table(spark, folder)
    tier = lambda c: F.when(F.col("tier").isNotNull(), F.round(c, 6)).alias(c)
    return rates.select("price_model", *[F.round(f"r_{c}", 6).alias(f"r_{c}") for c in ("in", "out", "read", "5m", "1h")], "tier", tier("t_in"), tier("t_out"))


def oracle_sql() -> dict[str, str]:
    return {
        "price_table_rates": """WITH p AS (SELECT translate(lower(p_brand || '-' || p_type), ' #', '-') AS price_model, min(p_partkey) % 12 AS n, min(p_retailprice) AS price FROM part GROUP BY p_brand, p_type)
          SELECT price_model, round(price * 1e-9 * 1e6, 6) AS r_in, round(price * 5e-9 * 1e6, 6) AS r_out, CASE WHEN n = 4 THEN 0.0::double ELSE round(price * 1e-10 * 1e6, 6) END AS r_read,
            round(CASE WHEN n IN (5, 9) THEN price * 1e-9 ELSE price * 1.25e-9 END * 1e6, 6) AS r_5m, round(CASE WHEN n = 6 THEN price * 2e-9 WHEN n IN (5, 9) THEN price * 1e-9 ELSE price * 1.25e-9 END * 1e6, 6) AS r_1h,
            (CASE n WHEN 7 THEN 200000 WHEN 10 THEN 128000 END)::bigint AS tier, round(CASE n WHEN 7 THEN price * 2e-9 WHEN 10 THEN price * 3e-9 END * 1e6, 6) AS t_in, round(CASE n WHEN 7 THEN price * 8e-9 END * 1e6, 6) AS t_out
          FROM p WHERE n NOT IN (0, 2, 3)""",
    }
