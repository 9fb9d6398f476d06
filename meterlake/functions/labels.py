"""Short names of models for display, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Providers whose name may stand before a model's, families, and the longest label.
PROVIDERS = (
    "openai", "anthropic", "google", "vertex_ai", "vertex", "meta-llama", "meta", "mistralai", "mistral", "x-ai", "xai", "deepseek", "qwen", "cohere", "perplexity", "azure", "bedrock", "openrouter", "together", "fireworks", "groq", "ollama",
)
FAMILIES = ("opus", "sonnet", "haiku", "fable")
LONGEST, LOOKED_AT = 24, 128


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_provider(name: Column) -> Column:
    """The name after a known ``provider/``; an unknown one stays."""
    rest = F.regexp_replace(name, "^[^/]*/", "")
    return F.when(F.lower(F.split_part(name, F.lit("/"), F.lit(1))).isin(*PROVIDERS) & name.contains("/") & (rest != ""), rest).otherwise(name)


def _leading(parts: Column) -> Column:
    """The parts, two at most, before the first that is no number of one or two digits."""
    named = F.filter(parts, lambda x: x != "")
    stop = lambda a: F.array_position(F.transform(a, lambda x: x.rlike("^[0-9]{1,2}$")), F.lit(False))
    return _let(named, lambda a: F.slice(a, F.lit(1), F.least(F.when(stop(a) == 0, F.size(a)).otherwise(stop(a) - 1), F.lit(2)).cast("int")))


def _version(lower: Column, family: str) -> Column:
    """Numbers right after the family's name, else right before it; null without any."""
    after = _leading(F.split(F.regexp_replace(lower, f"(?s)^.*?{family}", ""), "-"))
    before = F.reverse(_leading(F.reverse(F.split(F.substring_index(lower, family, 1), "-"))))
    joined = lambda x: F.nullif(F.array_join(x, "."), F.lit(""))
    return F.coalesce(joined(after), joined(before))


def _claude(lower: Column, family: str) -> Column:
    return F.concat_ws(" ", F.lit(family.capitalize()), _version(lower, family))


def _gpt(name: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(name, "^gpt-", ""), "-"), lambda x: x != "")
    risen = lambda x: F.when(x.rlike("^[0-9.]+$") | ~x.rlike("^[a-z]"), x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.regexp_replace(x, "^.", "")))
    return F.when(name.startswith("gpt-"), F.concat_ws(" ", F.lit("GPT"), F.transform(parts, risen))).otherwise(name)


def safe(label: Column) -> Column:
    """``Other`` for nothing and for labels with other characters than models have; cut at 24."""
    bare = F.trim(label)
    fine = F.substring(bare, 1, LOOKED_AT).rlike(r"^[A-Za-z0-9 ._()+:-]+$")
    return F.when(fine, F.rtrim(F.substring(bare, 1, LONGEST))).otherwise("Other")


def model_label(model: Column) -> Column:
    """Family and version of a model, from names that logs give and nobody checks."""

    def named(name: Column) -> Column:
        lower = F.lower(name)
        out = F.when(lower.contains(FAMILIES[0]), _claude(lower, FAMILIES[0]))
        for family in FAMILIES[1:]:
            out = out.when(lower.contains(family), _claude(lower, family))
        return out.when(lower.contains("gemini"), name).when(lower.contains("gpt"), _gpt(name)).when(lower.isin("openai", "codex"), "Codex").otherwise(name)

    return F.coalesce(_let(_let(without_provider(model), named), safe), F.lit("Other"))
