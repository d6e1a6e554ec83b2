"""Price arithmetic as column expressions over token counts and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlight.functions.money import as_col

# Fixed values.
DEFAULT_UNPRICED_RATE = 5.0
SOURCE_FEE = 0.025
LONG_CONTEXT_TOKENS = 128_000
CHARACTERS_PER_TOKEN = 4
# (largest number of billions, category); larger models keep their own name.
SIZE_CATEGORIES = (
    (4, "up-to-4b"), (8, "4.1b-8b"), (21, "8.1b-21b"), (41, "21.1b-41b"), (80, "41.1b-80b"), (110, "81.1b-110b"),
)
MIXTURE_CATEGORIES = ((56, "moe-up-to-56b"), (176, "moe-56b-to-176b"))
DENSE_CATEGORIES = ((4, "up-to-4b"), (16, "4.1b-to-16b"))
DENSE_ABOVE = "above-16b"
DENSE_DEFAULT = "default"


def or_zero(value: Column | str) -> Column:
    return F.coalesce(as_col(value), F.lit(0))


def prompt_cost(prompt: Column, cached: Column, rate: Column, cache_rate: Column) -> Column:
    """Fresh tokens at the input rate, cached ones at the cache rate (or else the input rate)."""
    return (or_zero(prompt) - or_zero(cached)) * or_zero(rate) + or_zero(cached) * F.coalesce(cache_rate, or_zero(rate))


def completion_cost(completion: Column, reasoning: Column, rate: Column, reasoning_rate: Column) -> Column:
    """Visible tokens at the output rate, reasoning ones at theirs (or else the output rate)."""
    return ((or_zero(completion) - or_zero(reasoning)) * or_zero(rate)
            + or_zero(reasoning) * F.coalesce(reasoning_rate, or_zero(rate)))


def tiered_cost(tokens: Column, bands: Column, rate: str, fallback: str | None = None) -> Column:
    """Marginal price bands: every token costs the rate of the band it falls in.

    *bands* is an array of structs (low, high, rates...).  Tokens no band covers,
    such as those above the highest one, cost the rate of the last band.
    """
    ordered = F.array_sort(bands, lambda a, b: F.when(a["low"] < b["low"], -1).when(a["low"] > b["low"], 1).otherwise(0))

    def rate_of(band: Column) -> Column:
        own = F.when(band[rate] != 0, band[rate])
        other = band[fallback] if fallback else F.lit(0.0)
        return F.coalesce(own, other, F.lit(0.0)).cast("double")

    def add_band(state: Column, band: Column) -> Column:
        start = F.greatest(band["low"], state["done"])
        end = F.least(band["high"], tokens)
        used = end > start
        return F.struct(
            F.when(used, end).otherwise(state["done"]).alias("done"),
            (state["cost"] + F.when(used, (end - start) * rate_of(band)).otherwise(0.0)).alias("cost"),
            rate_of(band).alias("last_rate"))

    start = F.struct(F.lit(0).cast("bigint").alias("done"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("last_rate"))
    total = F.aggregate(
        ordered, start, add_band,
        lambda s: s["cost"] + F.greatest(tokens - s["done"], F.lit(0)) * s["last_rate"])
    return F.when((tokens > 0) & (F.size(bands) > 0), total).otherwise(F.lit(0.0))


def multiplied(cost: Column, cache_cost: Column, factor: Column) -> Column:
    """Region or speed surcharge on everything but the cache part."""
    return (cost - cache_cost) * factor + cache_cost


def with_addons(given_total: Column, prompt: Column, completion: Column, citations: Column, reasoning: Column,
                searches: Column, rates: dict[str, Column]) -> Column:
    """The provider's own total wins; otherwise tokens plus citations, reasoning and searches."""
    summed = (or_zero(prompt) * or_zero(rates["input"]) + or_zero(citations) * or_zero(rates["citation"])
              + or_zero(completion) * or_zero(rates["output"]) + or_zero(reasoning) * or_zero(rates["reasoning"])
              + or_zero(searches) * or_zero(rates["search"]))
    return F.coalesce(given_total, summed)


def per_second(seconds: Column, output_rate: Column, input_rate: Column) -> Column:
    """Duration price; an output rate takes precedence over an input rate."""
    return F.coalesce(output_rate * seconds, input_rate * seconds, F.lit(0.0))


def per_token_cliff(tokens: Column, rate: Column, long_rate: Column) -> Column:
    """Above 128k tokens all tokens of that side take the long-context rate, where there is one."""
    long_context = (tokens > LONG_CONTEXT_TOKENS) & long_rate.isNotNull()
    return or_zero(tokens) * F.when(long_context, long_rate).otherwise(or_zero(rate))


def per_character(characters: Column, rate: Column, long_rate: Column, token_cost: Column) -> Column:
    """Character price with the same cliff; without a fitting rate the token price applies."""
    long_context = characters * CHARACTERS_PER_TOKEN > LONG_CONTEXT_TOKENS
    return F.coalesce(characters * F.when(long_context, long_rate).otherwise(rate), token_cost)


def visible_plus_reasoning(prompt: Column, completion: Column, reasoning: Column, sources: Column,
                           input_rate: Column, output_rate: Column) -> Column:
    """Visible and reasoning tokens both billed as output, plus a fee per source used."""
    return (or_zero(prompt) * or_zero(input_rate) + (or_zero(completion) + or_zero(reasoning)) * or_zero(output_rate)
            + or_zero(sources) * F.lit(SOURCE_FEE))


def per_query(given: Column, fixed: Column, prompt: Column, completion: Column, input_rate: Column,
              output_rate: Column) -> Column:
    """Given cost, else a fixed price per query, else token rates, else zero."""
    by_tokens = or_zero(prompt) * or_zero(input_rate) + or_zero(completion) * or_zero(output_rate)
    return F.coalesce(given, fixed, by_tokens)


def per_tool(tool: Column, prices: Column, default: Column) -> Column:
    """Price of the tool, else the server's default, else zero."""
    return F.coalesce(F.try_element_at(prices, tool), default, F.lit(0.0))


def _first_category(size: Column, steps) -> Column:
    category = F.lit(None).cast("string")
    for limit, name in reversed(steps):
        category = F.when(size <= limit, F.lit(name)).otherwise(category)
    return category


def size_category(model: Column) -> Column:
    """Price category by the first whole number of billions in the name; otherwise the name itself."""
    name = F.lower(model)
    digits = F.regexp_extract(name, r"(\d+)b", 1)
    size = F.when(digits != "", digits).cast("bigint")
    return F.coalesce(_first_category(size, SIZE_CATEGORIES), name)


def mixture_category(model: Column) -> Column:
    """Second scheme: mixtures <a>x<b>b by their product, others by their size."""
    name = F.lower(model)
    experts = F.regexp_extract(name, r"(\d+)x(\d+)b", 1)
    each = F.regexp_extract(name, r"(\d+)x(\d+)b", 2)
    product = F.when(experts != "", experts.cast("bigint") * each.cast("bigint"))
    digits = F.regexp_extract(name, r"(\d+)b", 1)
    size = F.when(digits != "", digits).cast("bigint")
    return F.coalesce(_first_category(product, MIXTURE_CATEGORIES), _first_category(size, DENSE_CATEGORIES),
                      F.when(size.isNotNull(), F.lit(DENSE_ABOVE)), F.lit(DENSE_DEFAULT))


def breakdown(input_cost: Column, output_cost: Column, tool_cost: Column, extra: Column,
              discount_percent: Column, margin_percent: Column, margin_fixed: Column) -> dict[str, Column]:
    """From part costs to the final total: first the discount, then the margin."""
    extras = F.aggregate(F.map_values(extra), F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))
    original = or_zero(input_cost) + or_zero(output_cost) + or_zero(tool_cost) + extras
    discount = original * or_zero(discount_percent)
    after = original - discount
    margin = after * or_zero(margin_percent) + or_zero(margin_fixed)
    return {"original_cost": original, "discount_amount": discount, "margin_amount": margin,
            "total_cost": after + margin}
