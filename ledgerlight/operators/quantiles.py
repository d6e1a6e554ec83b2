"""Exact quantiles from sketches and value counts, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.ordered import SKETCH_SIZE, join_null_safe, running_totals
from ledgerlight.session import written

# Ranks around the wanted one that a sketch may miss it by, as a share of the rows; several times its usual error.
MARGIN = 0.005
# Groups of fewer rows are counted whole.
SMALL = 1000


def _ranked(rows: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], margin: float | None = MARGIN) -> DataFrame:
    """(keys, _f, value, _n, _before, _total): values near each wanted rank with how often they occur and how many lie below.

    A mergeable sketch of each group gives two values that surely enclose the rank; one pass counts what lies below the lower
    one, and only values between the two are counted one by one.  No width or range of the values has to be known.
    """
    rows = rows.where(F.col(value).isNotNull())
    if margin is None:
        counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
        totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
        ranked = join_null_safe(running_totals(counts, keys, [value], {"_before": F.col("_n")}), totals, list(keys))
        return ranked.withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(len(fractions))])))
    number = F.col(value).cast("double")
    sketches = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), F.kll_sketch_agg_double(number, F.lit(SKETCH_SIZE)).alias("_s"))
    # A wanted position may lie between two rows, so the bounds reach a little beyond the margin; small groups have none.
    reach, large = margin + 2 / SMALL, F.col("_total") >= SMALL

    def bound(share: float) -> Column:
        return F.when(large, F.kll_sketch_get_quantile_double("_s", F.lit(share))) if 0 < share < 1 else F.lit(None).cast("double")

    bounds = sketches.select(*keys, "_total", F.array(*[
        F.struct(F.lit(i).alias("_f"), bound(f - reach).alias("_low"), bound(f + reach).alias("_high")) for i, f in enumerate(fractions.values())]).alias("_b"))
    # Sketches draw at random: written once, one row a group, so that all that follows sees the same bounds.
    bounds = written(bounds, "quantile-bounds")
    placed = join_null_safe(rows.select(*keys, value), bounds, list(keys)).select(*keys, value, "_total", F.explode("_b").alias("_b"))
    under = F.coalesce(number < F.col("_b._low"), F.lit(False))
    inside = ~under & F.coalesce(number <= F.col("_b._high"), F.lit(True))
    marked = placed.select(*keys, "_total", F.col("_b._f").alias("_f"), under.alias("_under"), F.when(inside, F.col(value)).alias("_v"), inside.alias("_inside")).where("_under OR _inside")
    # Everything below is one group of its own, so a hot group is a partial sum.
    counts = marked.groupBy(*keys, "_total", "_f", "_under", "_v").agg(F.count(F.lit(1)).alias("_n"))
    below = counts.where("_under").select(*keys, "_f", F.col("_n").alias("_below"))
    ranked = running_totals(counts.where("NOT _under").select(*keys, "_total", "_f", F.col("_v").alias(value), "_n"), [*keys, "_f"], [value], {"_inside_before": F.col("_n")})
    renamed = below.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_f").alias("_fb"), "_below")
    condition = F.col("_f") == F.col("_fb")
    for i, key in enumerate(keys):
        condition = condition & F.col(key).eqNullSafe(F.col(f"_k_{i}"))
    joined = ranked.join(renamed, condition, "left")
    return joined.withColumn("_before", F.col("_inside_before") + F.coalesce("_below", F.lit(0))).select(*keys, "_f", value, "_n", "_before", "_total")


def _value_at(index: Column, value: str, which: int) -> Column:
    return F.max(F.when((F.col("_f") == which) & (F.col("_before") <= index) & (index < F.col("_before") + F.col("_n")), F.col(value)))


def _checked(found: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], finish) -> DataFrame:
    """The result by sketches; should one have missed its rank (which leaves a null), that of counting all values."""
    result = finish(found)
    missed = result.where(" OR ".join(f"`{name}` IS NULL" for name in fractions))
    return result if missed.isEmpty() else finish(_ranked(rows, keys, value, fractions, None))


def nearest_rank(rows: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """sorted[floor((n - 1) * f)] per group — no interpolation."""
    def finish(ranked: DataFrame) -> DataFrame:
        return ranked.groupBy(*keys).agg(*[_value_at(F.floor((F.col("_total") - 1) * F.lit(f)), value, i).alias(name) for i, (name, f) in enumerate(fractions.items())])

    return _checked(_ranked(rows, keys, value, fractions), rows, keys, value, fractions, finish)


def interpolated(rows: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group."""
    def finish(ranked: DataFrame) -> DataFrame:
        columns, results = [], []
        for i, (name, f) in enumerate(fractions.items()):
            position = (F.col("_total") - 1) * F.lit(f)
            columns += [_value_at(F.floor(position), value, i).alias(f"_lo_{name}"), _value_at(F.ceil(position), value, i).alias(f"_hi_{name}"),
                        F.max(position - F.floor(position)).alias(f"_w_{name}")]
            low, high, weight = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
            results.append((low + (high - low) * weight).alias(name))
        return ranked.groupBy(*keys).agg(*columns).select(*keys, *results)

    return _checked(_ranked(rows, keys, value, fractions), rows, keys, value, fractions, finish)


def approximate(rows: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], size: int = SKETCH_SIZE) -> DataFrame:
    """Approximate quantiles from mergeable sketches, for dashboards that can do with a bound on the rank error."""
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size))
    return rows.groupBy(*keys).agg(sketch.alias("_s")).select(
        *keys, *[F.kll_sketch_get_quantile_double("_s", F.lit(f)).alias(name) for name, f in fractions.items()])
