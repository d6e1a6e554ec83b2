"""Window computations that stay bounded when one key holds most of the rows.

A plain window puts all rows of a key into one task.  The functions here cut
every key into buckets along its order column, work inside the buckets, and
carry what a bucket needs from its predecessors as small aggregates (running
totals) or as a few repeated rows (trailing windows).  The results equal the
plain window exactly; only the largest task changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import written

DEFAULT_BLOCK = 4096
# Rows of a key in one bucket, and the size of the sketches that find where buckets end (rank error about 0.1 %).
ROWS_PER_BUCKET = 250_000
SKETCH_SIZE = 4096
MAX_BUCKETS = 1024


def epoch_seconds(ts: Column | str) -> Column:
    """Whole and fractional seconds since 1970 of a timestamp without zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp")) / F.lit(1_000_000.0)


def epoch_micros(ts: Column | str) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on *keys* where null equals null; the keys are the left ones."""
    renamed = right.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for i, key in enumerate(keys):
        condition = condition & left[key].eqNullSafe(renamed[f"_right_{i}"])
    return left.join(renamed, condition).drop(*[f"_right_{i}" for i in range(len(keys))])


def order_number(df: DataFrame, order: str) -> Column:
    """The order column as a number of the same order: microseconds of a time, days of a date."""
    kind = dict(df.dtypes)[order]
    if kind.startswith("timestamp"):
        return epoch_micros(order)
    if kind == "date":
        return F.unix_date(order).cast("bigint")
    return F.col(order).cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.col(order).cast("double")


def measured_buckets(df: DataFrame, keys: Sequence[str], order: str, rows: int | None = None, name: str = "_bucket") -> DataFrame:
    """Add a bucket number that never decreases along *order* within a key, with about *rows* rows of a key in each.

    Keys are counted first, and a key has at most MAX_BUCKETS buckets.  Only those with more rows are sketched, and their buckets end at quantiles of their own, so the
    distribution does not matter: all rows of a key may lie in one day or one second.  Rows with one value of *order* stay
    together; nulls come first.
    """
    rows = rows or ROWS_PER_BUCKET
    number = order_number(df, order)
    whole = dict(df.withColumn("_o", number).dtypes)["_o"] == "bigint"
    sketch, quantile = (F.kll_sketch_agg_bigint, F.kll_sketch_get_quantile_bigint) if whole else (F.kll_sketch_agg_double, F.kll_sketch_get_quantile_double)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    sketched = join_null_safe(df.select(*keys, number.alias("_o")).where(F.col("_o").isNotNull()), hot, keys).groupBy(*keys, "_n").agg(sketch("_o", F.lit(SKETCH_SIZE)).alias("_s"))
    parts = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("_n") / F.lit(rows)).cast("int"))
    # A sketch answers a fixed list of ranks only, in order; a key takes those that cut it into its number of parts.
    ranks = sketched.withColumn("_parts", parts).where("_parts > 1").withColumn("_q", quantile("_s", F.array(*[F.lit(i / MAX_BUCKETS) for i in range(1, MAX_BUCKETS)])))
    splits = ranks.select(*keys, F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.element_at("_q", F.floor(i * MAX_BUCKETS / F.col("_parts")).cast("int"))).alias("_splits"))
    # Sketches draw at random: written once, so that every use of the buckets sees the same ones.
    splits = written(splits, "bucket-splits")
    renamed = splits.select(*[F.col(k).alias(f"_split_{i}") for i, k in enumerate(keys)], "_splits")
    condition = F.lit(True)
    for i, key in enumerate(keys):
        condition = condition & F.col(key).eqNullSafe(F.col(f"_split_{i}"))
    placed = df.withColumn("_o", number).join(renamed, condition, "left")
    bucket = F.coalesce(F.size(F.filter("_splits", lambda s: s <= F.col("_o"))), F.lit(0))
    return placed.withColumn(name, F.when(F.col("_splits").isNull(), 0).otherwise(bucket)).drop("_o", "_splits", *[f"_split_{i}" for i in range(len(keys))])


def _scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], bucket: Column | None,
          inclusive: bool, fold, empty) -> DataFrame:
    """Running sums or maxima: inside the buckets, and over the totals of the buckets before."""
    names = list(values)
    base = df.withColumn("_bucket", bucket) if bucket is not None else measured_buckets(df, keys, order[0])
    for name in names:
        base = base.withColumn(f"_v_{name}", values[name])
    totals = base.groupBy(*keys, "_bucket").agg(*[fold(f"_v_{n}").alias(f"_t_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *[fold(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = join_null_safe(base, offsets, [*keys, "_bucket"])
    for name in names:
        out = out.withColumn(name, empty(F.col(f"_o_{name}"), fold(f"_v_{name}").over(inside)))
    return out.drop("_bucket", *[f"_v_{n}" for n in names], *[f"_o_{n}" for n in names])


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                   bucket: Column | None = None, inclusive: bool = False) -> DataFrame:
    """Add one running sum per entry of *values* (exclusive of the row itself by default).

    *bucket*, where given, must be a non-decreasing function of the first order column, such as its day; by default keys
    are cut where they have many rows (`measured_buckets`).  A null key or bucket is a key or bucket like any other.
    Per-bucket totals are partially aggregated before the shuffle; their prefix sums give every bucket its starting value.
    """
    return _scan(df, keys, order, values, bucket, inclusive, F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0)))


def running_maxima(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                   bucket: Column | None = None, inclusive: bool = False) -> DataFrame:
    """Add one running maximum per entry of *values*, null before the first value."""
    return _scan(df, keys, order, values, bucket, inclusive, F.max, lambda before, own: F.greatest(before, own))


def ordinals(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None = None,
             name: str = "ordinal") -> DataFrame:
    """row_number() over (keys, order), computed bucket by bucket."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, bucket, inclusive=True)


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, seconds: int,
                   open_start: bool = False, name: str = "recent") -> DataFrame:
    """Rows of the same key within the last *seconds* up to each row (the start belongs to the span
    unless *open_start*).

    A sliding frame would visit the whole span again for every row.  Instead each
    row puts a marker at the start of its span on the time line; the count is the
    running count at the row minus the running count at its marker.  Returns one
    row per input row with the keys, *row_id*, the time and the count; rows that
    are equal in these are counted apart and come back apart.
    """
    span = seconds * 1_000_000
    marker_rank = 2 if open_start else 0
    once = df.groupBy(*keys, row_id, ts).agg(F.count(F.lit(1)).alias("_times"))
    line = once.select(*keys, row_id, ts, "_times", F.explode(F.array(
        F.struct(epoch_micros(ts).alias("at"), F.lit(1).alias("rank")),
        F.struct((epoch_micros(ts) - span).alias("at"), F.lit(marker_rank).alias("rank")))).alias("e")).select(
        *keys, row_id, ts, "_times", F.col("e.at").alias("_at"), F.col("e.rank").alias("_rank"))
    is_row = F.col("_rank") == 1
    counted = running_totals(line, keys, ["_at", "_rank", row_id], {"_c": F.when(is_row, F.col("_times")).otherwise(0).cast("bigint")},
                             inclusive=True)
    found = counted.groupBy(*keys, row_id, ts, "_times").agg(
        (F.max(F.when(is_row, F.col("_c"))) - F.max(F.when(~is_row, F.col("_c")))).alias(name))
    return found.select(*keys, row_id, ts, name, F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).drop("col")


def trailing_rows(df: DataFrame, keys: Sequence[str], ordinal: str, rows: int,
                  aggregates: dict[str, Column], block: int = DEFAULT_BLOCK,
                  include_current: bool = True) -> DataFrame:
    """Aggregates over the last *rows* rows of a key, given its ordinals.

    Every key is cut into blocks of *block* ordinals; the last rows of a block
    are repeated in the next one as context.
    """
    if rows > block:
        raise ValueError("block must be at least as long as the window")
    position = F.col(ordinal) - 1
    home = F.floor(position / F.lit(block))
    both = (df.withColumn("_home", home)
            .withColumn("_bucket", F.explode(
                F.when(position % block >= block - rows, F.array(home, home + 1)).otherwise(F.array(home)))))
    first, last = (-(rows - 1), 0) if include_current else (-rows, -1)
    window = Window.partitionBy(*keys, "_bucket").orderBy(ordinal).rowsBetween(first, last)
    for name, agg in aggregates.items():
        both = both.withColumn(name, agg.over(window))
    return both.where(F.col("_bucket") == F.col("_home")).drop("_home", "_bucket")


def gap_sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int,
                 sums: dict[str, Column]) -> DataFrame:
    """Sessions separated by more than *gap_seconds* of silence, with summed measures.

    Rows are first folded into buckets no longer than the gap: two rows of one
    bucket are never far enough apart to be in different sessions.  Only the
    folded buckets, whose number is bounded by the covered time, reach the
    per-key window.
    """
    span = gap_seconds * 1_000_000
    folded = (df.withColumn("_at", epoch_micros(ts))
              .groupBy(*keys, F.floor(F.col("_at") / F.lit(span)).alias("_bucket"))
              .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"),
                   F.count(F.lit(1)).alias("_rows"),
                   *[F.sum(col).alias(f"_s_{name}") for name, col in sums.items()]))
    by_time = Window.partitionBy(*keys).orderBy("_bucket")
    opens = F.col("_first") - F.lag("_last").over(by_time) > F.lit(span)
    numbered = folded.withColumn(
        "session_no", F.sum(F.when(F.coalesce(opens, F.lit(True)), 1).otherwise(0)).over(by_time))
    return numbered.groupBy(*keys, "session_no").agg(
        F.timestamp_micros(F.min("_first")).cast("timestamp_ntz").alias("session_start"),
        F.timestamp_micros(F.max("_last")).cast("timestamp_ntz").alias("session_end"),
        F.sum("_rows").cast("bigint").alias("rows_in_session"),
        *[F.sum(f"_s_{name}").alias(name) for name in sums])
