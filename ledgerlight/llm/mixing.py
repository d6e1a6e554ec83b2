"""Mixing sources to target weights.

Tokens are aggregated per source; a source's rate is its target divided by its size.  A document is emitted
floor(rate) times, plus one copy if a hash-seeded draw falls below the fraction.  Built-in functions only.

Targets: the sources' weights share a total; no target exceeds *limit* times its source's size, the excess goes
to the other sources by weight until none is above.  That fixed point is min(limit * size, level * weight), and
the level follows from one ordered pass over the sources (one row per source), because sources reach their
limit in order of limit * size / weight.

Defined cases: a null text has size 0; a null source is a source of its own, the last one; a null doc_id draws
like an empty one; repeated rows are counted and drawn alike; a source without words has target 0; an empty
table gives an empty result.  Columns of the input are kept by `mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import BLANK_WORDS
from ledgerlight.session import written

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
LIMIT = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORDS)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from rows (source, size).  The ordered passes see one row per source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long").alias("weight"))
    all_rows = Window.partitionBy()
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    capped = ranked.select("*", (F.col("source_size") * limit).alias("cap"), (F.sum("source_size").over(all_rows) * F.lit(share)).alias("total"),
                           F.sum("weight").over(all_rows).alias("all_weight"))
    # The level that would hold if every source before this one were at its limit and no other.
    level = ((F.col("total") - F.coalesce(F.sum("cap").over(filling), F.lit(0)))
             / (F.col("all_weight") - F.coalesce(F.sum("weight").over(filling), F.lit(0))))
    levels = capped.select("*", level.alias("level"))
    free = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)["level"]
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(free, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def rates(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """(size, source_size, target, copies, row): the last holds the columns of the input row."""
    sized = docs.select("source", "doc_id", word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    # Written first, one row per source: its size is known when the join is planned, so texts move only if it is large.
    goals = written(source_targets(sized.select("source", "size"), **targets), "mix-targets").withColumnRenamed("source", "goal")
    joined = sized.join(goals, F.col("source").eqNullSafe(F.col("goal")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.select("size", "source_size", "target", copies.alias("copies"), "row")


def mix(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with its own columns."""
    counted = rates(docs, seed, **targets).where("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    return rates(docs.select("doc_id", "source", "text")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
