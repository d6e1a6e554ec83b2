"""Domain tables as views over the star-schema test tables.

Every view is a lazy DataFrame of plain column expressions, so column pruning
and the filters on native columns reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import spread

# Reference moments of the jobs over the test tables; no job reads the clock.
USAGE_AS_OF = dt.datetime(2001, 11, 5)
EVENTS_AS_OF = dt.datetime(2024, 1, 31)
CHAT_START = dt.datetime(2024, 1, 1)

# Fixed values of the usage view.
PROVIDERS = ("openai", "anthropic", "vertex_ai", "azure")
MODEL_SIZES = (3, 7, 13, 34, 70, 8, 180)


def text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def ntz(moment: dt.datetime | str) -> Column:
    """Literal timestamp without time zone."""
    return F.lit(str(moment)).cast("timestamp_ntz")


def pick(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("bigint"), ts)


def request_second() -> Column:
    """Second of its day in which a request of the usage log starts."""
    return (F.col("l_orderkey") * 13 + F.col("l_partkey") * 7 + F.col("l_linenumber") * 601) % 86400


def request_start() -> Column:
    return plus_seconds(F.col("l_shipdate"), request_second())


def telemetry_view(events: DataFrame) -> DataFrame:
    """Security telemetry from the event table, batch or streaming."""
    score = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("session_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type"),
        F.when(F.col("event_type") == "error", F.lit("failure")).otherwise(F.lit("success")).alias("status"),
        F.col("value").alias("latency_ms"),
        score.alias("score"),
        (score >= 80).alias("injection_detected"),
        ((score >= 60) & (score < 90)).alias("dlp_detected"),
        (F.when(score >= 90, F.lit("high")).when(score >= 70, F.lit("medium"))
         .when(score >= 50, F.lit("low")).otherwise(F.lit("none"))).alias("risk"),
        F.when(score % 2 == 0, F.lit("input")).otherwise(F.lit("output")).alias("stage"),
    )


class Tables:
    """Access to one data folder; nothing is read until a job runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- usage log -------------------------------------------------------
    def usage(self, since: dt.datetime | None = None, until: dt.datetime | None = None,
              with_user: bool = False) -> DataFrame:
        """One row per request.

        The user and the tags live in the order, everything else in the line; a
        job that needs neither does not pay for the join.  *since* (inclusive)
        and *until* (exclusive) are also applied to the stored ship date, so
        that whole row groups are skipped.
        """
        out = self.usage_lines(since, until, with_user).select(*self.usage_columns(with_user))
        if since is not None:
            out = out.where(F.col("start_time") >= ntz(since))
        if until is not None:
            out = out.where(F.col("start_time") < ntz(until))
        return out

    def usage_lines(self, since: dt.datetime | None = None, until: dt.datetime | None = None,
                    with_user: bool = False) -> DataFrame:
        """The stored columns of every request, much narrower than the usage columns made of them: what a job shuffles."""
        line = self.raw("lineitem")
        if since is not None:
            line = line.where(F.col("l_shipdate") >= ntz(dt.datetime(since.year, since.month, since.day)))
        if until is not None:
            line = line.where(F.col("l_shipdate") < ntz(until))
        if with_user:
            orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
            line = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        return line

    def usage_columns(self, with_user: bool = False) -> list[Column]:
        """The columns of usage, from those of usage_lines."""
        cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
        percent = F.floor((F.lit(1.0) - F.col("l_discount")) * 100 + 0.5)
        second, start = request_second(), request_start()
        vendor = pick(F.col("l_partkey") % 4, PROVIDERS)
        unknown_cache = (F.col("l_orderkey") + F.col("l_linenumber")) % 11 == 0
        quantity = F.col("l_quantity").cast("bigint")
        columns = [
            F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"),
                        text(cents)).alias("request_id"),
            F.col("l_orderkey").alias("session_id"),
            F.concat(F.lit("k"), text("l_suppkey")).alias("api_key"),
            F.when(F.col("l_partkey") % 89 == 0, F.lit("")).otherwise(
                F.concat(vendor, F.lit("/chat-"), text(F.col("l_partkey") % 25), F.lit("-"),
                         text(pick(F.col("l_partkey") % 7, MODEL_SIZES)), F.lit("b"))).alias("model"),
            F.when(F.col("l_partkey") % 97 != 0, vendor).alias("provider"),
            F.concat(F.lit("group-"), text(F.col("l_partkey") % 5)).alias("model_group"),
            F.when(F.col("l_linenumber") % 3 == 0, F.lit("embedding")).otherwise(F.lit("completion")).alias("call_type"),
            start.alias("start_time"),
            plus_seconds(F.col("l_shipdate"), second + quantity).alias("end_time"),
            (quantity * 10).alias("prompt_tokens"),
            (quantity * 4).alias("completion_tokens"),
            (cents * percent / F.lit(10_000_000.0)).alias("spend"),
            F.when(~unknown_cache, F.when(F.col("l_linestatus") == "F", F.lit("True")).otherwise(
                F.lit("False"))).alias("cache_hit"),
            F.when(~unknown_cache, F.when(F.col("l_linestatus") == "F", quantity * 5).otherwise(
                F.lit(0).cast("bigint"))).alias("cache_read_tokens"),
            F.when(F.col("l_linenumber") == 3, quantity * 2).otherwise(
                F.lit(0).cast("bigint")).alias("cache_creation_tokens"),
            F.when(F.col("l_returnflag") == "R", F.lit("failure")).otherwise(F.lit("success")).alias("status"),
            F.when(F.col("l_linenumber") <= 4, F.concat(F.lit("agent-"), text(F.col("l_suppkey") % 6))).alias("agent_id"),
            F.when(F.col("l_linenumber") == 1, F.concat(F.lit("srv"), text(F.col("l_partkey") % 3))).alias("mcp_server"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("deployment_no"),
            F.col("l_linenumber").alias("call_no"),
            quantity.alias("quantity"),
            F.col("l_discount").alias("discount"),
        ]
        if with_user:
            user = F.concat(F.lit("u"), text("o_custkey"))
            agent_tag = F.concat(F.lit('"User-Agent: agent-'), text("l_linenumber"), F.lit('"'))
            priority = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
            tags = (F.when(F.col("l_orderkey") % 53 == 0, F.lit(None).cast("string"))
                    .when(F.col("l_orderkey") % 7 == 0, F.lit("[]"))
                    .when(F.col("l_linenumber") == 2,
                          F.concat(F.lit("["), priority, F.lit(","), priority, F.lit(","), agent_tag, F.lit("]")))
                    .otherwise(F.concat(F.lit("["), priority, F.lit(","), agent_tag, F.lit("]"))))
            end_user = (F.when(F.col("l_linenumber") % 4 == 0, user)
                        .when(F.col("l_linenumber") % 4 == 1, F.lit(""))
                        .otherwise(F.concat(F.lit("e"), text(F.col("l_partkey") % 200))))
            columns += [user.alias("user_id"), tags.alias("request_tags"), end_user.alias("end_user")]
        return columns

    # ---- dimensions ------------------------------------------------------
    def keys(self) -> DataFrame:
        """Keys with a non-negative balance; requests of the others find no key."""
        return self.raw("supplier").where("s_acctbal >= 0").select(
            F.concat(F.lit("k"), text("s_suppkey")).alias("token"),
            F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("alias-"), text(F.col("s_suppkey") % 40))).alias("key_alias"),
            F.col("s_name").alias("key_name"),
            F.concat(F.lit("t"), text("s_nationkey")).alias("team_id"),
            F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("p"), text(F.col("s_suppkey") % 8))).alias("project_id"),
        )

    def teams(self) -> DataFrame:
        return self.raw("nation").select(
            F.concat(F.lit("t"), text("n_nationkey")).alias("team_id"),
            F.col("n_name").alias("team_alias"),
            F.concat(F.lit("o"), text("n_regionkey")).alias("organization_id"),
            (F.col("n_nationkey") * 100.0).alias("team_max_budget"),
            (F.col("n_nationkey").cast("bigint") * 1000).alias("team_tpm_limit"),
            F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey").cast("bigint") * 10).alias("team_rpm_limit"),
        )

    def projects(self) -> DataFrame:
        return self.raw("region").select(
            F.concat(F.lit("p"), text("r_regionkey")).alias("project_id"), F.col("r_name").alias("project_alias"))

    def organizations(self) -> DataFrame:
        return self.raw("region").select(
            F.concat(F.lit("o"), text("r_regionkey")).alias("organization_id"),
            F.col("r_name").alias("organization_alias"))

    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.concat(F.lit("u"), text("c_custkey")).alias("user_id"),
            F.when(F.col("c_acctbal") >= 0,
                   F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))
                   ).alias("user_email"),
            F.col("c_name").alias("user_alias"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"),
            (F.col("c_acctbal") < 0).alias("blocked"),
        )

    def prices(self) -> DataFrame:
        """One price entry per part: flat rates and, for larger parts, price bands."""
        rate = F.col("p_retailprice") / 10_000_000.0
        size = F.col("p_size").cast("bigint")
        return self.raw("part").select(
            F.col("p_partkey").alias("part_id"),
            rate.alias("input_rate"),
            (rate * 4.0).alias("output_rate"),
            F.when(F.col("p_size") % 2 == 0, rate / 2.0).alias("cache_read_rate"),
            F.when(F.col("p_size") % 3 == 0, rate * 6.0).alias("reasoning_rate"),
            F.when(F.col("p_size") > 40, rate * 2.0).alias("override_rate"),
            size.alias("band_size"),
            F.col("p_type").alias("price_class"),
        )

    # ---- security telemetry ---------------------------------------------
    def telemetry(self) -> DataFrame:
        return telemetry_view(self.raw("events"))

    # ---- conversations, documents ---------------------------------------
    def chat(self) -> DataFrame:
        return self.raw("conversations").select(
            "conv_id", "turn", "role", "text",
            plus_seconds(ntz(CHAT_START), F.col("conv_id") * 60 + F.col("turn") * 7).alias("ts"))

    def documents(self) -> DataFrame:
        return spread(self.raw("documents"), "doc_id")

    def pages(self) -> DataFrame:
        return spread(self.raw("pages"), "page_id")

    def vectors(self) -> DataFrame:
        return self.raw("embeddings")

    def cases(self) -> DataFrame:
        labels = self.raw("labels")
        return self.raw("documents").join(labels, "doc_id").select("doc_id", "text", "quality", "toxic")
