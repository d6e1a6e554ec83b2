"""Durations such as 30s, 15m, 2h, 1d, 1w, 1mo and the reset times they imply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlight.functions.money import as_col

# Fixed values.
DURATION = r"^(\d+)(s|mo|m|h|d|w)$"
RESET_DURATION = r"^(\d+)([a-z]+)"
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def duration_seconds(duration: Column | str, as_of: Column) -> Column:
    """Length in seconds; months run to the same (clamped) day N months after *as_of*."""
    text = as_col(duration)
    amount = F.nullif(F.regexp_extract(text, DURATION, 1), F.lit("")).cast("bigint")
    unit = F.regexp_extract(text, DURATION, 2)
    target = F.add_months(F.to_date(as_of), amount.cast("int"))
    months = F.date_diff(target, F.to_date(as_of)).cast("bigint") * 86400
    seconds = F.when(unit == "mo", months)
    for name, length in UNIT_SECONDS.items():
        seconds = seconds.when(unit == name, amount * length)
    return seconds


def _shift(moment: Column, *, days: Column | None = None, seconds: Column | None = None) -> Column:
    zero = F.lit(0)
    return moment + F.make_dt_interval(days if days is not None else zero, zero, zero,
                                       (seconds if seconds is not None else zero).cast("decimal(18,6)"))


def next_reset_local(duration: Column | str, now: Column) -> Column:
    """Next reset in wall-clock time, *now* being wall-clock time without zone.

    Hours, minutes and seconds are aligned within the enclosing day, hour and
    minute; a result past midnight falls on the next day at the remaining hour.
    """
    text = as_col(duration)
    amount = F.nullif(F.regexp_extract(text, RESET_DURATION, 1), F.lit("")).cast("bigint")
    unit = F.regexp_extract(text, RESET_DURATION, 2)
    midnight = F.date_trunc("day", now).cast("timestamp_ntz")
    tomorrow = _shift(midnight, days=F.lit(1))
    month_start = F.add_months(F.trunc(now, "month"), 1).cast("timestamp_ntz")
    monday = F.next_day(F.to_date(now), "Mon").cast("timestamp_ntz")
    hour, minute = F.hour(now).cast("bigint"), F.minute(now).cast("bigint")
    second = F.floor(F.second(now)).cast("bigint")
    step = F.nullif(amount, F.lit(0))

    def aligned(part: Column) -> Column:
        return part + step - part % step

    def at(hours: Column, minutes: Column, seconds: Column) -> Column:
        """Wall-clock time of today, or of tomorrow when the hour runs over."""
        base = F.when(hours >= 24, tomorrow).otherwise(midnight)
        return _shift(base, seconds=(hours % 24) * 3600 + minutes * 60 + seconds)

    next_minute = aligned(minute)
    next_second = aligned(second)
    carried_minute = minute + F.floor(next_second / 60)
    by_day = (F.when(amount == 1, tomorrow).when(amount == 7, monday).when(amount == 30, month_start)
              .otherwise(_shift(midnight, days=amount.cast("int"))))
    result = (F.when(amount.isNull(), tomorrow)
              .when((unit == "mo") & (amount == 1), month_start)
              .when(unit == "mo", F.lit(None).cast("timestamp_ntz"))
              .when(unit.isin("d", "h", "m", "s") & (amount == 0), now)
              .when(unit == "d", by_day)
              .when(unit == "h", at(aligned(hour), F.lit(0), F.lit(0)))
              .when(unit == "m", at(hour + F.floor(next_minute / 60), next_minute % 60, F.lit(0)))
              .when(unit == "s", at(hour + F.floor(carried_minute / 60), carried_minute % 60, next_second % 60))
              .otherwise(tomorrow))
    return result


def next_reset_utc(duration: Column | str, now_utc: Column, zone: Column | str) -> Column:
    """Next reset as UTC time without zone, for *now_utc* and a zone name."""
    name = as_col(zone)
    local = F.from_utc_timestamp(now_utc.cast("timestamp"), name).cast("timestamp_ntz")
    return F.to_utc_timestamp(next_reset_local(duration, local).cast("timestamp"), name).cast("timestamp_ntz")
