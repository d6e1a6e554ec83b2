"""Streams with state of their own: cool-downs, bursts, session spend, redaction across chunks.

Each job keeps one small state per key (spend: per bucket of keys) and frees it by a timer once the key has been silent for so long that the state
cannot matter any more (redaction: with the last chunk).  Rows are handled one at a time, in event order within a micro-batch; of a micro-batch's rows a key
holds only the few numbers it needs, and the trigger options of the source bound the micro-batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlight.operators.dlp import _candidates, _resolve
from ledgerlight.streaming.runner import WATERMARK

# Characters held back between chunks, and their bounds.
HOLD_BACK, HOLD_BACK_MIN, HOLD_BACK_MAX = 256, 128, 512

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Silence after which a session's spend is given up.
SESSION_SILENCE_S = 7 * 86_400
# Buckets that sessions are dealt to: no more tasks than these have work, and each holds the state of so many parts of the sessions.
BUCKETS = 256


def in_event_order(frames: Iterable[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """(micros, request_id, values of the columns) of the rows, by time and then id."""
    parts: list[list[np.ndarray]] = [[] for _ in range(2 + len(columns))]
    for frame in frames:
        parts[0].append(frame["created_at"].astype("datetime64[us]").astype("int64").to_numpy())
        parts[1].append(frame["request_id"].to_numpy())
        for at, column in enumerate(columns, 2):
            parts[at].append(frame[column].to_numpy())
    if parts[0]:
        arrays = [np.concatenate(p) for p in parts]
        for row in np.lexsort((arrays[1], arrays[0])).tolist():
            yield tuple(a[row].item() if hasattr(a[row], "item") else a[row] for a in arrays)


class Expiring(StatefulProcessor):
    """A processor with one value of state and one event-time timer: the state goes after *silence* microseconds without a row."""

    schema = "at bigint"

    def __init__(self, key: str, silence: int):
        self.key, self.silence = key, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)
        self.newest = handle.getValueState("newest", "at bigint")

    def later(self, micros: int) -> None:
        """Remember the newest row and set the timer anew."""
        seen = self.newest.get() if self.newest.exists() else None
        if seen is not None and seen[0] >= micros:
            return
        if seen is not None:
            self.handle.deleteTimer(self.due(seen[0]))
        self.newest.update((micros,))
        self.handle.registerTimer(self.due(micros))

    def due(self, micros: int) -> int:
        return (micros + self.silence) // 1000 + 1

    def clear(self) -> None:
        self.state.clear()
        self.newest.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter(())

    def close(self) -> None:
        pass


class Cooldown(Expiring):
    """State: time of the last failure."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, newest, out = self.state.get()[0] if self.state.exists() else None, None, []
        for at, request, failed in in_event_order(rows, ["failed"]):
            out.append((request, last is not None and at - last < self.silence))
            newest = at
            if failed:
                last = at
        if last is not None:
            self.state.update((last,))
            self.later(newest)
        yield pd.DataFrame({self.key: [key[0]] * len(out), "request_id": [r for r, _ in out], "cooling": [c for _, c in out]})


class Bursts(Expiring):
    """State: times of the failures since the last alert that are within the span; never more than the threshold."""

    schema = "times array<bigint>"

    def __init__(self, key: str, silence: int, threshold: int):
        super().__init__(key, silence)
        self.threshold = threshold

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, newest, fired = list(self.state.get()[0]) if self.state.exists() else [], None, []
        for at, request in in_event_order(rows, []):
            times = [x for x in times if x > at - self.silence] + [at]
            newest = at
            if len(times) >= self.threshold:
                fired.append((request, len(times)))
                times = []
        if newest is not None:
            self.state.update((times,))
            self.later(newest)
        if fired:
            yield pd.DataFrame({self.key: [key[0]] * len(fired), "request_id": [r for r, _ in fired], "failures": [n for _, n in fired]})


class Spend(StatefulProcessor):
    """State: units spent so far and time of the newest row of every session of a bucket.

    A call for each session costs more than its few rows do, so a bucket's sessions are handled together, in arrays.  Its state
    is read and written whole; its timer is the one of the session that has been silent for longest, or an earlier one.
    """

    def __init__(self, key: str, kind: str, silence: int, limit: int):
        self.key, self.silence, self.limit = key, silence, limit
        self.schema = f"sessions array<{kind}>, units array<bigint>, newest array<bigint>, due bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        # Rows without a session have a bucket to themselves.
        codes, sessions = (np.zeros(len(rows), np.int64), [None]) if key[0] < 0 else pd.factorize(rows[self.key])
        sessions = sessions if key[0] < 0 else sessions.tolist()
        at = rows["created_at"].astype("datetime64[us]").astype("int64").to_numpy()
        request, units = rows["request_id"].to_numpy(), np.maximum(rows["units"].to_numpy(), 0).astype(np.int64)
        order = np.lexsort((request, at, codes))
        codes, at, request, units = codes[order], at[order], request[order], units[order]

        kept, due = self.read()
        held = [kept.get(x) for x in sessions]
        known = np.array([x is not None for x in held])[codes]
        spent, newest = (np.array([x[i] if x else 0 for x in held], np.int64)[codes] for i in range(2))
        first = np.r_[True, codes[1:] != codes[:-1]]
        # Rows of a micro-batch come before its timers, so a silence may show here first.
        before = np.where(first, newest, np.where(known, np.maximum(newest, np.r_[0, at[:-1]]), np.r_[0, at[:-1]]))
        starts = first | (at - before > self.silence)
        carried = first & known & (at - before <= self.silence)
        start = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
        sums = np.cumsum(units) - units
        total = sums - sums[start] + np.where(carried, spent, 0)[start]

        last = np.r_[first[1:], True]
        ends = np.where(known, np.maximum(at, newest), at)[last]
        kept.update(zip((sessions[c] for c in codes[last].tolist()), zip((total + units)[last].tolist(), ends.tolist())))
        self.write(kept, due)
        own = rows[self.key].to_numpy()[order] if sessions != [None] else np.full(len(order), None)
        yield pd.DataFrame({self.key: own, "request_id": request, "units_before": total, "over_budget": total >= self.limit})

    def read(self) -> tuple[dict, int | None]:
        """(units, newest) by session, and the time of the timer."""
        found = self.state.get()
        if found is None:
            return {}, None
        sessions, units, newest, due = found
        return dict(zip(sessions, zip(units, newest))), due

    def write(self, kept: dict, due: int | None) -> None:
        """Keep the sessions; *due* is the time of a timer that has not fired."""
        if not kept:
            self.state.clear()
            return
        earliest = self.due(min(newest for _, newest in kept.values()))
        if due is None or earliest < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(earliest)
            due = earliest
        units, newest = zip(*kept.values())
        self.state.update((list(kept), list(units), list(newest), due))

    def due(self, micros: int) -> int:
        return (micros + self.silence) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self.write({x: state for x, state in self.read()[0].items() if self.due(state[1]) > now}, None)
        return iter(())

    def close(self) -> None:
        pass


def with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "eventTime", keyed: bool = True) -> DataFrame:
    """Append-mode output of a processor, with the key before it if *keyed*; state lives in RocksDB, changelogs in the checkpoint folder."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {schema}" if keyed else schema, "append", mode)


def timed(rows: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return rows.withWatermark("created_at", delay)


def cooldown(rows: DataFrame, key: str, seconds: int) -> DataFrame:
    """Flag requests that arrive within *seconds* after a failure of their entity.

    Needs created_at, request_id and failed.
    """
    return with_state(timed(rows), key, Cooldown(key, seconds * 1_000_000), "request_id bigint, cooling boolean")


def failure_alerts(rows: DataFrame, key: str, seconds: int, threshold: int) -> DataFrame:
    """Burst alerts: *threshold* failures within *seconds*; after an alert counting starts anew."""
    return with_state(timed(rows), key, Bursts(key, seconds * 1_000_000, threshold), "request_id bigint, failures bigint")


def session_spend(rows: DataFrame, key: str, limit_units: int, silence_seconds: int = SESSION_SILENCE_S, buckets: int = BUCKETS) -> DataFrame:
    """Spend before every request of a session, in units, and whether it had reached the limit.

    A session that is silent for *silence_seconds* (7 days) beyond the watermark has ended; a later request starts at zero.
    Rows without a session are one session, rows without units spend nothing.
    """
    kind = dict(rows.dtypes)[key]
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    dealt = timed(rows).withColumn("units", F.coalesce("units", F.lit(0))).withColumn("_bucket", bucket)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        # One null would make floating-point numbers of all keys of an Arrow batch; the bucket tells which are null.
        dealt = dealt.withColumn(key, F.coalesce(key, F.lit(0).cast(kind)))
    return with_state(dealt, "_bucket", Spend(key, kind, silence_seconds * 1_000_000, limit_units),
                      f"{key} {kind}, request_id bigint, units_before bigint, over_budget boolean", keyed=False)


def safe_cut(length: int, spans: list[tuple], hold_back: int) -> int:
    """Where the text may be cut: before the held-back end, and not inside a finding."""
    cut = max(0, length - hold_back)
    for *_, start, end, _ in spans:
        if start < cut < end:
            cut = start
    return cut


class ChunkRedaction(StatefulProcessor):
    """State: the text not yet emitted, where its last chunk began, and how many findings the text has had.

    Its last chunk frees the state of a text; chunks carry no time, so a text that never ends keeps its few characters.
    """

    def __init__(self, key: str, today: dt.date, keep: int):
        self.key, self.today, self.keep = key, today, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", "text string, borders array<int>, events bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pending, borders, events = self.state.get() if self.state.exists() else ("", [], 0)
        borders, out, ended = list(borders), [], False
        chunks = sorted(x for frame in rows for x in zip(frame["chunk_no"].tolist(), frame["chunk"].tolist(), frame["is_last"].tolist()))
        for number, chunk, last in chunks:
            if pending:
                borders.append(len(pending))
            pending, ended = pending + (chunk or ""), bool(last)
            pending, borders, events, row = self.emit(key[0], number, pending, borders, events, ended)
            if row:
                out.append(row)
        if ended:
            self.state.clear()
        else:
            self.state.update((pending, borders, events))
        if out:
            yield self.frame(out)

    def emit(self, name, number: int, pending: str, borders: list[int], events: int, everything: bool):
        """Cut off and redact what may go; a finding over a border of chunks is told as crossing."""
        spans = _resolve(_candidates(pending, self.today)) if pending else []
        cut = len(pending) if everything else safe_cut(len(pending), spans, self.keep)
        if not cut:
            return pending, borders, events, None
        text, types, crossing, cursor = [], [], 0, 0
        for _, kind, _, start, end, _ in spans:
            if end <= cut:
                text += [pending[cursor:start], f"[REDACTED:{kind}]"]
                cursor = end
                types.append(kind)
                crossing += any(start < b < end for b in borders)
        text.append(pending[cursor:cut])
        events += len(types)
        row = (name, number, "".join(text), ",".join(dict.fromkeys(types)), events, crossing)
        return pending[cut:], [b - cut for b in borders if b > cut], events, row

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "chunk_no", "redacted", "types", "events", "crossing"])

    def close(self) -> None:
        pass


def chunk_redaction(rows: DataFrame, key: str, today: dt.date, hold_back: int = HOLD_BACK) -> DataFrame:
    """Redacted output of chunked texts; the last characters wait for the next chunk.

    Needs chunk_no, chunk and is_last.  A cut that would fall inside a finding moves to its start, so a secret across a
    border is never emitted in halves.  Each row has the types found in it, the findings of the text so far (events), and how
    many of its own ran over a border of chunks (crossing).
    """
    keep = min(HOLD_BACK_MAX, max(HOLD_BACK_MIN, hold_back))
    return with_state(rows, key, ChunkRedaction(key, today, keep), "chunk_no bigint, redacted string, types string, events bigint, crossing bigint", "none")
