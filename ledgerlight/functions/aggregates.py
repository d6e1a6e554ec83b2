"""Where users add their own aggregates: a partial state per task, merged by key.

Tasks fold their Arrow batches into one small state for each key before anything is shuffled, so a key with a third of all
rows sends one state a task.  States of a key meet in one merge, which sees them in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

# Keys that a task folds before it hands their states on.
HELD_KEYS = 50_000


@dataclass(frozen=True)
class Aggregate:
    """A user aggregate over rows of *columns*.

    fold(state or None, rows of one key) gives the next state, merge(states) one of many, finish(state) the result; a state
    is a tuple of the *state* schema, a result one of the *result* schema.
    """

    columns: Sequence[str]
    state: str
    result: str
    fold: Callable[[tuple | None, pd.DataFrame], tuple]
    merge: Callable[[list[tuple]], tuple]
    finish: Callable[[tuple], tuple]

    def by(self, rows: DataFrame, *keys: str) -> DataFrame:
        """One row a key, null being a key like any other."""
        kinds = dict(rows.dtypes)
        head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
        names, results = _names(self.state), _names(self.result)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[Any, tuple] = {}
            for batch in batches:
                for key, part in batch.groupby(list(keys), dropna=False, sort=False):
                    key = tuple(None if pd.isna(k) else k for k in key)
                    held[key] = self.fold(held.get(key), part)
                if len(held) > HELD_KEYS:
                    yield _frame(held, keys, names)
                    held = {}
            if held:
                yield _frame(held, keys, names)

        def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[Any, list[tuple]] = {}

            def done(some: dict[Any, list[tuple]]) -> pd.DataFrame:
                return _frame({k: self.finish(self.merge(x) if len(x) > 1 else x[0]) for k, x in some.items()}, keys, results)

            for batch in batches:
                if batch.empty:
                    continue
                plain = batch.astype(object)
                # Beside a null pandas makes whole numbers floats.
                for name in (n for n in whole if batch[n].dtype.kind == "f"):
                    plain[name] = pd.Series([v if pd.isna(v) else int(v) for v in batch[name]], dtype=object)
                for row in plain.itertuples(index=False, name=None):
                    key = tuple(None if pd.isna(k) else k for k in row[:len(keys)])
                    held.setdefault(key, []).append(row[len(keys):])
                # Keys come in order, so only the last one may go on.
                last = {key: held.pop(key)}
                if held:
                    yield done(held)
                held = last
            if held:
                yield done(held)

        # States are few bytes but much work for Python, so tasks are counted by cores: sizes would put all into one task.
        tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
        states = rows.select(*dict.fromkeys([*keys, *self.columns])).repartition(tasks).mapInPandas(partial, f"{head}, {self.state}")
        whole = [name for name, kind in states.dtypes if kind in ("tinyint", "smallint", "int", "bigint")]
        ordered = states.repartition(tasks, *keys).sortWithinPartitions(*keys)
        return ordered.mapInPandas(merged, f"{head}, {self.result}")


def _names(schema: str) -> list[str]:
    return [part.split()[0].strip("`") for part in schema.split(",")]


def _frame(values: dict[Any, tuple], keys: Sequence[str], names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *value) for key, value in values.items()], columns=[*keys, *names], dtype=object)
