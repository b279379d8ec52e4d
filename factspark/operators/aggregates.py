"""Aggregates of a rule's answers: Spark's own, and folds by user code."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_() -> Column:
    return F.count(F.lit(1))


def sum_(name: str) -> Column:
    return F.sum(name)


def min_(name: str) -> Column:
    return F.min(name)


def max_(name: str) -> Column:
    return F.max(name)


def avg_(name: str) -> Column:
    return F.avg(name)


def collect_(name: str) -> Column:
    """Distinct values, sorted."""
    return F.sort_array(F.collect_set(name))


@dataclass
class Fold:
    """open() -> state; merge(state, row as dict) -> state (or None if it changed the state itself); close(state) -> result.

    With combine(state, state) -> state each partition folds its rows on an executor and the driver combines one state
    for each; without, the driver folds all rows in turn, a partition at a time: use Spark's aggregates where they do.
    """

    open: Callable[[], object]
    merge: Callable[[object, dict], object]
    close: Callable[[object], object] = lambda state: state
    combine: Callable[[object, object], object] | None = None

    def _merge(self, state: object, row: dict) -> object:
        new = self.merge(state, row)
        return state if new is None else new

    def run_by(self, df: DataFrame, by: list[str], returns: str) -> DataFrame:
        """A row for each group: its key and the columns that close gives as a dict. Each task folds its rows of a group,
        then a group's states, one for each task, are combined; so no task gathers the rows of a large group."""
        if self.combine is None:
            raise ValueError("a fold by groups needs combine")
        keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            states: dict[tuple, object] = {}
            for frame in frames:
                for key, row in zip(zip(*(frame[k] for k in by)), frame.to_dict("records")):
                    states[key] = self._merge(states[key] if key in states else self.open(), row)
            yield pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*by, "__state"])

        def whole(frame: pd.DataFrame) -> pd.DataFrame:
            total = self.open()
            for s in frame["__state"]:
                total = self.combine(total, pickle.loads(bytes(s)))
            return pd.DataFrame([{k: frame[k].iloc[0] for k in by} | self.close(total)])

        return df.mapInPandas(part, f"{keys}, __state binary").groupBy(*by).applyInPandas(whole, f"{keys}, {returns}")

    def run(self, df: DataFrame) -> object:
        if self.combine is None:
            state = self.open()
            for row in df.toLocalIterator():
                state = self._merge(state, row.asDict(recursive=True))
            return self.close(state)

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = self.open()
            for frame in frames:
                for row in frame.to_dict("records"):
                    state = self._merge(state, row)
            yield pd.DataFrame({"state": [pickle.dumps(state)]})

        states = [pickle.loads(bytes(r["state"])) for r in df.mapInPandas(part, "state binary").collect()]
        total = self.open()
        for s in states:
            total = self.combine(total, s)
        return self.close(total)
