"""The contract of a source, and sources that wrap another."""

from __future__ import annotations

from collections import OrderedDict
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame, SparkSession

from ..values import Bound


class Scan(NamedTuple):
    """Rows with the asked-for parts: names (the, of, is, or those of star members) to columns of df. keys: sets of
    parts that no two rows agree on."""

    df: DataFrame
    parts: dict[str, Bound]
    keys: tuple[frozenset[str], ...] = ()


class FactSource(Protocol):
    spark: SparkSession

    def scan(self, the: object = None, of: object = None, is_: object = None, type: str | None = None) -> Scan:
        """Facts with these constants (None: any); parts the, of, is."""

    def star(self, attributes: list[str]) -> Scan | None:
        """One row for each entity with all attributes, if one scan has them; parts of and each attribute."""


class InspectingSource:
    """Records what is asked of another source."""

    def __init__(self, source: FactSource):
        self.source, self.spark, self.scans = source, source.spark, []

    def scan(self, the=None, of=None, is_=None, type=None) -> Scan:
        self.scans.append({k: v for k, v in (("the", the), ("of", of), ("is", is_)) if v is not None})
        return self.source.scan(the, of, is_, type)

    def star(self, attributes: list[str]) -> Scan | None:
        found = self.source.star(attributes)
        if found is not None:
            self.scans.append({"star": list(attributes)})
        return found


class CachingSource:
    """Keeps the rows of the latest scans in executors' memory and disk, as many scans as `capacity`."""

    def __init__(self, source: FactSource, capacity: int = 32):
        self.source, self.spark, self.capacity = source, source.spark, capacity
        self.kept: OrderedDict[str, Scan] = OrderedDict()

    def _keep(self, key: str, make) -> Scan | None:
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        found = make()
        if found is not None:
            self.kept[key] = found = Scan(found.df.persist(), found.parts, found.keys)
            if len(self.kept) > self.capacity:
                self.kept.popitem(last=False)[1].df.unpersist()
        return found

    def scan(self, the=None, of=None, is_=None, type=None) -> Scan:
        return self._keep(repr((the, of, is_, type)), lambda: self.source.scan(the, of, is_, type))

    def star(self, attributes: list[str]) -> Scan | None:
        return self._keep(repr(sorted(attributes)), lambda: self.source.star(attributes))

    def clear(self) -> None:
        for found in self.kept.values():
            found.df.unpersist()
        self.kept.clear()
