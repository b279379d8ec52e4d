"""Nested selection: leaves outside of lists are the key of a group, each list gathers its distinct members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import Var
from ..values import constant, natural


def _column(shape: object, cols: dict[Var, Column]) -> Column:
    """A shape inside a list's member: lists in it hold their one member."""
    if isinstance(shape, dict):
        return F.struct(*(_column(s, cols).alias(k) for k, s in shape.items()))
    if isinstance(shape, (list, tuple)):
        return F.array(*(_column(s, cols) for s in shape))
    return cols[shape] if isinstance(shape, Var) else natural(constant(shape))


def select_shape(df: DataFrame, cols: dict[Var, Column], shape: object) -> DataFrame:
    """A row for each group, with a column for each top-level name (`items` for a shape that is a list).

    Several lists in one group are gathered independently. Groups don't depend on the order of rows; lists are sorted.
    """
    keys: list[Column] = []
    lists: list[Column] = []

    def split(s: object) -> object:
        if isinstance(s, dict):
            return {k: split(x) for k, x in s.items()}
        if isinstance(s, (list, tuple)):
            lists.append(_column(s[0], cols))
            return ("list", len(lists) - 1)
        keys.append(_column(s, cols))
        return ("key", len(keys) - 1)

    plan = split(shape)
    if not lists:
        made = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys))).distinct()
    else:
        named = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)), *(x.alias(f"l{i}") for i, x in enumerate(lists)))
        gathered = [F.sort_array(F.collect_set(f"l{i}")).alias(f"l{i}") for i in range(len(lists))]
        made = named.groupBy(*(f"k{i}" for i in range(len(keys)))).agg(*gathered)
        if not keys:
            made = made.where(F.size("l0") > 0)

    def build(p: object) -> Column:
        if isinstance(p, dict):
            return F.struct(*(build(x).alias(k) for k, x in p.items()))
        return F.col(f"{'l' if p[0] == 'list' else 'k'}{p[1]}")

    return made.select(*(build(p).alias(k) for k, p in plan.items())) if isinstance(plan, dict) else made.select(build(plan).alias("items"))
