"""Facts as triples (the, of, is), and the shredding of nested records into them."""

from __future__ import annotations

import decimal
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..values import ANY, ANY_FIELDS, HOME, Bound, Ref, as_type, constant, equal, hash_record, type_of

SCHEMA = f"the string, of string, is {ANY}, cause string"


def tag_value(value: object) -> dict:
    """A plain value as a tagged one."""
    kind = type_of(value)
    out: dict = {"t": kind, **dict.fromkeys(ANY_FIELDS)}
    if kind != "null":
        out[HOME[kind]] = value.id if isinstance(value, Ref) else int(value) if kind == "integer" else bytes(value) if kind == "bytes" else decimal.Decimal(value) if kind == "bigint" else value
    return out


def _identity(value: object) -> str:
    if isinstance(value, dict):
        return hash_record({k: Ref(_identity(v)) if isinstance(v, (dict, list, tuple)) else v for k, v in value.items()})
    return _identity({f"[{i}]": v for i, v in enumerate(value)})


def shred(record: dict) -> Iterable[tuple[str, Ref, object]]:
    """Facts (the, of, is) of a nested record: an object's entity is the hash of its content; an array is an entity with
    attributes [0], [1] and so on; members that are objects or arrays are references. Raises TypeError on other values."""
    entity = Ref(_identity(record))
    for name, value in record.items():
        if isinstance(value, (list, tuple)):
            value = {f"[{i}]": v for i, v in enumerate(value)}
        if isinstance(value, dict):
            yield from shred(value)
            yield name, entity, Ref(_identity(value))
        else:
            type_of(value)
            yield name, entity, value


def _one_type(kinds: set[str]) -> str:
    """The type in which facts of these types are scanned."""
    known = kinds - {"float", "integer"}
    if not known:
        return "integer" if kinds == {"integer"} else "float"
    return "any" if len(kinds) > 1 or known & {"null", "any"} else known.pop()


def _types(facts: Iterable[tuple[str, str]], before: dict[str, str] | None = None) -> dict[str, str]:
    """Type of each attribute, given (attribute, type) of facts and the types before them."""
    kinds: dict[str, set[str]] = {the: {kind} for the, kind in (before or {}).items()}
    for the, kind in facts:
        kinds.setdefault(the, set()).add(kind)
    return {the: _one_type(found) for the, found in kinds.items()}


class TripleSource:
    """Facts in a DataFrame of SCHEMA. Attributes whose facts are all of one type are scanned as a plain column of it.

    types: type by attribute, where known; else found by one aggregation over (the, type) when first needed.
    """

    def __init__(self, df: DataFrame, types: dict[str, str] | None = None, version: int = 0):
        self.df, self.spark, self.version, self._types = df, df.sparkSession, version, types

    @classmethod
    def create(cls, spark: SparkSession, facts: Iterable | dict) -> TripleSource:
        """From facts ({the, of, is} or (the, of, is)) or one nested record; equal facts are one."""
        rows = list(shred(facts)) if isinstance(facts, dict) else [(f["the"], f["of"], f["is"]) if isinstance(f, dict) else tuple(f) for f in facts]
        made = [(the, of.id if isinstance(of, Ref) else str(of), tag_value(value), "0") for the, of, value in rows]
        return cls(spark.createDataFrame(made, SCHEMA).dropDuplicates(["the", "of", "is"]), _types((the, v["t"]) for the, _, v, _ in made))

    @classmethod
    def from_nested(cls, df: DataFrame, namespace: str, key: str) -> TripleSource:
        """From a DataFrame of nested rows: entity "<namespace>:<key>"; arrays and maps are entities of their own."""
        import pyspark.sql.types as T

        parts: list[DataFrame] = []

        def walk(rows: DataFrame, prefix: str, fields: list[T.StructField]) -> None:
            for f in fields:
                c, here = F.col(f"v.{f.name}"), F.lit(f"{prefix}{f.name}")
                child = F.concat("of", F.lit(f"/{f.name}"))
                there = rows.where(c.isNotNull())
                if isinstance(f.dataType, T.StructType):
                    walk(there.select(child.alias("of"), c.alias("v")), prefix, f.dataType.fields)
                elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                    listed = isinstance(f.dataType, T.ArrayType)
                    each = there.select(child.alias("of"), (F.posexplode(c) if listed else F.explode(c)).alias("k", "e"))
                    name = F.concat(F.lit("["), F.col("k").cast("string"), F.lit("]")) if listed else F.col("k").cast("string")
                    inner = f.dataType.elementType if listed else f.dataType.valueType
                    if isinstance(inner, T.StructType):
                        member = F.concat("of", F.lit("/"), F.col("k").cast("string"))
                        parts.append(each.select(name.alias("the"), "of", Bound_any(member, "reference").alias("is")))
                        walk(each.select(member.alias("of"), F.col("e").alias("v")), prefix, inner.fields)
                    else:
                        parts.append(each.where(F.col("e").isNotNull()).select(name.alias("the"), "of", Bound_any(F.col("e"), None, inner).alias("is")))
                else:
                    parts.append(there.select(here.alias("the"), "of", Bound_any(c, None, f.dataType).alias("is")))
                    continue
                parts.append(there.select(here.alias("the"), "of", Bound_any(child, "reference").alias("is")))

        fields = [f for f in df.schema.fields if f.name != key]
        walk(df.select(F.concat(F.lit(f"{namespace}:"), F.col(key).cast("string")).alias("of"), F.struct(*(f.name for f in fields)).alias("v")), f"{namespace}/", fields)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cls(out.withColumn("cause", F.lit("0")).dropDuplicates(["the", "of", "is"]))

    @property
    def types(self) -> dict[str, str]:
        if self._types is None:
            rows = self.df.groupBy("the").agg(F.collect_set("is.t").alias("t")).collect()
            self._types = {r["the"]: _one_type(set(r["t"])) for r in rows}
        return self._types

    def scan(self, the=None, of=None, is_=None, type=None) -> Scan:
        from .base import Scan

        df = self.df
        if the is not None:
            df = df.where(F.col("the") == F.lit(the))
        if of is not None:
            df = df.where(F.col("of") == F.lit(of.id if isinstance(of, Ref) else str(of)))
        value = Bound(F.col("is"), "any")
        if is_ is not None:
            df = df.where(equal(value, constant(is_)))
        kind = self.types.get(the, "any") if the is not None else "any"
        if kind != "any":
            df = df.select("the", "of", as_type(value, kind).column.alias("is"))
        return Scan(df.select("the", "of", "is"), {"the": Bound(F.col("the"), "string"), "of": Bound(F.col("of"), "reference"), "is": Bound(F.col("is"), kind)}, (frozenset({"the", "of", "is"}),))

    def star(self, attributes: list[str]):
        return None

    def transact(self, instructions: Iterable[dict]) -> TripleSource:
        """A source after assertions ({"assert": fact}) and retractions ({"retract": fact}), the last for a fact counts.

        A fact that is there keeps its cause; new ones get this transaction's number.
        """
        last: dict = {}
        for x in instructions:
            for kind in ("assert", "retract"):
                if kind in x:
                    f = x[kind]
                    the, of, value = (f["the"], f["of"], f["is"]) if isinstance(f, dict) else f
                    tagged = tag_value(value)
                    last[the, of.id if isinstance(of, Ref) else str(of), repr(tagged)] = (kind, tagged)
        version = self.version + 1
        rows = lambda k: self.spark.createDataFrame([(the, of, v, str(version)) for (the, of, _), (kind, v) in last.items() if kind == k], SCHEMA)
        keys = ["the", "of", "is"]
        gone = rows("retract").select(*(F.col(k).alias(f"x_{k}") for k in keys))
        same = [F.col(k).eqNullSafe(F.col(f"x_{k}")) for k in keys]
        kept = self.df.join(F.broadcast(gone), same, "left_anti")
        # the driver holds a transaction's facts, so they may go to all tasks
        new = rows("assert").join(kept.select(*(F.col(k).alias(f"x_{k}") for k in keys)), same, "left_anti")
        # of what is retracted a type may stay, which is right, if wider than need be
        types = None if self._types is None else _types(((the, v["t"]) for (the, _, _), (kind, v) in last.items() if kind == "assert"), self._types)
        return TripleSource(kept.unionByName(new), types, version)


def Bound_any(column, kind: str | None, data_type=None):
    """A column as a tagged value."""
    from ..values import spark_type, tagged

    kind = kind or spark_type(data_type.simpleString())
    if kind == "other":
        raise TypeError(f"no type for {data_type.simpleString()}")
    return tagged(Bound(column.cast("bigint") if kind == "integer" else column.cast("double") if kind == "float" else column.cast("string") if kind == "string" else column, kind))


from .base import Scan  # noqa: E402
