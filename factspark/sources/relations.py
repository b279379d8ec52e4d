"""Ordinary tables as facts: a row is an entity, a column an attribute. Nothing is materialised as triples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..values import Bound, Ref, constant, equal, natural, spark_type, tagged
from .base import Scan


@dataclass
class Relation:
    """A table under a namespace. key: its entity's column, or columns, different in each row; or none (then the row's
    content is the entity).

    columns: member to column; refs: members that hold another relation's key; arrays: members that are collections.
    Nulls are absent facts.
    """

    name: str
    df: DataFrame
    key: str | list[str] | None
    columns: dict[str, str] = field(default_factory=dict)
    refs: dict[str, str] = field(default_factory=dict)
    arrays: dict[str, str] = field(default_factory=dict)

    def entity(self) -> Bound:
        if isinstance(self.key, str):
            return Bound(F.col(self.key), f"entity:{self.name}")
        if self.key:
            return Bound(F.concat(F.lit(f"{self.name}:"), F.concat_ws(":", *(F.col(k).cast("string") for k in self.key))), "reference")
        # with its length before each cell, so that different rows never read alike; a null has none
        cells = [F.coalesce(F.concat(F.char_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for c in sorted(self.columns.values()) for x in [F.col(c).cast("string")]]
        return Bound(F.concat(F.lit(f"{self.name}:"), F.sha2(F.concat(*cells), 256)), "reference")

    def value(self, member: str) -> Bound:
        if member in self.arrays:
            return Bound(F.when(F.col(self.arrays[member]).isNotNull(), F.concat(natural(self.entity()), F.lit(f"#{member}"))), "reference")
        column = self.columns[member]
        if member in self.refs:
            return Bound(F.col(column), f"entity:{self.refs[member]}")
        data = self.df.schema[column].dataType.simpleString()
        kind = spark_type(data)
        if kind == "other":
            raise TypeError(f"{self.name}/{member} has a column of type {data}")
        wide = {"integer": "bigint", "float": "double", "string": "string"}.get(kind)
        return Bound(F.col(column).cast(wide) if wide and data != wide else F.col(column), kind)

    def members(self) -> list[str]:
        return [*self.columns, *self.arrays]


class RelationSource:
    def __init__(self, relations: list[Relation]):
        self.relations = {r.name: r for r in relations}
        self.spark: SparkSession = relations[0].df.sparkSession

    def _parts(self, attribute: str) -> tuple[Relation, str] | None:
        name, _, member = attribute.rpartition("/")
        relation = self.relations.get(name)
        return (relation, member) if relation and member in relation.members() else None

    def star(self, attributes: list[str]) -> Scan | None:
        """One scan of a table for attributes of its rows. Without a key equal rows are one entity, so what one row has,
        the entity has; its hash is only computed where it is asked for."""
        found = [self._parts(a) for a in attributes]
        if not all(found) or len({p[0].name for p in found}) > 1:
            return None
        relation = found[0][0]
        values = {a: relation.value(m) for a, (_, m) in zip(attributes, found)}
        entity = relation.entity()
        df = relation.df.select(entity.column.alias("of"), *(v.column.alias(f"a{i}") for i, v in enumerate(values.values())))
        df = df.where(self._there([*self._nullable(relation), *(f"a{i}" for i in range(len(values)))]))
        return Scan(df, {"of": Bound(F.col("of"), entity.type)} | {a: Bound(F.col(f"a{i}"), v.type) for i, (a, v) in enumerate(values.items())}, self._keys(relation, {m: a for a, (_, m) in zip(attributes, found)}))

    @staticmethod
    def _keys(relation: Relation, parts: dict[str, str]) -> tuple[frozenset[str], ...]:
        """The entity, and a member that shows the key column itself. parts: members to the names of their parts."""
        if not relation.key:
            return ()
        return (frozenset({"of"}), *(frozenset({n}) for m, n in parts.items() if relation.columns.get(m) == relation.key))

    @staticmethod
    def _nullable(relation: Relation) -> list[str]:
        """The entity, if a null key may leave it out."""
        return ["of"] if relation.key else []

    @staticmethod
    def _there(names: list[str]) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & F.col(n).isNotNull()
        return out

    def scan(self, the=None, of=None, is_=None, type=None) -> Scan:
        if the is None:
            return self._any_attribute(of, is_)
        found = relation = None
        if the.startswith("the/"):
            relation = self.relations.get(the[4:])
            df, entity, value = (relation.df, relation.entity(), Bound(F.lit(the[4:]), "string")) if relation else (None, None, None)
        elif found := self._parts(the):
            relation = found[0]
            df, entity, value = relation.df, relation.entity(), relation.value(found[1])
        else:
            df = None
        if df is None:
            empty = self.spark.createDataFrame([], "the string, of string, is string")
            return Scan(empty, {"the": Bound(F.col("the"), "string"), "of": Bound(F.col("of"), "reference"), "is": Bound(F.col("is"), "string")})
        rows = df.select(F.lit(the).alias("the"), entity.column.alias("of"), value.column.alias("is")).where(self._there([*self._nullable(relation), "is"]))
        parts = {"the": Bound(F.col("the"), "string"), "of": Bound(F.col("of"), entity.type), "is": Bound(F.col("is"), value.type)}
        keys = (frozenset({"of"}),) if relation and relation.key else ()
        if found and keys:
            keys = self._keys(relation, {found[1]: "is"})
        return Scan(self._held(rows, parts, of, is_), parts, keys)

    @staticmethod
    def _held(rows: DataFrame, parts: dict[str, Bound], of, is_) -> DataFrame:
        for name, wanted in (("of", of), ("is", is_)):
            if wanted is None:
                continue
            have = parts[name]
            if have.type.startswith("entity:"):
                prefix = have.type[7:] + ":"
                if isinstance(wanted, Ref):
                    # the key itself is compared, so the filter reaches the file scan
                    rows = rows.where(F.lit(False) if not wanted.id.startswith(prefix) else F.col(name) == F.lit(wanted.id[len(prefix) :]).cast(rows.schema[name].dataType))
                else:
                    rows = rows.where(F.col(name) == F.lit(wanted))
            else:
                rows = rows.where(equal(have, constant(wanted)))
        return rows

    def _any_attribute(self, of, is_) -> Scan:
        """All attributes of the relations that could hold the entity, as tagged values; arrays give their elements."""
        out = None
        name = of.id.split(":")[0] if isinstance(of, Ref) and ":" in of.id else None
        for relation in self.relations.values():
            if name and relation.name != name:
                continue
            entity = natural(relation.entity())
            cells = [F.struct(F.lit(f"{relation.name}/{m}").alias("the"), F.when(v.column.isNotNull(), tagged(v)).alias("is")) for m in relation.members() for v in [relation.value(m)]]
            rows = relation.df.select(entity.alias("of"), F.explode(F.array(*cells)).alias("c")).select("c.the", "of", "c.is")
            for member, column in relation.arrays.items():
                inner = relation.df.schema[column].dataType.elementType.simpleString()
                kind = spark_type(inner)
                each = relation.df.select(relation.value(member).column.alias("of"), F.posexplode(F.col(column)).alias("k", "e"))
                value = tagged(Bound(F.col("e").cast("double") if kind == "float" else F.col("e").cast("bigint") if kind == "integer" else F.col("e"), kind))
                rows = rows.unionByName(each.where("e is not null").select(F.concat(F.lit("["), F.col("k").cast("string"), F.lit("]")).alias("the"), "of", value.alias("is")))
            rows = rows.where("of is not null and is is not null")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            from .triples import SCHEMA

            out = self.spark.createDataFrame([], SCHEMA).drop("cause")
        parts = {"the": Bound(F.col("the"), "string"), "of": Bound(F.col("of"), "reference"), "is": Bound(F.col("is"), "any")}
        return Scan(self._held(out, parts, of, is_), parts)
