"""Types of values, their columns, and content hashes.

A bound variable has a column and a type: boolean, integer, bigint, float, string, bytes, reference, "entity:<name>"
(a reference kept as the key of a relation), or any. A value of type any is a struct of a tag and one field for each
kind, because one attribute may hold values of several types; a known type stays a plain column.
"""

from __future__ import annotations

import decimal
import hashlib
import math
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_FIELDS = {"s": "string", "l": "bigint", "d": "double", "b": "boolean", "x": "binary", "n": "decimal(38,0)"}
ANY = "struct<t:string," + ",".join(f"{k}:{v}" for k, v in ANY_FIELDS.items()) + ">"
#: Field of a tagged value that holds each type.
HOME = {"boolean": "b", "integer": "l", "float": "d", "bigint": "n", "string": "s", "bytes": "x", "reference": "s"}
SQL_TYPES = {"boolean": "boolean", "integer": "bigint", "float": "double", "bigint": "decimal(38,0)", "string": "string", "bytes": "binary", "reference": "string", "any": ANY}
NUMBERS = ("integer", "float")
_FROM_SPARK = {"boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "float", "double": "float", "string": "string", "binary": "bytes"}


@dataclass(frozen=True)
class Ref:
    """A reference to an entity, as a constant."""

    id: str


class Bound(NamedTuple):
    column: Column
    type: str


def type_of(value: object) -> str:
    """Type of a Python value; whole floats are integers, big whole numbers are decimals."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer" if -(2**63) <= value < 2**63 else "bigint"
    if isinstance(value, decimal.Decimal):
        return "bigint"
    if isinstance(value, float):
        return "integer" if math.isfinite(value) and value.is_integer() and abs(value) < 2**63 else "float"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    if isinstance(value, Ref):
        return "reference"
    raise TypeError(f"{type(value).__name__} is no value: {value!r}")


def spark_type(name: str) -> str:
    """Type of a Spark column."""
    if name.startswith("decimal"):
        return "bigint" if name.endswith(",0)") else "float"
    if name in ("date", "timestamp", "timestamp_ntz"):
        return "string"
    return _FROM_SPARK.get(name, "any" if name.startswith("struct<t:") else "other")


def constant(value: object) -> Bound:
    kind = type_of(value)
    if kind == "null":
        return Bound(tagged(Bound(F.lit(None), "null")), "any")
    if kind == "integer":
        value = int(value)
    raw = value.id if isinstance(value, Ref) else bytes(value) if isinstance(value, bytearray) else value
    return Bound(F.lit(raw).cast(SQL_TYPES[kind]), kind)


def tagged(value: Bound) -> Column:
    """The value as a struct of type any. Doubles that are whole are integers, as everywhere."""
    column, kind = plain(value)
    if kind == "any":
        return column
    if kind == "float":
        whole = (column == F.floor(column)) & (F.abs(column) < F.lit(2.0**63))
        tag, long, double = F.when(whole, "integer").otherwise("float"), F.when(whole, column.try_cast("bigint")), F.when(~whole, column)
        cells = {"l": long, "d": double}
    else:
        tag, cells = F.lit(kind), {} if kind == "null" else {HOME[kind]: column}
    return F.struct(tag.alias("t"), *(cells.get(k, F.lit(None)).cast(t).alias(k) for k, t in ANY_FIELDS.items()))


def plain(value: Bound) -> Bound:
    """The same with entity keys as references."""
    if value.type.startswith("entity:"):
        return Bound(F.concat(F.lit(value.type[7:] + ":"), value.column.cast("string")), "reference")
    return value


def as_type(value: Bound, kind: str) -> Bound:
    """The value as a column of a type; null where it is of another."""
    if value.type == kind:
        return value
    value = plain(value)
    if value.type == kind:
        return value
    if kind == "any":
        return Bound(tagged(value), "any")
    if value.type == "any":
        if kind == "float":
            return Bound(F.coalesce(value.column["d"], value.column["l"].cast("double")), kind)
        tag = F.when(value.column["t"] == kind, value.column[HOME[kind]])
        return Bound(tag, kind)
    if kind == "float" and value.type == "integer":
        return Bound(value.column.cast("double"), kind)
    return Bound(F.lit(None).cast(SQL_TYPES[kind]), kind)


def common(a: Bound, b: Bound) -> tuple[Bound, Bound]:
    """Both as one type in which they can be compared."""
    if a.type == b.type:
        return a, b
    a, b = plain(a), plain(b)
    if a.type == b.type:
        return a, b
    if {a.type, b.type} == set(NUMBERS):
        return as_type(a, "float"), as_type(b, "float")
    return as_type(a, "any"), as_type(b, "any")


def equal(a: Bound, b: Bound) -> Column:
    a, b = common(a, b)
    return a.column.eqNullSafe(b.column) if a.type == "any" else a.column == b.column


def natural(value: Bound) -> Column:
    """The column for a result: references as strings, one of type any as its tagged struct."""
    return plain(value).column


def float_text(d: Column) -> Column:
    """A finite double that is not zero as its 53-bit whole mantissa and power of two, the same text in every language."""
    size = F.abs(d)
    # the logarithm may be off by one next to a power of two
    near = F.least(F.floor(F.log2(size)).cast("int"), F.lit(1023))
    scaled = size / F.pow(F.lit(2.0), near.cast("double"))
    power = F.when(scaled >= 2, near + 1).when(scaled < 1, near - 1).otherwise(near)
    whole = (F.when(scaled >= 2, scaled / 2).when(scaled < 1, scaled * 2).otherwise(scaled) * F.lit(2.0**52)).cast("bigint")
    text = F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"), F.lit("p"), (power - 52).cast("string"))
    return F.when(F.isnan(d) | (size == F.lit(math.inf)), d.cast("string")).otherwise(text)


def float_text_of(value: float) -> str:
    """The same of a Python float."""
    if not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    mantissa, power = math.frexp(abs(value))
    return f"{'-' if value < 0 else ''}{int(mantissa * 2**53)}p{power - 53}"


def canonical(cells: dict[str, Bound]) -> Column:
    """Cells in order of their names, each with type, length and text, so different records have different strings."""
    parts = []
    for name in sorted(cells):
        value = plain(cells[name])
        if value.type in ("any", "float"):
            c = tagged(value)  # whole floats are integers
            text = F.coalesce(c["s"], c["l"].cast("string"), float_text(c["d"]), c["b"].cast("string"), F.hex(c["x"]), c["n"].cast("string"), F.lit(""))
            tag: Column = c["t"]
        else:
            text = F.hex(value.column) if value.type == "bytes" else value.column.cast("string")
            tag = F.lit(value.type)
        parts += [F.lit(f"{name}:"), tag, F.lit(":"), F.char_length(text).cast("string"), F.lit(":"), text, F.lit(";")]
    return F.concat(*parts) if parts else F.lit("")


def entity_hash(cells: dict[str, Bound]) -> Column:
    return F.sha2(canonical(cells), 256)


def hash_record(record: dict[str, object]) -> str:
    """The same hash of plain values, for facts asserted by the driver."""
    out = []
    for name in sorted(record):
        value = record[name]
        kind = type_of(value)
        text = {"null": lambda v: "", "boolean": lambda v: str(v).lower(), "bytes": lambda v: bytes(v).hex().upper(), "reference": lambda v: v.id, "integer": lambda v: str(int(v)), "float": float_text_of}.get(kind, str)(value)
        out.append(f"{name}:{kind}:{len(text)}:{text};")
    return hashlib.sha256("".join(out).encode()).hexdigest()
