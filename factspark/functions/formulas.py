"""The built-in formulas as columns. Each takes bound inputs and gives an Outcome: a column whose nulls are rows that go
(a formula with no output filters), or an array whose elements become rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import NUMBERS, Bound, as_type, entity_hash, equal, plain

#: White space of ECMAScript.
SPACE = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
Inputs = dict[str, Bound]


class Outcome(NamedTuple):
    column: Column
    type: str | dict[str, str]  # of a record's fields, if it is one
    rows: bool = False  # the column is an array: one row for each element


def _when(test: Column) -> Outcome:
    return Outcome(F.when(test, F.lit(True)), "boolean")


def _text(value: Bound) -> Column:
    return as_type(value, "string").column


def _of_text(change: Callable[[Column], Column], kind: str = "string", rows: bool = False):
    return lambda i: Outcome(change(_text(i["of"])), kind, rows)


def _compare(test: Callable[[Column, Column], Column]):
    """Numbers with numbers, strings with strings; other pairs have no answer, nor has NaN."""

    def run(i: Inputs) -> Outcome:
        a, b = plain(i["this"]), plain(i["than"])
        out = F.lit(False)
        if a.type == b.type and a.type in ("integer", "string", "bigint", "boolean"):
            return _when(test(a.column, b.column))
        if {a.type, b.type} <= {*NUMBERS, "any"}:
            x, y = as_type(a, "float").column, as_type(b, "float").column
            out = F.coalesce(test(x, y) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))
        if {a.type, b.type} <= {"string", "any"}:
            out = out | F.coalesce(test(_text(a), _text(b)), F.lit(False))
        return _when(out)

    return run


def _numbers(whole: Callable[[Column, Column], Column] | None, real: Callable[[Column, Column], Column], second: str, big: Callable | None = None):
    def run(i: Inputs) -> Outcome:
        a, b = plain(i["of"]), plain(i[second])
        if a.type == b.type == "integer" and whole:
            return Outcome(whole(a.column, b.column), "integer")
        if a.type == b.type == "bigint" and big:
            return Outcome(big(a.column, b.column).cast("decimal(38,0)"), "bigint")
        if not {a.type, b.type} <= {*NUMBERS, "any"}:
            return Outcome(F.lit(None).cast("double"), "float")
        return Outcome(real(as_type(a, "float").column, as_type(b, "float").column), "float")

    return run


def _type(i: Inputs) -> Outcome:
    value = i["of"]
    if value.type.startswith("entity:"):
        return Outcome(F.when(value.column.isNotNull(), F.lit("reference")), "string")
    finite = lambda d: ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
    if value.type == "float":
        d = value.column
        return Outcome(F.when(finite(d), F.when(d == F.floor(d), "integer").otherwise("float")), "string")
    if value.type == "any":
        d = value.column["d"]
        return Outcome(F.when(d.isNull() | finite(d), value.column["t"]), "string")
    return Outcome(F.when(value.column.isNotNull(), F.lit(value.type)), "string")


def _refer(i: Inputs) -> Outcome:
    """Hash of a value or of a record of several; a reference stays."""
    if set(i) == {"of"}:
        value = plain(i["of"])
        if value.type == "reference":
            return Outcome(value.column, "reference")
        hashed = entity_hash({"": value})
        return Outcome(F.when(value.column["t"] == "reference", value.column["s"]).otherwise(hashed) if value.type == "any" else hashed, "reference")
    return Outcome(entity_hash(i), "reference")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def glob(text: Column, pattern: Column) -> Column:
    """Whether a pattern matches a whole text: * any run, ? one character, backslash makes the next one plain."""
    parts = F.regexp_extract_all(pattern, F.lit("(?s)(\\\\.|.)"), F.lit(1))
    escaped = lambda p: (F.char_length(p) == 2) & p.startswith("\\")
    regex = F.transform(parts, lambda p: F.when(p == "*", ".*").when(p == "?", ".").when(escaped(p), _quoted(F.substring(p, 2, 1))).otherwise(_quoted(p)))
    return F.rlike(text, F.concat(F.lit("(?s)\\A"), F.array_join(regex, ""), F.lit("\\z")))


def _like(i: Inputs) -> Outcome:
    text = _text(i["text"])
    return Outcome(F.when(glob(text, _text(i["pattern"])), text), "string")


def _units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def _slice(i: Inputs) -> Outcome:
    """From start up to end, negative ones from the end; of bytes, or of text in UTF-16 units as text/length counts them.
    Half of a character outside of the basic plane becomes U+FFFD."""
    value = plain(i["of"])
    kind = "bytes" if value.type == "bytes" else "string"
    column = as_type(value, kind).column
    size = F.octet_length(column) if kind == "bytes" else _units(column)
    place = lambda c: F.when(c < 0, F.greatest(size + c, F.lit(0))).otherwise(F.least(c, size)).cast("int")
    start, end = (place(as_type(i[k], "integer").column) for k in ("start", "end"))
    length = F.greatest(end - start, F.lit(0))
    cut = F.substring(column, start + 1, length)
    if kind == "string":
        halves = F.substring(F.encode(column, "UTF-16BE"), 2 * start + 1, 2 * length)
        cut = F.when(F.char_length(column) == size, cut).otherwise(F.decode(halves, "UTF-16BE"))
    return Outcome(cut, kind)


def _whole_power(base: Column, exponent: Column) -> Column:
    """Exact power of decimals by squaring; null where it has over 38 digits, or for a negative exponent."""
    one = F.lit(1).cast("decimal(38,0)")
    left, out, square = exponent.cast("bigint"), one, base
    for bit in range(7):
        out = F.when(F.shiftright(left, bit).bitwiseAND(F.lit(1)) == 1, F.try_multiply(out, square).cast("decimal(38,0)")).otherwise(out)
        square = F.try_multiply(square, square).cast("decimal(38,0)")
    unit = F.when((base == -1) & (F.pmod(left, F.lit(2)) == 1), -one).when(base == 0, F.when(left == 0, one).otherwise(base)).otherwise(one)
    return F.when(exponent < 0, F.lit(None)).when(F.abs(base) <= 1, unit).when(left < 128, out)


def _to_text(i: Inputs) -> Outcome:
    raw = F.make_valid_utf8(as_type(i["of"], "bytes").column.cast("string"))
    return Outcome(F.regexp_replace(raw, "\\A\\ufeff", ""), "string")


def _same(i: Inputs) -> Outcome:
    return Outcome(i["of"].column, i["of"].type)


def _not(i: Inputs) -> Outcome:
    return Outcome(~as_type(i["of"], "boolean").column, "boolean")


def _includes(i: Inputs) -> Outcome:
    return _when(F.contains(_text(i["this"]), _text(i["slice"])))


def _abs(i: Inputs) -> Outcome:
    kind = "integer" if i["of"].type == "integer" else "float"
    return Outcome(F.abs(as_type(i["of"], kind).column), kind)


BUILT_IN: dict[str, Callable[[Inputs], Outcome]] = {
    "==": _same,
    ">": _compare(lambda a, b: a > b),
    "<": _compare(lambda a, b: a < b),
    ">=": _compare(lambda a, b: a >= b),
    "<=": _compare(lambda a, b: a <= b),
    "!": _not,
    "data/type": _type,
    "data/refer": _refer,
    "text/like": _like,
    "text/concat": lambda i: Outcome(F.concat(_text(i["of"]), _text(i["with"])), "string"),
    "text/words": _of_text(lambda c: F.split(c, SPACE + "+", -1), rows=True),
    "text/lines": _of_text(lambda c: F.split(c, "\\r\\n|\\r|\\n", -1), rows=True),
    "text/case/upper": _of_text(F.upper),
    "text/case/lower": _of_text(F.lower),
    "text/trim": _of_text(lambda c: F.regexp_replace(c, f"\\A{SPACE}+|{SPACE}+\\z", "")),
    "text/trim/start": _of_text(lambda c: F.regexp_replace(c, f"\\A{SPACE}+", "")),
    "text/trim/end": _of_text(lambda c: F.regexp_replace(c, f"{SPACE}+\\z", "")),
    "text/includes": _includes,
    "text/slice": _slice,
    "text/length": _of_text(_units, "integer"),
    "text/to/utf8": _of_text(lambda c: F.encode(c, "UTF-8"), "bytes"),
    "utf8/to/text": _to_text,
    "+": _numbers(F.try_add, lambda a, b: a + b, "with"),
    "-": _numbers(F.try_subtract, lambda a, b: a - b, "by"),
    "*": _numbers(F.try_multiply, lambda a, b: a * b, "by"),
    "/": _numbers(None, F.try_divide, "by"),
    "%": _numbers(F.try_mod, F.try_mod, "by", F.try_mod),
    "**": _numbers(None, F.pow, "by", _whole_power),
    "math/absolute": _abs,
}


def python_formula(function: Callable[..., list], returns: str, kind: str | dict[str, str], names: list[str]) -> Callable[[Inputs], Outcome]:
    """A formula from a Python function of plain values that returns a list of outputs; it runs on Arrow batches.

    returns: Spark type of an output, a struct if outputs are dicts; kind: its type here, or those of its fields; names: inputs in the order of the function's arguments.
    """
    @F.pandas_udf(f"array<{returns}>")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([list(function(*row)) for row in zip(*columns)])

    return lambda i: Outcome(run(*(plain(i[n]).column for n in names)), kind, True)


def is_equal(a: Bound, b: Bound) -> Column:
    return equal(a, b)
