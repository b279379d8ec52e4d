"""The fluent way to write rules: fact() describes entities, .where() and .when() deduce facts from others.

    Person = fact("person", name=str)
    Namesake = fact(name=str, other=object).where(lambda v: [
        Person(this=v.this, name=v.name), Person(this=v.other, name=v.name), same.not_(v.this, v.other)])
    Namesake(name="Ann").query(source)

Python's reserved words take a trailing underscore: not_, with_, is_, from_.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .operators.aggregates import Fold
from .operators.grouping import select_shape
from .plans.compiler import Compiler
from .plans.ir import ABSENT, Apply, Formula, Not, Recur, Rule, Same, Select
from .sources.base import FactSource
from .terms import WILDCARD, Var, Vars, plain_name
from .values import Ref, hash_record, natural, type_of

_KINDS = {str: "string", int: "integer", float: "float", bool: "boolean", bytes: "bytes", object: None}


def conjuncts(body: object) -> list:
    """What a body returned, as a flat list."""
    if isinstance(body, (Select, Formula, Same, Apply, Not, Recur)):
        return [body]
    if isinstance(body, (list, tuple, Match)) or (isinstance(body, Iterable) and not isinstance(body, (str, dict))):
        return [c for part in body for c in conjuncts(part)]
    raise TypeError(f"{body!r} is no conjunct")


class Fact:
    """A schema. As it stands, its facts are in the source: one for each member, all on one entity; without members, a
    tag. Members are types or literals; a literal is a filter."""

    def __init__(self, the: str | None, members: dict[str, object]):
        members = {plain_name(k): v for k, v in members.items()}
        if "_" in members:
            raise TypeError("Schema may not have a member _")
        this = members.pop("this", object)
        if this is not object and not isinstance(this, Fact):
            raise TypeError("this must be an entity")
        if not members and the is None:
            raise TypeError("Schema without members needs a namespace")
        for name, kind in members.items():
            if not (kind in _KINDS if isinstance(kind, type) else isinstance(kind, Fact) or self._literal(kind)):
                raise TypeError(f"Unsupported member {name}: {kind!r}")
        self.members = members
        self.the = the or hash_record({k: getattr(v, "__name__", getattr(v, "the", None)) or repr(v) for k, v in members.items()})[:16]
        self.vars = Vars()
        self._rule: Rule | None = None

    @staticmethod
    def _literal(kind: object) -> bool:
        try:
            return bool(type_of(kind))
        except TypeError:
            return False

    @property
    def cells(self) -> list[str]:
        return ["this", *self.members]

    @property
    def attributes(self) -> dict[str, str]:
        return {m: f"{self.the}/{m}" for m in self.members}

    def head(self) -> dict[str, Var]:
        return {c: self.vars[c] for c in self.cells}

    def rule(self) -> Rule:
        if self._rule is None:
            v, body = self.vars, []
            for name, kind in self.members.items():
                body.append(Select(f"{self.the}/{name}", v.this, v[name], _KINDS.get(kind) if isinstance(kind, type) else None))
                if not isinstance(kind, (type, Fact)) and kind is not None:
                    body.append(Same(v[name], kind))
            self._rule = Rule(self.head(), {"where": body or [Select(f"the/{self.the}", v.this, self.the)]}, self.the)
        return self._rule

    def terms(self, given: dict[str, object]) -> dict[str, object]:
        given = {plain_name(k): t for k, t in given.items()}
        unknown = set(given) - set(self.cells)
        if unknown:
            raise TypeError(f"{self.the} has no {sorted(unknown)}")
        return given

    def __call__(self, **terms: object) -> Match:
        return Match(self, self.terms(terms))

    match = __call__

    def not_(self, **terms: object) -> list:
        return [Not(self.use(self.terms(terms)))]

    def use(self, terms: dict[str, object]):
        return Apply(self.rule(), terms)

    def with_(self, **locals_: object) -> Fact:
        """The schema with variables that only bodies have. Any other name that a body uses is a variable too, so this
        states them and says where one is a member's already."""
        taken = sorted({plain_name(n) for n in locals_} & set(self.cells))
        if taken:
            raise TypeError(f"{self.the} has members {taken}")
        return self

    def where(self, body: Callable[[Vars], object]) -> Deduction:
        return Deduction(self, lambda v: {"where": body(v)})

    def when(self, body: Callable[[Vars], dict[str, object]]) -> Deduction:
        return Deduction(self, body)

    def assert_(self, this: object = None, **values: object) -> Assertion:
        """A fact of this schema with a value for each member; its entity is the hash of them unless it is given."""
        given = {plain_name(k): v for k, v in values.items()}
        if given.pop("the", self.the) != self.the:
            raise TypeError(f"Fact of another namespace than {self.the}")
        missing = set(self.members) - set(given)
        if missing or set(given) - set(self.members):
            raise TypeError(f"Required attributes are missing: {sorted(missing)}" if missing else f"{self.the} has no {sorted(set(given) - set(self.members))}")
        given = {k: Ref(v.this.id) if isinstance(v, Assertion) else v for k, v in given.items()}
        entity = this.this if isinstance(this, Assertion) else this if this is not None else Ref(hash_record(given | {"the": self.the}))
        return Assertion(self, entity, given)

    def select(self, shape: Callable[[Vars], object]) -> Shaped:
        return Shaped(self, shape)

    def map(self, function: Callable[[dict], object]) -> Mapped:
        return Mapped(self, function)

    def aggregate(self, fold: Fold | None = None, by: list[str] | None = None, returns: str = "", **named: Column) -> Aggregated:
        return Aggregated(self, fold, by or [], named, returns=returns)


#: Rules whose bodies are being read, the innermost last.
_STACK: list[Fact] = []


class Deduction(Fact):
    """A schema whose facts follow from a body. A body that uses its own schema is recursive."""

    def __init__(self, schema: Fact, body: Callable[[Vars], dict[str, object]], inductive: bool = False):
        self.members, self.the, self.vars, self._rule = schema.members, schema.the, schema.vars, None
        self.body, self.one_step, self._building = body, inductive, False

    def rule(self) -> Rule:
        if self._rule is None:
            if self._building:
                raise ReferenceError(f"{self.the} is used by a rule that it uses itself")
            self._building = True
            _STACK.append(self)
            try:
                branches = {k: conjuncts(b) for k, b in self.body(self.vars).items()}
            finally:
                self._building = False
                _STACK.pop()
            literal = [Same(self.vars[n], x) for n, x in self.members.items() if not isinstance(x, (type, Fact)) and x is not None]
            head = self.head()
            if not any(head["this"] in c.vars() for body in branches.values() for c in body if not isinstance(c, Recur)):
                del head["this"]  # nothing says what the entity is
                branches = {k: [Recur({n: t for n, t in c.args.items() if n != "this"}) if isinstance(c, Recur) else c for c in b] for k, b in branches.items()}
            self._rule = Rule(head, {k: b + literal for k, b in branches.items()}, self.the)
        return self._rule

    def use(self, terms: dict[str, object]):
        if self._building:
            if _STACK[-1] is not self:
                raise ReferenceError(f"{self.the} and {_STACK[-1].the} apply each other; only a rule's own recursion is supported")
            # what is not stated is what the rule's own head has
            full = {n: terms.get(n, v) for n, v in self.head().items()}
            return self.claim(**full) if self.one_step else Recur(full)
        rule = self.rule()
        return Apply(rule, {n: t for n, t in terms.items() if n in rule.head or t != WILDCARD})

    def claim(self, **terms: object) -> list:
        """Conjuncts that state the head; without `this` the entity is the hash of the members and the namespace."""
        given = self.terms(terms)
        out = [Same(t, self.vars[n]) for n, t in given.items() if t != self.vars[n]]
        if "this" not in given:
            out.append(Formula("data/refer", {n: t for n, t in given.items()} | {"the": self.the}, self.vars.this))
        return out

    induce = claim

    @property
    def inductive(self) -> Deduction:
        """The same rule with its recursion as one step: the next state instead of all that follow."""
        return Deduction(self, self.body, True)


@dataclass
class Assertion:
    schema: Fact
    this: Ref
    values: dict[str, object]

    def facts(self) -> Iterator[tuple[str, Ref, object]]:
        yield f"the/{self.schema.the}", self.this, self.schema.the
        for name, value in self.values.items():
            yield f"{self.schema.the}/{name}", self.this, value

    def __iter__(self) -> Iterator[dict]:
        return ({"assert": f} for f in self.facts())

    def retract(self) -> Iterator[dict]:
        return ({"retract": f} for f in self.facts())


class Match:
    """A schema with terms: a conjunct of a body, or a query."""

    def __init__(self, schema: Fact, terms: dict[str, object]):
        self.schema, self.given = schema, terms

    def __iter__(self) -> Iterator:
        used = self.schema.use(self.given)
        yield from used if isinstance(used, list) else [used]

    def negate(self) -> list:
        return [Not(tuple(self))]

    def _full(self) -> dict[str, object]:
        rule = self.schema.rule()
        return {n: self.given.get(n, Var(n)) for n in rule.head}

    def query(self, source: FactSource, formulas: dict | None = None, limit: int = 1000) -> DataFrame:
        """Distinct answers, a column for each member; lazy but for recursion."""
        terms = self._full()
        df, cols = Compiler(source, formulas, limit).rule(self.schema.rule(), terms)
        return df.select(*(natural(b).alias(n) for n, b in cols.items()))

    def plan(self, source: FactSource) -> str:
        """The order of conjuncts, and Spark's plan."""
        made = Compiler(source)
        df, _ = made.rule(self.schema.rule(), self._full())
        return "\n".join(made.steps) + "\n" + df._jdf.queryExecution().toString()

    def select(self, shape: Callable[[Vars], object]) -> Shaped:
        return Shaped(self.schema, shape, self.given)

    def map(self, function: Callable[[dict], object]) -> Mapped:
        return Mapped(self.schema, function, self.given)

    def aggregate(self, fold: Fold | None = None, by: list[str] | None = None, returns: str = "", **named: Column) -> Aggregated:
        return Aggregated(self.schema, fold, by or [], named, self.given, returns)


class _Derived:
    """Something made of a schema's answers; inside a body it is the plain schema."""

    given: dict[str, object] | None = None

    def match(self, **terms: object):
        out = self.__class__.__new__(self.__class__)
        out.__dict__ |= self.__dict__ | {"given": self.schema.terms(terms)}
        return out

    __call__ = match

    def __iter__(self) -> Iterator:
        return iter(Match(self.schema, self.given or {}))

    def _rows(self, source: FactSource) -> DataFrame:
        return Match(self.schema, self.given or {}).query(source)


class Shaped(_Derived):
    def __init__(self, schema: Fact, shape: Callable[[Vars], object], given: dict | None = None):
        self.schema, self.shape, self.given = schema, shape, given

    def query(self, source: FactSource) -> DataFrame:
        df = self._rows(source)
        return select_shape(df, {self.schema.vars[n]: df[n] for n in df.columns}, self.shape(self.schema.vars))


class Mapped(_Derived):
    def __init__(self, schema: Fact, function: Callable[[dict], object], given: dict | None = None):
        self.schema, self.function, self.given = schema, function, given

    def map(self, function: Callable[[object], object]) -> Mapped:
        """The results mapped again: what a rule concludes with is any function of what it concluded before."""
        before = self.function
        return Mapped(self.schema, lambda row: function(before(row)), self.given)

    def query(self, source: FactSource) -> Iterator[object]:
        """Results in the driver, one after another."""
        return (self.function(r.asDict(recursive=True)) for r in self._rows(source).toLocalIterator())

    def frame(self, source: FactSource, schema: str) -> DataFrame:
        """Results as rows of a DataFrame: the function runs on the executors and gives a dict of the schema's columns."""
        function = self.function

        def run(batches):
            for batch in batches:
                rows = [function(r) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

        kinds = to_arrow_schema(T._parse_datatype_string(schema))
        return self._rows(source).mapInArrow(run, schema)


class Aggregated(_Derived):
    def __init__(self, schema: Fact, fold: Fold | None, by: list[str], named: dict[str, Column], given: dict | None = None, returns: str = ""):
        self.schema, self.fold, self.by, self.named, self.given, self.returns = schema, fold, by, named, given, returns

    def query(self, source: FactSource):
        """A DataFrame for Spark's aggregates and for a Fold by groups (returns: the columns that it closes with), the
        fold's result for a Fold of all rows."""
        df = self._rows(source)
        if self.fold is not None and self.by:
            return self.fold.run_by(df, self.by, self.returns)
        if self.fold is not None:
            return self.fold.run(df)
        return df.groupBy(*self.by).agg(*(c.alias(n) for n, c in self.named.items()))


def fact(the: str | None = None, /, **members: object) -> Fact:
    return Fact(the, members)


claim = fact


class Operator:
    """A formula as a conjunct: the builder's names of its inputs and output, and its negation."""

    def __init__(self, name: str, inputs: dict[str, str], output: str | None = "is"):
        self.name, self.inputs, self.output = name, inputs, output

    def __call__(self, **terms: object) -> Formula:
        given = {plain_name(k): t for k, t in terms.items()}
        unknown = set(given) - set(self.inputs) - {self.output}
        missing = set(self.inputs) - set(given)
        if unknown or missing:
            raise TypeError(f"{self.name} takes {sorted(self.inputs)}, not {sorted(given)}")
        return Formula(self.name, {inner: given[outer] for outer, inner in self.inputs.items()}, given.get(self.output, ABSENT))

    def not_(self, **terms: object) -> Not:
        return Not(self(**terms))


class Data:
    same = Operator("==", {"this": "of"}, "as")
    greater = Operator(">", {"this": "this", "than": "than"}, None)
    greater_or_equal = Operator(">=", {"this": "this", "than": "than"}, None)
    less = Operator("<", {"this": "this", "than": "than"}, None)
    less_or_equal = Operator("<=", {"this": "this", "than": "than"}, None)
    not_ = Operator("!", {"of": "of"})
    Type = Operator("data/type", {"of": "of"})
    Reference = Operator("data/refer", {"of": "of"})

    @staticmethod
    def Fact(is_: object = ABSENT, **record: object) -> Formula:
        """Hash of a record."""
        return Formula("data/refer", {plain_name(k): t for k, t in record.items()}, is_)


class Text:
    match = Operator("text/like", {"this": "text", "pattern": "pattern"})
    includes = Operator("text/includes", {"this": "this", "slice": "slice"})
    Concat = Operator("text/concat", {"of": "of", "with": "with"})
    Words = Operator("text/words", {"of": "of"})
    Lines = Operator("text/lines", {"of": "of"})
    UpperCase = Operator("text/case/upper", {"of": "of"})
    LowerCase = Operator("text/case/lower", {"of": "of"})
    Trim = Operator("text/trim", {"of": "of"})
    TrimStart = Operator("text/trim/start", {"of": "of"})
    TrimEnd = Operator("text/trim/end", {"of": "of"})
    Length = Operator("text/length", {"of": "of"})
    Slice = Operator("text/slice", {"of": "of", "start": "start", "end": "end"})
    not_ = match.not_


class UTF8:
    ToText = Operator("utf8/to/text", {"of": "of"})
    FromText = Operator("text/to/utf8", {"of": "of"})


class Math:
    Sum = Operator("+", {"of": "of", "with": "with"})
    Subtraction = Operator("-", {"of": "of", "by": "by"})
    Multiplication = Operator("*", {"of": "of", "by": "by"})
    Division = Operator("/", {"of": "of", "by": "by"})
    Modulo = Operator("%", {"of": "of", "by": "by"})
    Power = Operator("**", {"of": "of", "exponent": "by"})
    Absolute = Operator("math/absolute", {"of": "of"})


class _Text:
    def __init__(self, term: object):
        self.term = term

    def like(self, pattern: object) -> Formula:
        return Text.match(this=self.term, pattern=pattern)

    def includes(self, part: object) -> Formula:
        return Text.includes(this=self.term, slice=part)

    def concat(self, other: object, is_: object) -> Formula:
        return Text.Concat(of=self.term, with_=other, is_=is_)

    def __getattr__(self, name: str):
        made = {"words": Text.Words, "lines": Text.Lines, "to_upper": Text.UpperCase, "to_lower": Text.LowerCase, "trim": Text.Trim}
        if name not in made:
            raise AttributeError(name)
        return lambda is_: made[name](of=self.term, is_=is_)


def text(term: object) -> _Text:
    return _Text(term)


class _Same:
    """Unification of two terms, either of which may be bound; same.not_ keeps those that differ."""

    def __call__(self, this: object, as_: object) -> Same:
        return Same(this, as_)

    def not_(self, this: object, as_: object) -> Not:
        return Not(Same(this, as_))


same = _Same()


class _Collection:
    """Members `of` of the collection `this`, under the names `at`."""

    def __call__(self, this: object, of: object = ABSENT, at: object = ABSENT) -> Select:
        return Select(at if at is not ABSENT else Var("at"), this, of)

    def not_(self, this: object, of: object = ABSENT, at: object = ABSENT) -> Not:
        return Not(Select(at, this, of))


Collection = _Collection()
