"""From rules to DataFrames: every conjunct extends a frame, whose columns are the bound variables."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import BUILT_IN
from ..sources.base import FactSource
from ..terms import WILDCARD, Var, is_var
from ..values import SQL_TYPES, Bound, as_type, common, constant, equal, plain
from .analyzer import Unbound, order, required, rule_requires
from .fixpoint import fixpoint
from .ir import ABSENT, Apply, Formula, Not, Recur, Rule, Same, Select, Star

_NAMES = itertools.count()


def fresh() -> str:
    return f"v{next(_NAMES)}"


def describe(c) -> str:
    """A conjunct on one line."""
    if isinstance(c, Select):
        return f"scan {c.the} of {c.of} is {c.is_}"
    if isinstance(c, Star):
        return f"scan of {c.of}: " + ", ".join(f"{m.the} is {m.is_}" for m in c.members)
    if isinstance(c, Formula):
        return f"{c.name} of {c.inputs} is {c.output}"
    if isinstance(c, Same):
        return f"{c.this} same {c.as_}"
    if isinstance(c, Not):
        return "not " + "; ".join(map(describe, c.conjuncts()))
    return f"{c.rule.name if isinstance(c, Apply) else 'recur'} {c.args}"


@dataclass
class Frame:
    """Solutions so far. df None: the one solution that binds nothing. keys: sets of variables that no two rows agree on."""

    df: DataFrame | None
    cols: dict[Var, Bound]
    keys: tuple[frozenset[Var], ...] = ()

    def value(self, term: object) -> Bound:
        return self.cols[term] if is_var(term) else constant(term)

    def has(self, term: object) -> bool:
        return not isinstance(term, Var) or term in self.cols

    def where(self, test: Column) -> Frame:
        return Frame(self.df.where(test), self.cols, self.keys)

    def bind(self, var: Var, value: Bound) -> Frame:
        name = fresh()
        return Frame(self.df.withColumn(name, value.column), self.cols | {var: Bound(F.col(name), value.type)}, self.keys)

    def only(self, names: set[Var]) -> Frame:
        cols = {v: b for v, b in self.cols.items() if v in names}
        out = {v: Bound(F.col(f"v{i}_{v.id}"), b.type) for i, (v, b) in enumerate(cols.items())}
        if not cols:
            return Frame(self.df.select(F.lit(1).alias("v_none")), {})
        return Frame(self.df.select(*(b.column.alias(f"v{i}_{v.id}") for i, (v, b) in enumerate(cols.items()))), out, tuple(k for k in self.keys if k <= names))


class Compiler:
    def __init__(self, source: FactSource, formulas: dict | None = None, limit: int = 1000):
        """limit: steps of a recursion that makes new values, such as sums; others end and have none."""
        self.source, self.spark, self.limit = source, source.spark, limit
        self.formulas = BUILT_IN | (formulas or {})
        #: The conjuncts in the order that they were compiled in, those of inner rules further to the right.
        self.steps: list[str] = []

    # -- rules --------------------------------------------------------------------------------------------------------

    def rule(self, rule: Rule, args: dict[str, object]) -> tuple[DataFrame, dict[str, Bound]]:
        """Distinct answers of a rule for head names to terms, with a column for each name that has a variable or value."""
        for name in rule_requires(rule):
            if not (name in args and not isinstance(args[name], Var)):
                raise ReferenceError(f'Rule application omits required parameter "{name}"')
        frame = self.body(self.unit(), [Apply(rule, args)])
        named = {n: (constant(t) if not isinstance(t, Var) else frame.cols[t]) for n, t in args.items() if t != WILDCARD}
        df = frame.df.select(*(b.column.alias(n) for n, b in named.items()))
        # rows that a key among the columns tells apart need no shuffle to be distinct
        shown = {t for t in args.values() if is_var(t)}
        df = df if any(k <= shown for k in frame.keys) else df.distinct()
        return df, {n: Bound(F.col(f"`{n}`"), b.type) for n, b in named.items()}

    def unit(self) -> Frame:
        return Frame(None, {}, (frozenset(),))

    def seeded(self, frame: Frame) -> Frame:
        return frame if frame.df is not None else Frame(self.spark.range(1).select(F.lit(1).alias(fresh())), frame.cols, frame.keys)

    def body(self, frame: Frame, conjuncts: list, delta: Frame | None = None, stack: tuple = ()) -> Frame:
        """The frame joined with all conjuncts, in planned order."""
        flat = self.flatten(conjuncts, stack)
        for c in order(self.stars(flat), set(frame.cols)):
            self.steps.append("  " * len(stack) + describe(c))
            frame = self.step(frame, c, stack)
        return self.seeded(frame)

    def flatten(self, conjuncts: list, stack: tuple) -> list:
        """Rules of one branch are part of the body that applies them, so one plan orders all."""
        out = []
        for c in conjuncts:
            if isinstance(c, Apply) and not c.rule.recursive and len(c.rule.branches) == 1 and not self.busy(c.rule, stack) and not self.unsafe(c):
                (inner,) = c.rule.branches.values()
                out += self.flatten(self.inlined(c, inner), stack + (c.rule,))
            else:
                out.append(c)
        return out

    @staticmethod
    def unsafe(c: Apply) -> bool:
        return any(n not in c.args or c.args[n] == WILDCARD for n in rule_requires(c.rule))

    @staticmethod
    def busy(rule: Rule, stack: tuple) -> bool:
        if any(rule is r for r in stack):
            raise ReferenceError(f"{rule.name} and another rule apply each other; only a rule's own recursion is supported")
        return False

    @staticmethod
    def inlined(c: Apply, body: list) -> list:
        """A branch's conjuncts with arguments in the place of head variables and new locals. A head variable under two
        names gets one argument, and the other is unified with it."""
        known: dict[Var, object] = {WILDCARD: WILDCARD}
        extra: list = []
        for name, v in c.rule.head.items():
            if name in c.args and c.args[name] != WILDCARD:
                if v in known:
                    extra.append(Same(known[v], c.args[name]))
                else:
                    known[v] = c.args[name]
        swap = lambda t: known.setdefault(t, Var(t.name)) if isinstance(t, Var) else t

        def change(x):
            if isinstance(x, Select):
                return Select(swap(x.the), swap(x.of), swap(x.is_), x.type)
            if isinstance(x, Formula):
                return Formula(x.name, {k: swap(t) for k, t in x.inputs.items()}, {k: swap(t) for k, t in x.output.items()} if isinstance(x.output, dict) else swap(x.output))
            if isinstance(x, Same):
                return Same(swap(x.this), swap(x.as_))
            if isinstance(x, Apply):
                return Apply(x.rule, {k: swap(t) for k, t in x.args.items()})
            if isinstance(x, Recur):
                return Recur({k: swap(t) for k, t in x.args.items()})
            if isinstance(x, Not):
                return Not(tuple(change(y) for y in x.conjuncts()))
            return Star(swap(x.of), tuple(change(m) for m in x.members))

        return [change(x) for x in body] + extra

    def stars(self, conjuncts: list) -> list:
        """Patterns of one entity with different constant attributes become one scan where the source has them in a table."""
        groups: dict[Var, list[Select]] = {}
        for c in conjuncts:
            if isinstance(c, Select) and is_var(c.of) and isinstance(c.the, str):
                groups.setdefault(c.of, []).append(c)
        done: dict[int, Star] = {}
        for of, members in groups.items():
            tables: dict[str, list[Select]] = {}
            for m in members:
                tables.setdefault(m.the.rpartition("/")[0], []).append(m)
            for part in tables.values():
                if len(part) > 1 and self.source.star([m.the for m in part]) is not None:
                    star = Star(of, tuple(part))
                    done |= {id(m): star for m in part}
        out: list = []
        for c in conjuncts:
            c = done.get(id(c), c)
            if not any(c is x for x in out):
                out.append(c)
        return out

    # -- conjuncts ----------------------------------------------------------------------------------------------------

    def step(self, frame: Frame, c, stack: tuple) -> Frame:
        if isinstance(c, Select):
            return self.join(frame, *self.pattern(c))
        if isinstance(c, Star):
            return self.join(frame, *self.star(c))
        if isinstance(c, Formula):
            return self.formula(self.seeded(frame), c)
        if isinstance(c, Same):
            return self.same(self.seeded(frame), c)
        if isinstance(c, Not):
            return self.negation(self.seeded(frame), c, stack)
        if isinstance(c, Apply):
            return self.application(frame, c, stack)
        raise ReferenceError(f"{c} outside of its rule")

    @staticmethod
    def _keys(keys: tuple[frozenset[str], ...], terms: dict[str, object]) -> tuple[frozenset[Var], ...]:
        """Keys of a scan as variables: constants are the same in all rows, parts that aren't asked for spoil a key."""
        return tuple(frozenset(terms[n] for n in k if isinstance(terms[n], Var)) for k in keys if all(n in terms and terms[n] is not ABSENT for n in k))

    def _unified(self, df: DataFrame, terms: list[tuple[object, Bound]]) -> tuple[DataFrame, dict[Var, Bound]]:
        """df filtered by constants and repeated variables, with a column for each variable."""
        cols: dict[Var, Bound] = {}
        for term, have in terms:
            if term is ABSENT:
                continue
            if not isinstance(term, Var):
                df = df.where(equal(have, constant(term)))
            elif term in cols:
                df = df.where(equal(cols[term], have))
            else:
                cols[term] = have
        named = {v: (fresh(), b) for v, b in cols.items()}
        df = df.select(*(b.column.alias(n) for n, b in named.values())) if named else df.select(F.lit(1).alias(fresh()))
        return df, {v: Bound(F.col(n), b.type) for v, (n, b) in named.items()}

    def pattern(self, c: Select) -> tuple[DataFrame, dict[Var, Bound], tuple[frozenset[Var], ...]]:
        given = [None if isinstance(t, Var) else t for t in (c.the, c.of, c.is_)]
        df, parts, keys = self.source.scan(*given, c.type)
        # None as a constant is the null value, for a source it is no restriction
        terms = [(t, parts[n]) for t, n in zip((c.the, c.of, c.is_), ("the", "of", "is")) if isinstance(t, Var) or t is None]
        df, cols = self._unified(df, terms)
        keys = self._keys(keys, {"the": c.the, "of": c.of, "is": c.is_})
        return (df, cols, keys) if cols else (df.limit(1), cols, (frozenset(),))

    def star(self, c: Star) -> tuple[DataFrame, dict[Var, Bound], tuple[frozenset[Var], ...]]:
        df, parts, keys = self.source.star([m.the for m in c.members])
        df, cols = self._unified(df, [(c.of, parts["of"]), *((m.is_, parts[m.the]) for m in c.members)])
        return df, cols, self._keys(keys, {"of": c.of} | {m.the: m.is_ for m in c.members})

    def join(self, frame: Frame, df: DataFrame, cols: dict[Var, Bound], keys: tuple[frozenset[Var], ...] = ()) -> Frame:
        if frame.df is None:
            return Frame(df, cols, keys)
        # if all of a right key is joined on, a left row meets one right row at most, and so the other way round
        one = {True: any(k <= set(frame.cols) for k in keys), False: any(k <= set(cols) for k in frame.keys)}
        both = tuple(a | b for a in frame.keys for b in keys)[:6]
        keys = both + frame.keys * one[True] + keys * one[False]
        on = [equal(frame.cols[v], b) for v, b in cols.items() if v in frame.cols]
        out = frame.df.join(df, on) if on else frame.df.crossJoin(df)
        old = {v: b for v, b in frame.cols.items()}
        keep = [b.column for b in (old | {v: b for v, b in cols.items() if v not in old}).values()]
        return Frame(out.select(*keep) if keep else out, old | {v: b for v, b in cols.items() if v not in old}, keys)

    def outcome(self, frame: Frame, c: Formula):
        if c.name not in self.formulas:
            raise ReferenceError(f"There is no formula {c.name}")
        return self.formulas[c.name]({k: frame.value(t) for k, t in c.inputs.items()})

    def formula(self, frame: Frame, c: Formula) -> Frame:
        out = self.outcome(frame, c)
        name = fresh()
        if out.rows and c.output is ABSENT:
            return frame.where(F.size(out.column) > 0)
        if out.rows:
            # each output once for a row, so a key and the output are a key
            new = {t for t in c.outputs() if is_var(t) and t not in frame.cols}
            keys = tuple(k | new for k in frame.keys)
            frame = Frame(frame.df.select("*", F.explode(F.array_distinct(out.column)).alias(name)), frame.cols, keys)
        elif c.output is ABSENT and c.name != "==":
            return frame.where(out.column.isNotNull())
        else:
            frame = Frame(frame.df.withColumn(name, out.column), frame.cols, frame.keys)
        if isinstance(c.output, dict):
            frame = frame.where(F.col(name).isNotNull())
            for field, term in c.output.items():
                value = Bound(F.col(name)[field], out.type[field])
                frame = frame.where(equal(value, frame.value(term))) if frame.has(term) else frame if term == WILDCARD else frame.bind(term, value)
            return frame
        value = Bound(F.col(name), out.type)
        if c.name != "==" and out.type != "any":
            frame = frame.where(value.column.isNotNull())
        if c.output is ABSENT:
            return frame
        if is_var(c.output) and c.output not in frame.cols:
            return Frame(frame.df, frame.cols | {c.output: value}, frame.keys)
        return frame.where(equal(value, frame.value(c.output)))

    def same(self, frame: Frame, c: Same) -> Frame:
        if WILDCARD in (c.this, c.as_):
            return frame
        if frame.has(c.this) and frame.has(c.as_):
            return frame.where(equal(frame.value(c.this), frame.value(c.as_)))
        new, old = (c.as_, c.this) if frame.has(c.this) else (c.this, c.as_)
        return frame.bind(new, frame.value(old))

    def negation(self, frame: Frame, c: Not, stack: tuple) -> Frame:
        inner = c.conjuncts()
        if any(isinstance(x, Recur) for x in inner):
            raise ReferenceError("a rule can't be recursive through negation")
        if len(inner) == 1 and isinstance(inner[0], (Formula, Same)) and all(frame.has(v) for v in inner[0].vars()):
            return frame.where(~F.coalesce(self.holds(frame, inner[0]), F.lit(False)))
        shared = {v for v in c.vars() if v in frame.cols}
        if alone := self.alone(inner, stack):
            df, cols = alone.df, alone.cols
        else:
            left = Frame(frame.only(shared).df.distinct(), frame.only(shared).cols)
            found = self.body(left, inner, stack=stack)
            df, cols = found.df, found.cols
        # new names, as the operand may come from the same rows
        right = {v: (fresh(), cols[v]) for v in shared if v in cols}
        df = df.select(*(b.column.alias(n) for n, b in right.values())) if right else df.select(F.lit(1).alias(fresh()))
        on = [equal(frame.cols[v], Bound(F.col(n), b.type)) for v, (n, b) in right.items()]
        return Frame(frame.df.join(df, on or F.lit(True), "left_anti"), frame.cols, frame.keys)

    def alone(self, inner: list, stack: tuple) -> Frame | None:
        """The answers of a negation's operand if they come from one scan without what is known outside: then that needn't
        be computed twice."""
        flat = self.stars(self.flatten(inner, stack))
        scans = [x for x in flat if isinstance(x, (Select, Star))]
        if len(scans) != 1 or not all(isinstance(x, (Select, Star, Formula, Same)) for x in flat):
            return None
        try:
            return self.body(self.unit(), inner, stack=stack)
        except Unbound:
            return None

    def holds(self, frame: Frame, c) -> Column:
        if isinstance(c, Same):
            return equal(frame.value(c.this), frame.value(c.as_))
        out = self.outcome(frame, c)
        if isinstance(c.output, dict):
            same = lambda x: functools.reduce(Column.__and__, [equal(Bound(x[f], out.type[f]), frame.value(t)) for f, t in c.output.items() if t != WILDCARD], x.isNotNull())
            return F.exists(out.column, same) if out.rows else same(out.column)
        if out.rows:
            return F.size(out.column) > 0 if c.output is ABSENT else F.exists(out.column, lambda x: equal(Bound(x, out.type), frame.value(c.output)))
        there = F.lit(True) if c.name == "==" else out.column.isNotNull()
        return there if c.output is ABSENT else there & equal(Bound(out.column, out.type), frame.value(c.output))

    def application(self, frame: Frame, c: Apply, stack: tuple) -> Frame:
        rule = c.rule
        self.busy(rule, stack)
        given = {v for n, v in rule.head.items() if c.args.get(n, WILDCARD) != WILDCARD}
        for name in rule_requires(rule):
            if rule.head[name] not in given:
                raise ReferenceError(f'Rule application omits required parameter "{name}"')
        unknown = set(c.args) - set(rule.head)
        if unknown:
            raise ReferenceError(f"{rule.name} has no {sorted(unknown)}")
        if rule.recursive:
            return self.recursive(frame, c, stack)
        wanted = set(frame.cols) | {t for t in c.args.values() if is_var(t)}
        if not rule.branches:
            for v in dict.fromkeys(rule.head.values()):
                # names that share a variable are equal, and one of them binds the others
                terms = sorted((c.args[n] for n, x in rule.head.items() if x == v and n in c.args and c.args[n] != WILDCARD), key=lambda t: not frame.has(t))
                if not terms or not frame.has(terms[0]):
                    raise ReferenceError(f"Rule application requires binding for {v}")
                for t in terms[1:]:
                    frame = self.same(self.seeded(frame), Same(terms[0], t))
            return frame
        frames = [self.body(frame, self.inlined(c, body), stack=stack + (rule,)).only(wanted) for body in rule.branches.values()]
        return self.union(frames)

    def union(self, frames: list[Frame]) -> Frame:
        """Distinct solutions of any of the frames, which bind the same variables; types that differ become any."""
        shared = set.intersection(*(set(f.cols) for f in frames))
        names = {v: fresh() for v in frames[0].cols if v in shared}
        kinds = {}
        for v in names:
            types = {f.cols[v].type for f in frames}
            plains = {plain(f.cols[v]).type for f in frames}
            kinds[v] = types.pop() if len(types) == 1 else plains.pop() if len(plains) == 1 else "float" if plains <= {"integer", "float"} else "any"
        parts = [f.df.select(*(as_type(f.cols[v], kinds[v]).column.alias(n) for v, n in names.items())) if names else f.df.select(F.lit(1).alias("one")) for f in frames]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return Frame(out.distinct(), {v: Bound(F.col(n), kinds[v]) for v, n in names.items()}, (frozenset(names),))

    # -- recursion ----------------------------------------------------------------------------------------------------

    def recursive(self, frame: Frame, c: Apply, stack: tuple) -> Frame:
        """Answers of a recursive rule, joined to the frame by the arguments.

        Head variables that the rule can't bind itself, and those that every recursive use passes on unchanged, are
        seeded with the frame's values: first all values that recursion asks for are found, then the answers for them.
        """
        rule = c.rule
        head = dict(rule.head)
        branches: list[tuple[list, list[Recur]]] = []
        for body in rule.branches.values():
            recurs, rest = [], []
            for x in body:
                if isinstance(x, Apply) and x.rule is rule:
                    x = Recur(x.args)
                if isinstance(x, Recur):
                    args = dict(x.args) if x.args else dict(head)
                    if all(args.get(n) == v for n, v in head.items()):
                        continue  # it asks for what it is to prove: the rest of the branch decides
                    recurs.append(Recur(args))
                else:
                    rest.append(x)
            branches.append((rest, recurs))
        needs = rule_requires(rule)
        fixed = {n for n, v in head.items() if all(r.args.get(n) == v for _, rs in branches for r in rs)}
        given = {n for n, t in c.args.items() if t != WILDCARD and frame.has(t)}
        seeds = sorted((needs | fixed) & given)
        if any(n not in given for n in needs):
            raise ReferenceError(f'Rule application omits required parameter "{sorted(needs - given)[0]}"')
        inner = stack + (rule,)
        demand = self.demand(frame, c, branches, head, seeds, needs, inner) if seeds else None
        kinds: dict[str, str] = {}

        def start() -> Frame:
            return self.unit() if demand is None else Frame(demand.df, {head[n]: b for n, b in demand.cols.items()})

        def answers(f: Frame) -> tuple[DataFrame, dict[str, Bound]]:
            return f.df, {n: f.cols[v] for n, v in head.items()}

        found = [answers(self.body(start(), rest, stack=inner)) for rest, recurs in branches if not recurs and self.complete(rest, head, start().cols)]
        if not found:
            kinds = {n: "any" for n in head}
            base = self.spark.createDataFrame([], ", ".join(f"`{n}` {SQL_TYPES['any']}" for n in head))
        else:
            for n in head:
                plains = {plain(cols[n]).type for _, cols in found}
                kinds[n] = plains.pop() if len(plains) == 1 else "float" if plains <= {"integer", "float"} else "any"
            base = None
            for df, cols in found:
                part = df.select(*(as_type(cols[n], kinds[n]).column.alias(n) for n in head))
                base = part if base is None else base.unionByName(part)

        def relation(df: DataFrame, r: Recur) -> tuple[DataFrame, dict[Var, Bound]]:
            names = {n: fresh() for n in head}
            df = df.select(*(F.col(f"`{n}`").alias(x) for n, x in names.items()))
            return self._unified(df, [(r.args.get(n, ABSENT), Bound(F.col(x), kinds[n])) for n, x in names.items()])

        def step(new: DataFrame, known: DataFrame) -> DataFrame | None:
            out = None
            for rest, recurs in branches:
                for i in range(len(recurs)):
                    f = start()
                    for j, r in enumerate(recurs):
                        f = self.join(f, *relation(new if i == j else known, r))
                    df, cols = answers(self.body(f, rest, stack=inner))
                    part = df.select(*(as_type(cols[n], kinds[n]).column.alias(n) for n in head))
                    out = part if out is None else out.unionByName(part)
            return out

        limit = self.limit if any(self.generates(rest, (rule,)) for rest, recurs in branches if recurs) else None
        table = fixpoint(base, step, limit) if any(rs for _, rs in branches) else base.distinct()
        df, cols = relation(table, Recur({n: t for n, t in c.args.items()}))
        return self.join(frame, df.distinct(), cols, (frozenset(cols),))

    @staticmethod
    def complete(rest: list, head: dict[str, Var], bound) -> bool:
        """Whether a branch without its recursion binds the whole head."""
        return all(v in bound or any(v in x.vars() for x in rest if not isinstance(x, Not)) for v in head.values())

    def demand(self, frame: Frame, c: Apply, branches: list, head: dict[str, Var], seeds: list[str], needs: set[str], stack: tuple) -> Frame:
        """Values of the seeded head variables that the frame, or recursion from those, asks for."""
        frame = self.seeded(frame)
        values = {n: plain(frame.value(c.args[n])) for n in seeds}
        first = frame.df.select(*(v.column.alias(n) for n, v in values.items())).distinct()
        cols = lambda: {n: Bound(F.col(f"`{n}`"), v.type) for n, v in values.items()}
        if not needs:
            return Frame(first, cols())

        def step(new: DataFrame, known: DataFrame) -> DataFrame | None:
            out = None
            for rest, recurs in branches:
                for r in recurs:
                    # the part of the branch that the seeds alone can run
                    names = {n: fresh() for n in seeds}
                    f = Frame(new.select(*(F.col(f"`{n}`").alias(x) for n, x in names.items())), {head[n]: Bound(F.col(x), values[n].type) for n, x in names.items()})
                    f = self.body(f, self.ready(rest, set(f.cols)), stack=stack)
                    if not all(f.has(r.args.get(n, head[n])) for n in seeds):
                        raise ReferenceError("recursion asks for values that are bound only by its answers")
                    part = f.df.select(*(as_type(f.value(r.args.get(n, head[n])), values[n].type).column.alias(n) for n in seeds))
                    out = part if out is None else out.unionByName(part)
            return out

        limit = self.limit if any(self.generates(rest, (c.rule,)) for rest, _ in branches) else None
        return Frame(fixpoint(first, step, limit), cols())

    @classmethod
    def generates(cls, body: list, seen: tuple) -> bool:
        """Whether a body can make values that no fact has: only then a recursion may never end."""
        for c in body:
            if isinstance(c, Formula) and c.output is not ABSENT and c.name != "==":
                return True
            if isinstance(c, Apply) and not any(c.rule is r for r in seen):
                if any(cls.generates(b, (*seen, c.rule)) for b in c.rule.branches.values()):
                    return True
        return False

    @staticmethod
    def ready(rest: list, bound: set[Var]) -> list:
        out, bound = [], set(bound)
        for _ in rest:
            for x in rest:
                if not any(x is y for y in out):
                    try:
                        order([*out, x], bound)
                    except Unbound:
                        continue
                    out.append(x)
        return out


__all__ = ["Compiler", "Frame", "required"]
