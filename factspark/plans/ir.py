"""Rules as data: five kinds of conjunct, and rules that name a head and branches of conjuncts."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

from ..terms import WILDCARD, Var, is_var

ABSENT = WILDCARD


@dataclass(frozen=True, eq=False)
class Select:
    """A fact pattern; an absent part matches anything. `type` is the value's declared type, if any."""

    the: object = ABSENT
    of: object = ABSENT
    is_: object = ABSENT
    type: str | None = None

    def vars(self) -> set[Var]:
        return {t for t in (self.the, self.of, self.is_) if is_var(t)}


@dataclass(frozen=True, eq=False)
class Star:
    """Patterns with constant attributes of one entity that a source answers by one scan."""

    of: object
    members: tuple[Select, ...]

    def vars(self) -> set[Var]:
        return set().union(*(m.vars() for m in self.members))


@dataclass(frozen=True, eq=False)
class Formula:
    """A built-in or registered function of inputs; its outputs, none or several, are unified with `output`: a term, or
    names to terms for a function whose outputs are records."""

    name: str
    inputs: dict[str, object]
    output: object = ABSENT

    def outputs(self) -> list:
        return list(self.output.values()) if isinstance(self.output, dict) else [self.output]

    def vars(self) -> set[Var]:
        return {t for t in (*self.inputs.values(), *self.outputs()) if is_var(t)}


@dataclass(frozen=True, eq=False)
class Same:
    """Unification: either side may be the one that is bound."""

    this: object
    as_: object

    def vars(self) -> set[Var]:
        return {t for t in (self.this, self.as_) if is_var(t)}


@dataclass(frozen=True, eq=False)
class Apply:
    """A rule with arguments for its head variables; those left out are existential."""

    rule: Rule
    args: dict[str, object]

    def vars(self) -> set[Var]:
        return {t for t in self.args.values() if is_var(t)}


@dataclass(frozen=True, eq=False)
class Not:
    """Keeps what the operand, a conjunct or a list of them, has no answer for."""

    operand: Conjunct | tuple

    def conjuncts(self) -> list:
        return list(self.operand) if isinstance(self.operand, tuple) else [self.operand]

    def vars(self) -> set[Var]:
        return set().union(*(c.vars() for c in self.conjuncts()))


@dataclass(frozen=True, eq=False)
class Recur:
    """The rule that it stands in, with other arguments."""

    args: dict[str, object]

    def vars(self) -> set[Var]:
        return {t for t in self.args.values() if is_var(t)}


Conjunct = Union[Select, Star, Formula, Same, Apply, Not, Recur]


@dataclass(eq=False)
class Rule:
    """head: names to variables (two names may share one); branches: names to conjuncts. No branch: a unit rule.

    Raises ReferenceError if a branch doesn't mention a head variable.
    """

    head: dict[str, Var]
    branches: dict[str, list[Conjunct]] = field(default_factory=dict)
    name: str = "rule"

    def __post_init__(self) -> None:
        for label, body in self.branches.items():
            used = set().union(*(c.vars() for c in body), set())
            for v in self.head.values():
                if v not in used and is_var(v):
                    raise ReferenceError(f'Rule case "{label}" does not bind variable {v} that rule matches as "{next(k for k, x in self.head.items() if x == v)}"')
            for c in body:
                both = [t for t in c.outputs() if is_var(t) and t in c.inputs.values()] if isinstance(c, Formula) else []
                if both:
                    raise ReferenceError(f"Variable {both[0]} cannot appear in both input and output of {c.name}")

    def apply(self, **args: object) -> Apply:
        return Apply(self, args)

    @property
    def recursive(self) -> bool:
        return any(isinstance(c, Recur) or (isinstance(c, Apply) and c.rule is self) for body in self.branches.values() for c in body)


def parse(form: dict, rules: dict[int, Rule] | None = None):
    """A conjunct from its plain form: {match: {the?, of?, is?}}, {match, operator}, {match, rule}, {not: form},
    {recur: terms}. A rule's own form is {match, when}."""
    if not isinstance(form, dict):
        return form
    rules = {} if rules is None else rules
    if "not" in form:
        inner = form["not"]
        return Not(tuple(parse(f, rules) for f in inner) if isinstance(inner, (list, tuple)) else parse(inner, rules))
    if "recur" in form:
        return Recur(dict(form["recur"]))
    if "rule" in form:
        made = form["rule"]
        return Apply(made if isinstance(made, Rule) else parse_rule(made, rules), dict(form["match"]))
    match = form["match"]
    if "operator" in form:
        return Formula(form["operator"], {k: v for k, v in match.items() if k != "is"}, match.get("is", ABSENT))
    if not set(match) & {"the", "of", "is"}:
        raise TypeError(f"A fact pattern needs the, of or is: {match}")
    return Select(match.get("the", ABSENT), match.get("of", ABSENT), match.get("is", ABSENT))


def parse_rule(form: dict, rules: dict[int, Rule] | None = None) -> Rule:
    rules = {} if rules is None else rules
    if id(form) not in rules:
        when = form.get("when", {})
        when = {"where": when} if isinstance(when, (list, tuple)) else when
        rules[id(form)] = Rule(dict(form["match"]), {k: [parse(c, rules) for c in body] for k, body in when.items()})
    return rules[id(form)]


def to_dict(node) -> dict:
    """The plain form of a rule or conjunct."""
    if isinstance(node, Rule):
        return {"match": dict(node.head), **({"when": {k: [to_dict(c) for c in b] for k, b in node.branches.items()}} if node.branches else {})}
    if isinstance(node, Select):
        return {"match": {k: v for k, v in (("the", node.the), ("of", node.of), ("is", node.is_)) if v is not ABSENT}}
    if isinstance(node, Formula):
        made = node.output if isinstance(node.output, dict) else {} if node.output is ABSENT else {"is": node.output}
        return {"match": {**node.inputs, **made}, "operator": node.name}
    if isinstance(node, Same):
        return {"match": {"of": node.this, "is": node.as_}, "operator": "=="}
    if isinstance(node, Apply):
        return {"match": dict(node.args), "rule": to_dict(node.rule)}
    if isinstance(node, Not):
        parts = [to_dict(c) for c in node.conjuncts()]
        return {"not": parts if isinstance(node.operand, tuple) else parts[0]}
    if isinstance(node, Recur):
        return {"recur": dict(node.args)}
    raise TypeError(node)
