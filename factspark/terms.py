"""Variables and terms of rules. A term is a Var or a plain Python value."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

_NUMBERS = itertools.count(2)


@dataclass(frozen=True)
class Var:
    """A variable: two with one name are different unless they come from one namespace."""

    name: str = field(compare=False)
    id: int = field(default_factory=lambda: next(_NUMBERS))

    def __repr__(self) -> str:
        return f"?{self.name}"


#: Matches anything, binds nothing, may be repeated.
WILDCARD = Var("_", 0)


class Vars:
    """A namespace: V.x and V["x"] are one variable; V._ is the wildcard."""

    def __init__(self, **known: object):
        self.__dict__["_known"] = dict(known)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str):
        if name == "_":
            return WILDCARD
        return self._known.setdefault(name, Var(name))


V = Vars()
_ = WILDCARD


def is_var(term: object) -> bool:
    return isinstance(term, Var) and term != WILDCARD


def plain_name(name: str) -> str:
    """Python keywords take a trailing underscore as keyword arguments: this_, is_, from_."""
    return name[:-1] if name.endswith("_") and name != "_" else name
