"""A deductive query engine that compiles rules over facts to DataFrame plans."""

from .builder import UTF8, Collection, Data, Fact, Math, Text, claim, fact, same, text
from .operators import Fold, avg_, collect_, count_, max_, min_, sum_
from .plans.compiler import Compiler
from .plans.ir import Apply, Formula, Not, Recur, Rule, Same, Select, parse_rule, to_dict
from .sources import CachingSource, InspectingSource, Relation, RelationSource, TripleSource, shred
from .terms import V, Var, Vars, _
from .values import Ref

__all__ = [
    "UTF8", "Apply", "CachingSource", "Collection", "Compiler", "Data", "Fact", "Fold", "Formula", "InspectingSource", "Math", "Not", "Recur", "Ref", "Relation", "RelationSource", "Rule", "Same", "Select", "Text", "TripleSource", "V", "Var", "Vars",
    "_", "avg_", "claim", "collect_", "count_", "fact", "max_", "min_", "parse_rule", "same", "shred", "sum_", "text", "to_dict",
]
