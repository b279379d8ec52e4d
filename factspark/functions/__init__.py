"""Built-in formulas and their registry."""

from .formulas import BUILT_IN, Outcome, python_formula

__all__ = ["BUILT_IN", "Outcome", "python_formula"]
