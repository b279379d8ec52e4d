"""Rules over streams of facts."""

from .continuous import facts_of, run_rules

__all__ = ["facts_of", "run_rules"]
