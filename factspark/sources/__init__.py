"""Where facts come from: triples, relations, files."""

from .base import CachingSource, FactSource, InspectingSource, Scan
from .relations import Relation, RelationSource
from .triples import TripleSource, shred

__all__ = ["CachingSource", "FactSource", "InspectingSource", "Relation", "RelationSource", "Scan", "TripleSource", "shred"]
