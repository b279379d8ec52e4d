"""What is done with the answers of a rule: grouped selection and aggregation."""

from .aggregates import Fold, avg_, collect_, count_, max_, min_, sum_
from .grouping import select_shape

__all__ = ["Fold", "avg_", "collect_", "count_", "max_", "min_", "select_shape", "sum_"]
