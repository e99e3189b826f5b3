"""Rank columns for ordered labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F


# Label ranks; the two middle evidence labels are equal.
EVIDENCE_RANKS = {"high": 4, "moderate": 3, "medium": 3, "low": 2, "insufficient": 1}
DECISION_RANKS = {"positive": 4, "weak_positive": 3, "indeterminate": 2, "negative": 1}


def _rank(label: Column, ranks: dict[str, int]) -> Column:
    expr = F.lit(0)
    for name, value in reversed(list(ranks.items())):
        expr = F.when(label == name, value).otherwise(expr)
    return expr


def evidence_rank(label: Column) -> Column:
    return _rank(label, EVIDENCE_RANKS)


def decision_rank(label: Column) -> Column:
    return _rank(label, DECISION_RANKS)
