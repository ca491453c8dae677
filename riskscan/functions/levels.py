"""Ordered levels: severity and confidence, compared by rank and never by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
GRADES = ("A", "B", "C", "D", "F")
ACTIVE_STATUSES = ("confirmed", "validated", "unverified")


def _names(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def severity_rank(severity: Column) -> Column:
    """0 for info up to 4 for critical, -1 for an unknown name."""
    return (F.array_position(_names(SEVERITIES), severity) - 1).cast("int")


def severity_name(rank: Column) -> Column:
    return F.element_at(_names(SEVERITIES), (rank + 1).cast("int"))


def severity_at_least(severity: Column, floor: str) -> Column:
    return severity_rank(severity) >= SEVERITIES.index(floor)


def confidence_rank(confidence: Column) -> Column:
    """0 for low up to 2 for high, -1 for an unknown name."""
    return (F.array_position(_names(CONFIDENCES), confidence) - 1).cast("int")


def confidence_name(rank: Column) -> Column:
    return F.element_at(_names(CONFIDENCES), (rank + 1).cast("int"))


def raised(rank: Column, by: int | Column = 1) -> Column:
    """A confidence rank moved up, never past high."""
    return F.least(rank + by, F.lit(len(CONFIDENCES) - 1))


def lowered(rank: Column, by: int | Column = 1) -> Column:
    """A confidence rank moved down, never past low."""
    return F.greatest(rank - by, F.lit(0))


def grade_rank(grade: Column) -> Column:
    """0 for A up to 4 for F; null for the unknown grade."""
    position = F.array_position(_names(GRADES), grade)
    return F.when(position > 0, (position - 1).cast("int"))


def counts_for_risk(status: Column) -> Column:
    """Only findings that are still standing add risk."""
    return status.isin(*ACTIVE_STATUSES)


def signal_confidence(strong: Column, n: Column) -> Column:
    """A schema signal is sure, two word signals are likely, one is a guess."""
    return F.when(strong, F.lit("high")).when(n >= 2, F.lit("medium")).otherwise(F.lit("low"))
