"""Ordered label lists: casting to a list and ranking within it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_ordinal(column: Column, levels: Sequence[str]) -> Column:
    """The label if it is one of ``levels`` (exact match), else NULL."""
    return F.when(column.isin(*levels), column)


def rank_of(column: Column, levels: Sequence[str], default: int | None = None) -> Column:
    """1-based position of the label in ``levels``; ``default`` when unlisted."""
    ranked = F.when(column == levels[0], F.lit(1))
    for position, level in enumerate(levels[1:], start=2):
        ranked = ranked.when(column == level, F.lit(position))
    return ranked if default is None else ranked.otherwise(F.lit(default))


def label_at(position: Column, levels: Sequence[str]) -> Column:
    """Inverse of :func:`rank_of`; NULL beyond the last level."""
    labelled = F.when(position == 1, F.lit(levels[0]))
    for i, level in enumerate(levels[1:], start=2):
        labelled = labelled.when(position == i, F.lit(level))
    return labelled
