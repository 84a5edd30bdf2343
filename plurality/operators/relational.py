"""Projection, filters, appends and semi-joins with explicit null rules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.functions import as_ordinal, col, rank_of, unique
from plurality.schema import VoteLayout


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select and reorder; a name given twice is kept once."""
    return df.select(*[col(c) for c in unique(columns)])


def move_to_front(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns first, all others after them in their order."""
    return project(df, [*columns, *df.columns])


def copy_column(df: DataFrame, source: str, name: str) -> DataFrame:
    """Add ``name`` as a copy of ``source``."""
    return df.withColumn(name, col(source))


def valid_votes(votes: DataFrame, layout: VoteLayout) -> DataFrame:
    """Votes with a rating: blank and NULL ratings are dropped."""
    return votes.filter(col(layout.value) != "")


def normalise(votes: DataFrame, layout: VoteLayout) -> DataFrame:
    """Valid votes with unlisted roles and unlisted ratings set to NULL."""
    return valid_votes(votes, layout).withColumns(
        {
            layout.role: as_ordinal(col(layout.role), layout.role_levels),
            layout.value: as_ordinal(col(layout.value), layout.value_levels),
        }
    )


def with_ranks(votes: DataFrame, layout: VoteLayout) -> DataFrame:
    """Normalised votes plus ``value_rank`` and ``role_rank`` (NULL if unlisted)."""
    return normalise(votes, layout).withColumns(
        {
            "value_rank": rank_of(col(layout.value), layout.value_levels),
            "role_rank": rank_of(col(layout.role), layout.role_levels),
        }
    )


def exclude(df: DataFrame, **unwanted: Any) -> DataFrame:
    """Rows whose columns differ from the given values; NULL never differs."""
    for name, value in unwanted.items():
        df = df.filter(col(name) != F.lit(value))
    return df


def lookup(df: DataFrame, **wanted: Any) -> DataFrame:
    """Rows whose columns equal all the given values; NULL equals nothing."""
    for name, value in wanted.items():
        df = df.filter(col(name) == F.lit(value))
    return df


def join_null_safe(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL matches NULL; ``on`` appears once in the result.

    ``<=>`` keeps it a shuffled or broadcast equi-join, as Spark's statistics
    decide, and adaptive execution can split a hot key of the left side.
    """
    names = unique(on)
    other = right.select(
        *[col(c).alias(f"_right_{c}" if c in names else c) for c in right.columns]
    )
    condition = F.lit(True)
    for n in names:
        condition = condition & col(n).eqNullSafe(col(f"_right_{n}"))
    joined = left.join(other, condition, how)
    if how == "left_semi":
        return joined
    return project(joined, [*left.columns, *[c for c in right.columns if c not in names]])


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows with a match in ``right``; NULL matches NULL.

    The right side is reduced to distinct keys before it is shuffled for the
    join, so copies of one hot key are combined in the map tasks. Where it has
    none, ``join_null_safe(..., "left_semi")`` does the same for less.
    """
    matches = project(right, on).distinct()
    return join_null_safe(left, matches, on, "left_semi")


def natural_semi(left: DataFrame, right: DataFrame) -> DataFrame:
    """Semi-join on every column name the two tables share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return semi_join(left, right, shared)


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both, matched by name; a missing column becomes NULL."""
    return first.unionByName(second, allowMissingColumns=True)
