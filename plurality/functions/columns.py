"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by its literal name; dots in the name are not struct access."""
    return F.col("`" + name.replace("`", "``") + "`")


def unique(names: Iterable[str]) -> list[str]:
    """Names in first-seen order, repeats dropped."""
    return list(dict.fromkeys(names))


def nulls_last(names: Iterable[str]) -> list[Column]:
    """Ascending sort keys with NULL after every value."""
    return [col(n).asc_nulls_last() for n in names]


def comparable(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """Struct fields that make ``min(struct(...))`` follow :func:`nulls_last`.

    Struct comparison puts NULL first, so a nullable column is preceded by
    its null flag; columns declared not-null need none.
    """
    fields = []
    for n in names:
        if df.schema[n].nullable:
            fields.append(col(n).isNull().alias(f"_null_{n}"))
        fields.append(col(n).alias(n))
    return fields
