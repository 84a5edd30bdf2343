"""Frequency table, cross-tab and the summary of a scoring run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.operators.consensus import decide, decide_raw
from plurality.schema import VoteLayout

NULL_COLUMN = "NA_"
OTHER_COLUMN = "OTHER_"


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of ``column``; NULL is not counted."""
    present = df.filter(col(column).isNotNull())
    return present.groupBy(col(column)).agg(F.count("*").alias("n"))


def crosstab(
    df: DataFrame, rows: str, columns: str, levels: Sequence[str] | None = None
) -> DataFrame:
    """Counts of ``columns`` labels per ``rows`` value, zeros filled.

    Every level gets a column, in the given order, labels that are no level share
    ``OTHER_``, and NULL gets ``NA_``: a row of counts adds up to its rows. One
    aggregate per column keeps it a single map-side combined shuffle. Without
    ``levels`` the labels are looked up first, which costs a job; for more labels
    than a table has room for use :func:`label_counts`.
    """
    if levels is None:
        levels = _labels(df, columns)
    taken = {NULL_COLUMN, OTHER_COLUMN}.intersection(levels)
    if taken:
        raise ValueError(f"{sorted(taken)} are columns of NULL and unlisted labels")
    label = col(columns)
    counts = [F.count_if(label == level).alias(level) for level in levels]
    other = F.count_if(~label.isin(*levels)).alias(OTHER_COLUMN)
    missing = F.count_if(label.isNull()).alias(NULL_COLUMN)
    return df.groupBy(col(rows)).agg(*counts, other, missing)


def label_counts(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """The cross-tab in long form: ``n`` per row and label, NULL among both."""
    return df.groupBy(col(rows), col(columns)).agg(F.count("*").alias("n"))


def _labels(df: DataFrame, column: str) -> list[str]:
    """The labels of a column, up to the number Spark allows for a pivot."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = (
        df.filter(col(column).isNotNull()).select(col(column)).distinct().limit(limit + 1)
    ).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} labels; pass levels or use label_counts")
    return sorted(row[0] for row in found)


def score_summary(
    votes: DataFrame,
    layout: VoteLayout,
    policy: str = "ranked",
    decided: DataFrame | None = None,
) -> DataFrame:
    """One row: votes, groups, ties, clear groups, and two messages.

    Under ``ranked`` unlisted ratings tie as one; under the other policies
    each label counts for itself. ``decided`` is the policy's decisions, if at hand.
    """
    if decided is None and policy == "ranked":
        decided = decide(votes, layout, carry=())
    elif decided is None:
        decided = decide_raw(votes, layout, policy, carry=())
    return _worded(decided.agg(*summary_totals()), layout)


def summary_totals() -> list[Column]:
    """The numbers of a summary, as aggregates over the decisions."""
    return [
        F.coalesce(F.sum("votes"), F.lit(0)).alias("votes"),
        F.count("*").alias("groups"),
        F.count_if(col("tied")).alias("ties"),
        F.count_if(~col("tied")).alias("clear"),
    ]


def summary_of(spark: SparkSession, totals: dict[str, int], layout: VoteLayout) -> DataFrame:
    """:func:`score_summary` from :func:`summary_totals` observed before."""
    numbers = [
        F.lit(totals[name]).cast("bigint").alias(name)
        for name in ("votes", "groups", "ties", "clear")
    ]
    return _worded(spark.range(1).select(*numbers), layout)


def _worded(totals: DataFrame, layout: VoteLayout) -> DataFrame:
    return totals.select(
        "*",
        _groups_message(layout).alias("groups_message"),
        _ties_message().alias("ties_message"),
    )


# The wording of the two messages.


def _groups_message(layout: VoteLayout) -> Column:
    names = list(layout.keys)
    listed = names[0] if len(names) == 1 else f"{', '.join(names[:-1])}, and {names[-1]}"
    return F.concat_ws(
        " ",
        F.lit("The data has"),
        F.col("groups").cast("string"),
        F.lit(f"entries when grouped by {listed}."),
    )


def _ties_message() -> Column:
    return F.concat_ws(
        " ", F.lit("The data had "), F.col("ties").cast("string"), F.lit("ties.")
    )
