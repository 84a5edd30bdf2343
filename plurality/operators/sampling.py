"""Repeatable random samples, drawn by hashing a seed with a row key.

The same seed always gives the same sample, whatever the partitioning, and
any engine with MD5 can draw it again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.operators import indexing
from plurality.operators.relational import project

# Hexadecimal digits of a lot read by one histogram, and the digits a lot has.
HISTOGRAM_DIGITS = 4
_LOT_DIGITS = 32
# Digits that a share of the lots is cut by.
_SHARE_DIGITS = 12


def seeded_order(seed: int, row_key: Sequence[str]) -> Column:
    """A pseudo-random sort key for the row identified by ``row_key``."""
    parts = [col(c).cast("string") for c in row_key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def sample_rows(
    df: DataFrame, n: int, seed: int, row_key: Sequence[str], number: str | None = None
) -> DataFrame:
    """``n`` rows without replacement; ``number`` names a column for 1..n as drawn.

    A large sample is cut out by the leading digits of the lots before any row moves:
    little more than ``n`` rows are shuffled, whatever the size of the table.
    """
    lot, place = indexing.unused(df, "_lot"), number or indexing.unused(df, "_drawn")
    lots = df.withColumn(lot, seeded_order(seed, row_key))
    if n > indexing.TOP_ROWS:
        lots = _cut(lots, lot, n)
    drawn = indexing.first_rows(lots, [lot, *row_key], n, place)
    return project(drawn, [*df.columns, number] if number else df.columns)


def smallest_lots(
    df: DataFrame, share: float, seed: int, row_key: Sequence[str]
) -> DataFrame:
    """The rows whose lots are among the first ``share`` of all lots there are.

    Every row that :func:`sample_rows` would draw before one of them is there too.
    """
    if share >= 1:
        return df
    bound = format(int(max(share, 0) * 16**_SHARE_DIGITS), f"0{_SHARE_DIGITS}x")
    return df.filter(seeded_order(seed, row_key) < bound)


def _cut(lots: DataFrame, lot: str, n: int) -> DataFrame:
    """The rows with the smallest lots: at least ``n``, if there are so many.

    A histogram over the leading digits tells in which bin the ``n``-th lot lies. As
    long as that bin alone holds more than ``n`` rows, the next digits divide it.
    """
    below, prefix = 0, ""
    while len(prefix) < _LOT_DIGITS:
        width = len(prefix) + HISTOGRAM_DIGITS
        inside = lots.filter(col(lot).startswith(prefix)) if prefix else lots
        bins = inside.groupBy(F.substring(lot, 1, width).alias("bin")).agg(
            F.count("*").alias("size")
        )
        # One row per bin: at most 16 ** HISTOGRAM_DIGITS.
        running = F.sum("size").over(Window.orderBy("bin"))
        reached = bins.select("bin", "size", (running + below).alias("upto"))
        last = reached.filter(F.col("upto") >= n).orderBy("bin").first()
        if last is None:
            return lots
        below, prefix = last["upto"] - last["size"], last["bin"]
        if last["size"] <= n:
            break
    return lots.filter(F.substring(lot, 1, len(prefix)) <= prefix)


def draws(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    """``n`` draws with replacement from 1..k: ``draw`` and ``position``."""
    if n < 0 or k < 1:
        raise ValueError("n must not be negative and k must be positive")
    text = F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    numbered = spark.range(1, n + 1).withColumnRenamed("id", "draw")
    return numbered.withColumn("position", number % F.lit(k) + 1)


def bootstrap(
    df: DataFrame, n: int, k: int, seed: int, order: Sequence[str]
) -> DataFrame:
    """``n`` rows drawn with replacement from the first ``k`` in ``order``.

    Adds ``draw`` (1..n). Only the pool of ``k`` rows is numbered. A draw beyond
    the end of a shorter table is a row of NULLs, so there are always ``n`` rows.
    """
    pool = indexing.first_rows(df, order, k, "position")
    drawn = draws(df.sparkSession, n, k, seed).join(pool, "position", "left")
    return project(drawn, ["draw", *df.columns])


def bootstrap_weights(
    df: DataFrame, n: int, k: int, seed: int, order: Sequence[str]
) -> DataFrame:
    """The rows of :func:`bootstrap`, each once: how often and when first drawn.

    Adds ``draw`` (the first one) and ``weight`` (how many). Rows that no draw hits,
    and draws beyond the end of a shorter table, are left out.
    """
    pool = indexing.first_rows(df, order, k, "position")
    hits = (
        draws(df.sparkSession, n, k, seed)
        .groupBy("position")
        .agg(F.min("draw").alias("draw"), F.count("*").alias("weight"))
    )
    return project(hits.join(pool, "position"), ["draw", "weight", *df.columns])
