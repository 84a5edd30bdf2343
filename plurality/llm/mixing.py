"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to an exponent between 0 (all sources alike)
and 1 (as they are). The exponent is bisected until the weights' entropy reaches a
target, without any source being repeated more often than a limit. Weights times a
token budget give every source a budget: so many whole epochs and a part of one.
Every source is dealt into blocks by hash; an epoch is a permutation of its blocks,
and of the documents inside each block, so only block sizes are ever put in order.
The last, partial epoch ends inside one block, whose documents alone are summed.

Without a given budget it is the smallest that gives every source a whole epoch:
then no document is left out, and smaller sources are repeated.

Results for odd input: a NULL source counts as the source ``''``; a NULL or empty
text counts one token (its end); very long texts are counted whole; rows with equal or
NULL ids are told apart by their other columns, rows equal in all are interchangeable
copies; equal lots go to the smaller document first; a single
source has weight 1; an empty table gives no rows. Other columns are kept as they
are, whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.session import materialise

SEED = 1_729
BLOCKS = 1 << 12
# Bisection levels settled by one pass over the sources, and passes.
LEVELS, PASSES = 5, 6


class Target(NamedTuple):
    """``entropy``: least entropy of the weights, as a share of the greatest
    possible; ``repeats``: most epochs of any source; ``budget``: tokens."""

    entropy: float | None = 0.95
    repeats: float | None = 2.0
    budget: int | None = None


def token_count(text: Column) -> Column:
    """Words of a text, and one for its end."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return (F.size(words) + 1).cast("bigint")


def exponent(totals: DataFrame, target: Target) -> float:
    """The exponent for ``totals`` (one row per source, ``tokens`` > 0).

    The largest one that reaches the entropy, or the smallest that keeps the
    repetition limit if that is larger. Every pass evaluates all points that
    ``LEVELS`` bisection steps can visit and returns one row of sums.
    """
    size = totals.agg(F.max("tokens").alias("most"), F.count("*").alias("n")).first()
    if not size["n"] or size["n"] == 1:
        return 1.0
    most, n = float(size["most"]), size["n"]
    log = F.log(F.col("tokens") / F.lit(most))

    def sums(points: list[float]) -> list[tuple[float, float, float]]:
        parts = []
        for i, a in enumerate(points):
            power = F.exp(log * a)
            parts += [
                F.sum(power).alias(f"z{i}"),
                F.sum(power * log).alias(f"s{i}"),
                F.max(F.exp(log * (a - 1))).alias(f"r{i}"),
            ]
        row = totals.agg(*parts).first()
        return [(row[f"z{i}"], row[f"s{i}"], row[f"r{i}"]) for i in range(len(points))]

    def flat_enough(a: float, z: float, s: float, _: float) -> bool:
        return math.log(z) - a * s / z >= (target.entropy or 0.0) * math.log(n)

    def repeated_too_often(a: float, z: float, _: float, r: float) -> bool:
        # The largest source is repeated least: 1 time, or as the budget has it.
        least = 1.0 if target.budget is None else target.budget / (z * most)
        return r * least > (target.repeats or math.inf)

    by_entropy = _largest(sums, flat_enough) if target.entropy is not None else 0.0
    by_repeats = _largest(sums, repeated_too_often) if target.repeats is not None else 0.0
    return max(by_entropy, by_repeats)


def _largest(sums, holds) -> float:
    """The largest exponent in [0, 1] where ``holds``, true below and false above."""
    low, high = 0.0, 1.0
    if holds(1.0, *sums([1.0])[0]):
        return 1.0
    for _ in range(PASSES):
        steps = 1 << LEVELS
        points = [low + (high - low) * i / steps for i in range(1, steps)]
        true = [p for p, s in zip(points, sums(points)) if holds(p, *s)]
        low, high = (max(true) if true else low), low + (high - low) * (len(true) + 1) / steps
    return high


def budgets(totals: DataFrame, target: Target) -> DataFrame:
    """``totals`` with ``weight`` (sums to 1) and ``budget`` (tokens)."""
    a = exponent(totals, target)
    power = F.pow(F.col("tokens").cast("double"), F.lit(a))
    row = totals.agg(F.sum(power).alias("z"), F.max("tokens").alias("most")).first()
    z, most = row["z"] or 1.0, row["most"] or 1
    total = target.budget if target.budget is not None else most / (most**a / z)
    weight = power / F.lit(z)
    return totals.select(
        "source",
        "tokens",
        weight.alias("weight"),
        F.round(weight * F.lit(float(total))).cast("bigint").alias("budget"),
    )


def mix(
    docs: DataFrame,
    target: Target = Target(),
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    seed: int = SEED,
) -> DataFrame:
    """All columns of ``docs`` once per copy, as struct ``row``, and its place.

    ``epoch`` counts from 0, ``block`` is the document's block, ``n_tokens`` its
    size, ``slot`` its place in [0, 1): rows sorted by slot mix all sources at
    their weights throughout. A source's last copy may exceed its budget by less
    than one document.
    """
    # Rows with one id, or none, differ in other columns; maps cannot be hashed.
    whole = [
        col(f.name)
        for f in docs.schema.fields
        if f.name != doc_id and "map<" not in f.dataType.simpleString()
    ]
    key = F.xxhash64(F.lit(seed), col(doc_id), *whole)
    rows = docs.select(
        F.coalesce(col(source).cast("string"), F.lit("")).alias("source"),
        key.alias("key"),
        F.pmod(key, F.lit(BLOCKS)).cast("int").alias("block"),
        token_count(col(text)).alias("n_tokens"),
        F.struct(*[col(c) for c in docs.columns]).alias("row"),
    )
    sizes = materialise(
        rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")), "blocks"
    )
    totals = materialise(
        sizes.groupBy("source").agg(F.sum("block_tokens").alias("tokens")), "sources"
    )
    shares = budgets(totals, target)
    # A block once per epoch that its source begins, in that epoch's order.
    epochs = F.sequence(F.lit(0), F.ceil(F.col("budget") / F.col("tokens")).cast("int") - 1)
    dealt = sizes.join(shares.filter("budget > 0"), "source").withColumn("epoch", F.explode(epochs))
    turn = F.xxhash64(F.lit(seed), "source", "epoch", "block")
    earlier = (
        Window.partitionBy("source", "epoch")
        .orderBy(turn, "block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0))
    start = F.col("epoch") * F.col("tokens") + before
    dealt = dealt.withColumn("start", start).filter("start < budget")
    whole = dealt.filter("start + block_tokens <= budget")
    part = dealt.filter("start + block_tokens > budget")

    lot = F.xxhash64(F.lit(seed), "epoch", "key")
    copies = rows.join(whole, ["source", "block"])
    inside = (
        Window.partitionBy("source", "epoch")
        .orderBy(lot, "n_tokens")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    last = rows.join(part, ["source", "block"]).withColumn(
        "ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    )
    last = last.filter(F.col("start") + F.col("ahead") < F.col("budget")).drop("ahead")
    # Places inside a block follow the same lots as its permutation.
    size = F.least(F.col("block_tokens"), F.col("budget") - F.col("start"))
    within = (F.shiftrightunsigned(lot, 11) / F.lit(float(1 << 53))) * size
    slot = (F.col("start") + within) / F.col("budget")
    return copies.unionByName(last).select(
        "row", "source", "epoch", "block", "n_tokens", slot.alias("slot")
    )


def mixed_documents(docs: DataFrame, target: Target = Target(), **columns: str) -> DataFrame:
    """The mixture with the columns of ``docs`` alone, a row per copy."""
    return mix(docs, target, **columns).select("row.*")
