"""Showing a few broken ties, or one cell, beside the votes behind them."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.operators.consensus import consensus
from plurality.operators.relational import (
    join_null_safe,
    lookup,
    normalise,
    project,
    semi_join,
    valid_votes,
)
from plurality.operators.sampling import sample_rows, smallest_lots
from plurality.operators.tally import (
    tie_pool_contenders,
    tie_pool_overall,
    tie_rows,
    tied_groups,
    tied_values,
)
from plurality.schema import VoteLayout
from plurality.session import materialise


CHECK_NUMBER = "check_number"


class Audit(NamedTuple):
    """The sampled tie rows, all votes of their groups, and the decisions.

    ``check_number`` (1..n) pairs a sampled row with the votes and the decision of
    its group; a group sampled twice is listed under both numbers.
    """

    sample: DataFrame
    original: DataFrame
    clean: DataFrame


def audit_ties(
    votes: DataFrame,
    layout: VoteLayout,
    n: int = 5,
    seed: int = 2024,
    scored: DataFrame | None = None,
    policy: str = "ranked",
    tied: DataFrame | None = None,
) -> Audit:
    """Sample ``n`` of the votes that compete in a tie and list their groups.

    Votes are sampled, groups are counted: one group can be hit twice, and
    ``n`` above the number of tied groups is refused. ``scored`` is a
    consensus under ``policy`` computed before, and ``tied`` its tied ratings
    (``ranked``) or tied groups, read more than once. Under ``ranked`` the listing of
    original votes leaves out NULL ratings, though they count.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    # Both tables are read several times and cost a pass over the votes each.
    ranked = policy == "ranked"
    if tied is None:
        tied = tied_values(votes, layout) if ranked else tied_groups(votes, layout)
        tied = materialise(tied, "tied")
    groups = tied.groupBy(*[col(k) for k in layout.keys]).agg(F.sum("vote_count").alias("n"))
    ties, competing = groups.agg(F.count("*"), F.sum("n")).first()
    if n > ties:
        raise ValueError(
            f"cannot audit {n} ties: the table has {ties}; lower n or skip the audit"
        )
    listed = [*layout.keys, layout.value, layout.role]
    row_key = [*layout.keys, *layout.order]
    # Enough of the votes with the smallest lots hold the sample: the others need not be
    # looked up in a tie. Where they turn out to be too few, more are taken, up to all.
    share = min(1.0, FIRST_LOTS * n / max(1, competing or 0))
    while True:
        among = votes if share == 1 else smallest_lots(votes, share, seed, row_key)
        pool = project(
            _POOLS[policy](votes, layout, tied, among), [*listed, *layout.order]
        )
        sample = materialise(sample_rows(pool, n, seed, row_key, CHECK_NUMBER), "sample")
        if share == 1 or sample.count() >= n:
            break
        share = min(1.0, share * MORE_LOTS)
    checks = project(sample, [*layout.keys, CHECK_NUMBER])
    hit = _votes_of(votes, sample, layout, n)
    if scored is None:
        # A group is scored from its own votes, so the sampled ones suffice.
        scored = consensus(hit, layout, policy, carry=())
    shown = valid_votes(normalise(hit, layout) if ranked else hit, layout)
    numbered = [CHECK_NUMBER, *listed]
    original = join_null_safe(project(shown, listed), checks, layout.keys)
    clean = join_null_safe(project(scored, listed), checks, layout.keys)
    return Audit(sample, project(original, numbered), project(clean, numbered))


# So many competing votes are expected among those looked up, for each one sampled; where
# they are too few after all, the share of the lots grows so many times.
FIRST_LOTS = 8
MORE_LOTS = 8

# Keys of at most so many sampled rows become literals of the scan.
LITERAL_KEYS = 200


def _votes_of(votes: DataFrame, sample: DataFrame, layout: VoteLayout, n: int) -> DataFrame:
    """The votes of the sampled groups.

    Few keys are bound into the scan, which then skips files and row groups that hold
    none of them; many are joined.
    """
    if n > LITERAL_KEYS:
        return semi_join(votes, sample, layout.keys)
    chosen = F.lit(False)
    for row in project(sample, layout.keys).distinct().collect():
        same = F.lit(True)
        for name, value in zip(layout.keys, row):
            kind = sample.schema[name].dataType
            same = same & (
                col(name).isNull() if value is None else col(name) == F.lit(value).cast(kind)
            )
        chosen = chosen | same
    return votes.filter(chosen)


# The votes that compete in a tie, by policy.
_POOLS = {
    "ranked": tie_rows,
    "contenders": tie_pool_contenders,
    "overall": tie_pool_overall,
}


def compare_cell(
    votes: DataFrame, layout: VoteLayout, scored: dict[str, DataFrame], **cell: Any
) -> DataFrame:
    """One cell's votes and its rating in each scored table, tagged ``stage``."""
    columns = [*layout.keys, layout.role, layout.value]
    combined = project(lookup(votes, **cell), columns).withColumn("stage", F.lit("votes"))
    for stage, table in scored.items():
        rows = project(lookup(table, **cell), columns)
        combined = combined.unionByName(rows.withColumn("stage", F.lit(stage)))
    return combined
