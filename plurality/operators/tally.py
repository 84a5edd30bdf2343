"""The steps of scoring as tables of their own.

Under policy ``ranked`` rating labels are normalised first, so a group has at most
one row per rating level and one for the NULL rating. ``contenders`` and ``overall``
take labels as they are.

Fixed values: the names ``max_exists``, ``participant_priority``, ``value_priority``
and ``group_index_`` of output columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.functions import col, label_at, rank_of
from plurality.operators.consensus import decide, decide_raw, leaders, scoreboard
from plurality.operators.indexing import number_rows
from plurality.operators.relational import (
    append,
    copy_column,
    join_null_safe,
    move_to_front,
    normalise,
    project,
    valid_votes,
)
from plurality.schema import VoteLayout
from plurality.session import materialise


def vote_counts(votes: DataFrame, layout: VoteLayout) -> DataFrame:
    """Votes per group and rating; ratings without votes have no row."""
    by = [col(c) for c in (*layout.keys, layout.value)]
    return normalise(votes, layout).groupBy(*by).agg(F.count("*").alias("vote_count"))


def flagged_counts(votes: DataFrame, layout: VoteLayout) -> DataFrame:
    """:func:`vote_counts` with the group's maximum and an is-maximum flag."""
    return _flagged(votes, layout).drop("_leaders")


def top_values(votes: DataFrame, layout: VoteLayout) -> DataFrame:
    """The most frequent ratings of every group."""
    return flagged_counts(votes, layout).filter("max_exists")


def tied_values(
    votes: DataFrame, layout: VoteLayout, board: DataFrame | None = None
) -> DataFrame:
    """The most frequent ratings of the groups that have several.

    ``board`` is a table with the scoreboard's counts, if it is at hand.
    """
    tied = _flagged(votes, layout, board).filter("max_exists AND _leaders > 1")
    return project(tied, [*layout.keys, layout.value, "vote_count"])


def clear_values(votes: DataFrame, layout: VoteLayout) -> DataFrame:
    """The most frequent rating of the groups that have only one."""
    clear = _flagged(votes, layout).filter("max_exists AND _leaders = 1")
    return project(clear, [*layout.keys, layout.value, "vote_count"])


def clear_winners(votes: DataFrame, layout: VoteLayout) -> DataFrame:
    """Every vote for the winning rating of an untied group, with its role."""
    winners = join_null_safe(
        normalise(votes, layout),
        clear_values(votes, layout),
        [*layout.keys, layout.value],
        "left_semi",
    )
    return project(winners, [*layout.keys, layout.value, layout.role])


def tie_rows(
    votes: DataFrame,
    layout: VoteLayout,
    tied: DataFrame | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """Every vote for a tied rating, with its role and value priority.

    ``tied`` is the result of :func:`tied_values`, if it is at hand. ``among`` holds the
    votes that are looked through, if they are not all that were counted.
    """
    if tied is None:
        tied = tied_values(votes, layout)
    on = [*layout.keys, layout.value]
    cast = normalise(votes if among is None else among, layout)
    rows = join_null_safe(cast, tied, on, "left_semi")
    return rows.withColumns(
        {
            "participant_priority": rank_of(
                col(layout.role), layout.role_levels, default=len(layout.role_levels)
            ),
            "value_priority": rank_of(col(layout.value), layout.value_levels),
        }
    )


def numbered_decisions(votes: DataFrame, layout: VoteLayout) -> DataFrame:
    """:func:`decide` with ``group_index``, the group's place in key order.

    Numbering reads its rows several times, so the decisions are written first: the
    votes are read once.
    """
    decided = materialise(decide(votes, layout, carry=()), "decided")
    return move_to_front(number_rows(decided, layout.keys, "group_index"), "group_index")


def tie_breaks(votes: DataFrame, layout: VoteLayout) -> DataFrame:
    """The decision of every tied group."""
    ties = numbered_decisions(votes, layout).filter("tied")
    ties = ties.withColumnRenamed("role_priority", "participant_priority")
    return project(
        copy_column(ties, "group_index", "group_index_"),
        [
            "group_index",
            *layout.keys,
            layout.value,
            layout.role,
            "participant_priority",
            "value_priority",
            "group_index_",
        ],
    )


def winner_list(
    votes: DataFrame, layout: VoteLayout, numbered: bool = True
) -> DataFrame:
    """Clear winners (one row per vote) followed by the broken ties.

    Without ``numbered`` the ``group_index`` column, and with it the global
    sort, is left out.
    """
    on = [*layout.keys, layout.value]
    index = ["group_index"] if numbered else []
    if numbered:
        decided = numbered_decisions(votes, layout)
    else:
        decided = decide(votes, layout, carry=())
    columns = [*index, *on, layout.role]
    cast = project(normalise(votes, layout), [*on, layout.role])
    clear = project(decided.filter("NOT tied"), [*index, *on])
    voters = project(join_null_safe(cast, clear, on), columns)
    return append(voters, project(decided.filter("tied"), columns))


# -- raw labels --------------------------------------------------------------


def tied_groups(
    votes: DataFrame, layout: VoteLayout, decided: DataFrame | None = None
) -> DataFrame:
    """Keys of the tied groups and the vote count their ratings share.

    ``decided`` is the result of :func:`decide_raw`, if it is at hand.
    """
    if decided is None:
        decided = decide_raw(votes, layout, "contenders", carry=())
    return decided.filter("tied").select(
        *[col(k) for k in layout.keys], col("max_votes").alias("vote_count")
    )


def tie_pool_overall(
    votes: DataFrame,
    layout: VoteLayout,
    tied: DataFrame | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """Every valid vote of a tied group.

    ``tied`` is the result of :func:`tied_groups`, if it is at hand; ``among`` as in
    :func:`tie_rows`.
    """
    if tied is None:
        tied = tied_groups(votes, layout)
    cast = valid_votes(votes if among is None else among, layout)
    return join_null_safe(cast, tied, layout.keys, "left_semi")


def tie_pool_contenders(
    votes: DataFrame,
    layout: VoteLayout,
    tied: DataFrame | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """Every valid vote for a tied rating; ``tied`` and ``among`` as above."""
    if tied is None:
        tied = tied_groups(votes, layout)
    valid = valid_votes(votes, layout)
    by = [col(c) for c in (*layout.keys, layout.value)]
    counts = valid.groupBy(*by).agg(F.count("*").alias("vote_count"))
    tied_ratings = join_null_safe(
        counts, tied, [*layout.keys, "vote_count"], "left_semi"
    )
    on = [*layout.keys, layout.value]
    cast = valid if among is None else valid_votes(among, layout)
    return join_null_safe(cast, tied_ratings, on, "left_semi")


_RAW_POOLS = {"contenders": tie_pool_contenders, "overall": tie_pool_overall}


def raw_tie_rows(votes: DataFrame, layout: VoteLayout, policy: str) -> DataFrame:
    """The votes that compete in a tie, with the priorities that decide it.

    A role or rating without a rank has a NULL priority, which comes last.
    """
    return _RAW_POOLS[policy](votes, layout).withColumns(
        {
            "participant_priority": rank_of(col(layout.role), layout.strict_role_levels),
            "value_priority": rank_of(col(layout.value), layout.value_levels),
        }
    )


def raw_tie_breaks(votes: DataFrame, layout: VoteLayout, policy: str) -> DataFrame:
    """The vote that decides every tied group, as :func:`tie_breaks`.

    It is the first by role priority, value priority and file order. The decisions are
    written before they are numbered, as in :func:`numbered_decisions`.
    """
    decided = decide_raw(votes, layout, policy, breaks=True, reported=False)
    decided = materialise(decided, "decided")
    ties = number_rows(decided, layout.keys, "group_index").filter("tied")
    ties = ties.withColumns(
        {
            layout.role: col("deciding_role"),
            "participant_priority": col("role_priority"),
            "group_index_": col("group_index"),
        }
    )
    shown = [layout.value, layout.role, "participant_priority", "value_priority"]
    return project(ties, ["group_index", *layout.keys, *shown, "group_index_"])


def raw_winner_list(
    votes: DataFrame, layout: VoteLayout, policy: str, numbered: bool = True
) -> DataFrame:
    """The agreed rating of every group, one row each; ``numbered`` as above."""
    decided = project(
        decide_raw(votes, layout, policy, reported=False), [*layout.keys, layout.value]
    )
    if not numbered:
        return decided
    decided = materialise(decided, "decided")
    return move_to_front(number_rows(decided, layout.keys, "group_index"), "group_index")


def union_missing(votes: DataFrame, layout: VoteLayout) -> DataFrame:
    """Untied ratings with count and flag, and tie decisions without them."""
    decided = decide_raw(votes, layout, "overall", reported=False)
    untied = project(
        decided.filter("NOT tied").withColumn("max_exists", F.lit(True)),
        [*layout.keys, layout.value, "vote_count", "max_exists"],
    )
    ties = project(decided.filter("tied"), [*layout.keys, layout.value])
    return append(untied, ties)


def _flagged(
    votes: DataFrame, layout: VoteLayout, board: DataFrame | None = None
) -> DataFrame:
    """Long form of the scoreboard's counts; ``_leaders`` ratings share the top.

    The counts of a group sit in one row, so maximum and ties are row-local:
    no window and no second shuffle.
    """
    slots = range(1, len(layout.value_levels) + 2)
    keys = [col(k) for k in layout.keys]
    if board is None:
        board = scoreboard(votes, layout, carry=())
    counted = board.withColumn(
        "max_votes", F.greatest(*[col(f"n_{s}") for s in slots])
    )
    ratings = F.array(
        *[
            F.struct(
                label_at(F.lit(s), layout.value_levels).alias(layout.value),
                col(f"n_{s}").alias("vote_count"),
            )
            for s in slots
        ]
    )
    return (
        counted.withColumn("_leaders", leaders(slots, col("max_votes")))
        .select(*keys, "max_votes", "_leaders", F.inline(ratings))
        .filter(col("vote_count") > 0)
        .withColumn("max_exists", col("vote_count") == col("max_votes"))
        .select(
            *keys, col(layout.value), "vote_count", "max_votes", "max_exists", "_leaders"
        )
    )
