"""One agreed rating per group: majority vote with ranked tie-breaking.

Three policies share the vote count and differ in how a tie is broken and
which vote is reported.

``ranked``
    Unlisted labels count as NULL. Among the votes for the most frequent
    ratings the most senior observer wins, then the best rating; that vote
    is reported.
``contenders``
    Labels are taken as they are. The same order picks the *rating*; the
    first vote in file order with that rating is reported.
``overall``
    As ``contenders``, but in a tied group every vote competes, so a rating
    in the minority can be chosen.

Every policy is built from grouped aggregates alone. A group that holds a
large share of all votes is folded to a few rows inside each map task before
anything is shuffled, so no task ever sees a whole group and no window has
to sort one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality.functions import col, comparable, label_at, rank_of
from plurality.operators.relational import normalise, project, valid_votes
from plurality.schema import VoteLayout

POLICIES = ("ranked", "contenders", "overall")


def consensus(
    votes: DataFrame,
    layout: VoteLayout,
    policy: str = "ranked",
    carry: Sequence[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """The reported vote of every group, with its ``vote_count``.

    Columns: keys, role, value, ``vote_count``, then the carried columns
    (``carry``; by default all others of ``votes``). The smaller ``carry``,
    the less is shuffled. A map can be carried, but not one inside another column.
    ``weight`` names a column that says how many equal votes a row stands for; a row
    of weight 0 or NULL takes no part. It is not carried unless ``carry`` names it.
    """
    if weight is not None:
        votes = votes.filter(col(weight) > 0)
        if carry is None:
            carry = [c for c in layout.carried(votes.columns) if c != weight]
    carried = _carried(votes, layout, carry)
    if policy == "ranked":
        decided = decide(votes, layout, carried, weight=weight)
    elif policy in POLICIES:
        decided = decide_raw(votes, layout, policy, carried, weight=weight)
    else:
        raise ValueError(f"unknown policy {policy!r}; choose one of {POLICIES}")
    return project(decided, [*layout.keys, layout.role, layout.value, "vote_count", *carried])


# -- policy "ranked" ---------------------------------------------------------


def scoreboard(
    votes: DataFrame,
    layout: VoteLayout,
    carry: Sequence[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per group: what is known of the votes for every rating.

    For rating level ``i``, ``n_<i>`` counts its votes (adds their ``weight``), ``senior_<i>`` is the
    best role rank among them (an unlisted role comes after the last rank) and
    ``first_<i>`` holds the carried columns of the vote that comes first by
    role rank and file order. The slot after the last level is the NULL rating.

    The number of slots is fixed by the level list, so one shuffle of map-side
    combined rows decides every group. Readers that use no carried column get
    a hash aggregate of integers: the structs are pruned.
    """
    carried = _carried(votes, layout, carry)
    slots = _slots(layout)
    unlisted = len(layout.role_levels) + 1
    ballots = normalise(votes, layout).withColumns(
        {
            "_slot": rank_of(col(layout.value), layout.value_levels, default=slots[-1]),
            "_rank": rank_of(col(layout.role), layout.role_levels, default=unlisted),
        }
    )
    vote = F.struct(
        col("_rank"),
        *comparable(ballots, layout.order),
        *[_packed(votes, c) for c in carried if c not in layout.order],
    )
    aggregates = []
    for slot in slots:
        here = col("_slot") == slot
        aggregates.append(_votes_where(here, weight).alias(f"n_{slot}"))
        aggregates.append(F.min(F.when(here, col("_rank"))).alias(f"senior_{slot}"))
        if carried:
            aggregates.append(F.min(F.when(here, vote)).alias(f"first_{slot}"))
    keys = _sorting_keys(layout) if carried else [col(k) for k in layout.keys]
    return ballots.groupBy(*keys).agg(*aggregates)


def _votes_where(here: Column, weight: str | None) -> Column:
    """How many votes fulfil a condition."""
    if weight is None:
        return F.count_if(here)
    return F.sum(F.when(here, col(weight)).otherwise(0)).cast("bigint")


def decide(
    votes: DataFrame,
    layout: VoteLayout,
    carry: Sequence[str] | None = None,
    counts: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """One row per group: whether it was tied, and the vote that decides it.

    Columns: keys, ``votes``, ``tied``, role, value, ``vote_count``,
    ``role_priority``, ``value_priority``, carried columns, and with ``counts`` the
    scoreboard's ``n_<i>``.
    """
    slots = _slots(layout)
    carried = _carried(votes, layout, carry)
    board = scoreboard(votes, layout, carried, weight)
    keys = [col(k) for k in layout.keys]
    last_priority = F.lit(len(layout.role_levels))

    # Among the most frequent ratings: best role priority, then best rating.
    # Both are small integers, so one number holds the pair.
    base = slots[-1] + 1
    leader = F.least(
        *[
            F.when(
                col(f"n_{s}") == col("vote_count"),
                F.least(col(f"senior_{s}"), last_priority) * base + s,
            )
            for s in slots
        ]
    )
    counted = board.withColumn("vote_count", F.greatest(*[col(f"n_{s}") for s in slots]))
    placed = counted.withColumn("_slot", leader % base)
    senior = _of_slot("senior", slots)
    first = _of_slot("first", slots) if carried else None
    return placed.select(
        *keys,
        sum((col(f"n_{s}") for s in slots[1:]), col(f"n_{slots[0]}")).alias("votes"),
        (leaders(slots, col("vote_count")) > 1).alias("tied"),
        label_at(senior, layout.role_levels).alias(layout.role),
        label_at(col("_slot"), layout.value_levels).alias(layout.value),
        col("vote_count"),
        F.least(senior, last_priority).alias("role_priority"),
        F.when(col("_slot") < slots[-1], col("_slot")).alias("value_priority"),
        *[_unpacked(votes, first, c) for c in carried],
        *[col(f"n_{s}") for s in slots if counts],
    )


def leaders(slots: Sequence[int], top: Column) -> Column:
    """How many ratings of a scoreboard row have ``top`` votes."""
    flags = [(col(f"n_{s}") == top).cast("int") for s in slots]
    return sum(flags[1:], flags[0])


def _of_slot(name: str, slots: Sequence[int]) -> Column:
    """The scoreboard's ``name`` column of the rating in ``_slot``."""
    chosen = F.when(col("_slot") == slots[0], col(f"{name}_{slots[0]}"))
    for s in slots[1:]:
        chosen = chosen.when(col("_slot") == s, col(f"{name}_{s}"))
    return chosen


# -- policies "contenders" and "overall" -------------------------------------


def decide_raw(
    votes: DataFrame,
    layout: VoteLayout,
    policy: str,
    carry: Sequence[str] | None = None,
    breaks: bool = False,
    weight: str | None = None,
    reported: bool = True,
) -> DataFrame:
    """As :func:`decide`, for labels taken as they are.

    Ratings are not limited to the level list here, so the votes are folded
    to one row per (group, rating) first and to one row per group after.
    Columns: keys, ``votes``, ``tied``, ``max_votes`` (of any rating), role, value,
    ``vote_count`` (of the chosen rating), carried columns, and with ``breaks`` the
    role (``deciding_role``) and the priorities of the vote that breaks a tie, NULL
    for labels without a rank and where nothing is tied. Role and carried columns are those of the first vote
    with the chosen rating; who needs neither leaves them out with ``reported`` false,
    and half of what is shuffled with them.
    """
    carried = _carried(votes, layout, carry) if reported else []
    value = col(layout.value)
    valid = valid_votes(votes, layout)
    no_role = len(layout.strict_role_levels) + 1
    no_value = len(layout.value_levels) + 1
    ballots = valid.withColumn(
        "_role_priority",
        rank_of(col(layout.role), layout.strict_role_levels, default=no_role),
    )
    in_order = comparable(ballots, layout.order)
    deciding = [col(layout.role).alias("deciding_role")] if breaks else []
    others = [_packed(votes, c) for c in carried if c not in layout.order]
    earliest = F.min(F.struct(*in_order, col(layout.role), *others)).alias("first")
    ratings = (
        ballots.groupBy(*_sorting_keys(layout), value)
        .agg(
            _votes_where(F.lit(True), weight).alias("vote_count"),
            F.min(F.struct(col("_role_priority"), *in_order, *deciding)).alias("senior"),
            *([earliest] if reported else []),
        )
        .withColumn(
            "_value_priority", rank_of(value, layout.value_levels, default=no_value)
        )
    )
    standing = [
        col("senior").getField("_role_priority").alias("role_priority"),
        col("_value_priority"),
        col("senior"),
        value.alias("value"),
        *([col("first")] if reported else []),
        col("vote_count"),
    ]
    behind = (-col("vote_count")).alias("behind")
    aggregates = [
        F.min(F.struct(behind, *standing)).alias("_leading"),
        # The first and last of the most frequent ratings differ only in a tie.
        F.min(F.struct(behind, value.alias("value"))).alias("_lowest"),
        F.max(F.struct(col("vote_count"), value.alias("value"))).alias("_highest"),
        F.sum("vote_count").alias("votes"),
    ]
    tied = ~col("_lowest").getField("value").eqNullSafe(col("_highest").getField("value"))
    if policy == "overall":
        aggregates.append(F.min(F.struct(*standing)).alias("_foremost"))

    # Without a tie there is one most frequent rating: its name and votes are known.
    breaking = col("_foremost" if policy == "overall" else "_leading")

    def chosen(field: str, untied: str = "_leading") -> Column:
        if policy != "overall":
            return breaking.getField(field)
        only = col(untied).getField(field)
        return F.when(col("tied"), breaking.getField(field)).otherwise(only)

    first = chosen("first") if reported else None
    shown = [first.getField(layout.role).alias(layout.role)] if reported else []
    broken = []
    if breaks:
        ranks = {"role_priority": no_role, "_value_priority": no_value}
        broken = [
            F.when(col("tied"), breaking.getField("senior").getField("deciding_role")).alias(
                "deciding_role"
            ),
            *[
                F.when(
                    col("tied") & (breaking.getField(name) < no_rank), breaking.getField(name)
                ).alias(name.lstrip("_"))
                for name, no_rank in ranks.items()
            ],
        ]
    return (
        ratings.groupBy(*_sorting_keys(layout))
        .agg(*aggregates)
        .withColumn("tied", tied)
        .select(
            *[col(k) for k in layout.keys],
            col("votes"),
            col("tied"),
            col("_highest").getField("vote_count").alias("max_votes"),
            *shown,
            chosen("value", "_highest").alias(layout.value),
            chosen("vote_count", "_highest").alias("vote_count"),
            *[_unpacked(votes, first, c) for c in carried],
            *broken,
        )
    )


def _packed(votes: DataFrame, name: str) -> Column:
    """A carried column as a field that can be compared: a map as sorted entries."""
    kind = votes.schema[name].dataType
    inner = kind.valueType if isinstance(kind, T.MapType) else kind
    if "map<" in inner.simpleString():
        raise ValueError(f"column {name} has a map inside, which cannot be carried")
    if isinstance(kind, T.MapType):
        return F.sort_array(F.map_entries(col(name))).alias(name)
    return col(name)


def _unpacked(votes: DataFrame, vote: Column, name: str) -> Column:
    """The carried column of a vote, as it was before :func:`_packed`."""
    field = vote.getField(name)
    if isinstance(votes.schema[name].dataType, T.MapType):
        field = F.map_from_entries(field)
    return field.alias(name)


def _sorting_keys(layout: VoteLayout) -> list[Column]:
    """The keys behind a hash of them, for aggregates that Spark must sort.

    ``min`` of a struct is a sort-based aggregate. With one 64-bit number in
    front, nearly every comparison is decided without reading the keys.
    """
    keys = [col(k) for k in layout.keys]
    return [F.xxhash64(*keys).alias("_group"), *keys]


def _slots(layout: VoteLayout) -> list[int]:
    """Rating ranks, and one more for the NULL rating."""
    return list(range(1, len(layout.value_levels) + 2))


def _carried(
    votes: DataFrame, layout: VoteLayout, carry: Sequence[str] | None
) -> list[str]:
    return layout.carried(votes.columns) if carry is None else list(carry)
