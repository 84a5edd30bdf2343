"""Hand-made votes and a plain Python statement of the scoring rules."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import types as T

from plurality.schema import ROLE_LEVELS, STRICT_ROLE_LEVELS, VALUE_LEVELS, VoteLayout

E, S, N = VALUE_LEVELS

LAYOUT = VoteLayout(
    keys=("eventId", "classroomId", "identifier"),
    value="value",
    role="participantRole",
    order=("row",),
)

SCHEMA = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("eventId", T.LongType()),
        T.StructField("classroomId", T.LongType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("participantRole", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

# Five groups, four of them tied.
EDGE = [
    (1, 10413, 56480, "2A", "school coach", S),
    (2, 10413, 56480, "2A", "school coach", N),
    (3, 10413, 56480, "2A", "school coach", N),
    (4, 10413, 56480, "2A", "asst principal", N),
    (5, 10413, 56480, "2A", "teacher", S),
    (6, 10413, 56480, "2A", "teacher", S),
    (7, 10413, 56480, "2A", "el coach", E),
    (8, 9952, 46733, "1B", "el coach", S),
    (9, 9952, 46733, "1B", "district leader", E),
    (10, 12230, 55343, "2G", "el coach", E),
    (11, 12230, 55343, "2G", "el coach", S),
    (12, 10425, 55343, "6F", "el coach", S),
    (13, 15432, 48722, "4D", "el coach", E),
    (14, 15432, 48722, "4D", "district leader", S),
    (15, 15432, 48722, "4D", "teacher", S),
    (16, 15432, 48722, "4D", "school coach", N),
    (17, 15432, 48722, "4D", "school coach", N),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def group(*votes):
    """Votes ``(role, value)`` of one group, in file order."""
    return [(i, 1, 1, "1A", role, value) for i, (role, value) in enumerate(votes, 1)]


def random_votes(seed, size, groups=12):
    chance = random.Random(seed)
    roles = [*ROLE_LEVELS, "other", "visitor", None]
    values = [*VALUE_LEVELS, "", None, "Maybe", "evident"]
    keys = [
        (chance.choice([1, 2, None]), chance.choice([10, 20]), chance.choice(["A", "b", None]))
        for _ in range(groups)
    ]
    return [
        (row, *chance.choice(keys), chance.choice(roles), chance.choice(values))
        for row in range(1, size + 1)
    ]


def score(rows, policy):
    """key -> (role, value, vote_count, row), straight from the rules."""
    groups = defaultdict(list)
    for row, event, classroom, identifier, role, value in rows:
        if value in ("", None):
            continue
        if policy == "ranked":
            role = role if role in ROLE_LEVELS else None
            value = value if value in VALUE_LEVELS else None
        groups[event, classroom, identifier].append((row, role, value))
    return {key: _score_group(sorted(votes), policy) for key, votes in groups.items()}


def _score_group(votes, policy):
    counts = Counter(value for _, _, value in votes)
    top = [v for v in counts if counts[v] == max(counts.values())]
    contenders = [v for v in votes if v[2] in top]
    if policy == "ranked":
        row, role, value = min(contenders, key=_seniority)
        return role, value, counts[value], row
    if policy == "overall" and len(top) > 1:
        contenders = votes
    value = min(contenders, key=_strict_seniority)[2]
    row, role, _ = next(v for v in votes if v[2] == value)
    return role, value, counts[value], row


def _seniority(vote):
    row, role, value = vote
    rank = ROLE_LEVELS.index(role) if role in ROLE_LEVELS else 7
    return min(rank, 6), _place(VALUE_LEVELS, value), rank, row


def _strict_seniority(vote):
    row, role, value = vote
    return _place(STRICT_ROLE_LEVELS, role), _place(VALUE_LEVELS, value), row


def _place(levels, label):
    return levels.index(label) if label in levels else len(levels)
