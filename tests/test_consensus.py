import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plurality import (
    FORM_LAYOUT,
    POLICIES,
    VoteLayout,
    consensus,
    decide,
    score_and_publish,
    score_summary,
    score_votes,
)
from plurality.operators import tally
from votes import EDGE, LAYOUT, E, N, S, frame, group, random_votes, score


def scored(df, policy, layout=LAYOUT):
    return {
        (r.eventId, r.classroomId, r.identifier): (
            r.participantRole,
            r.value,
            r.vote_count,
            r.row,
        )
        for r in consensus(df, layout, policy).collect()
    }


EDGE_ANSWERS = {
    "ranked": [(S, "el coach", 8), (S, "school coach", 1), (S, "el coach", 12),
               (E, "el coach", 10), (N, "school coach", 16)],
    "contenders": [(S, "el coach", 8), (S, "school coach", 1), (S, "el coach", 12),
                   (E, "el coach", 10), (N, "school coach", 16)],
    "overall": [(S, "el coach", 8), (E, "el coach", 7), (S, "el coach", 12),
                (E, "el coach", 10), (E, "el coach", 13)],
}


@pytest.mark.parametrize("policy", POLICIES)
def test_edge_cases(spark, policy):
    rows = consensus(frame(spark, EDGE), LAYOUT, policy).orderBy(*LAYOUT.keys).collect()
    assert [(r.value, r.participantRole, r.row) for r in rows] == EDGE_ANSWERS[policy]


UNLISTED = [
    (group(("other", "Maybe"), ("teacher", "Maybe"), ("el coach", E)),
     (None, "teacher"), ("Maybe", "other")),
    (group(("other", N), ("el admin", E)), (E, "el admin"), (N, "other")),
    (group(("other", E), ("el admin", E)), (E, "el admin"), (E, "other")),
    (group(("teacher", "")), None, None),
    (group(("teacher", None)), None, None),
]


@pytest.mark.parametrize("rows, ranked, raw", UNLISTED)
def test_unlisted_labels(spark, rows, ranked, raw):
    for policy, expected in (("ranked", ranked), ("contenders", raw), ("overall", raw)):
        found = consensus(frame(spark, rows), LAYOUT, policy).collect()
        answers = [(r.value, r.participantRole) for r in found]
        assert answers == ([] if expected is None else [expected])


@pytest.mark.parametrize("policy", POLICIES)
@pytest.mark.parametrize("seed", range(4))
def test_random_votes_match_the_rules(spark, policy, seed):
    rows = random_votes(seed, size=150)
    df = frame(spark, rows)
    expected = score(rows, policy)
    assert scored(df, policy) == expected
    shuffled = frame(spark, random.Random(seed).sample(rows, len(rows))).repartition(5)
    assert scored(shuffled, policy) == expected


@pytest.mark.parametrize("policy", POLICIES)
def test_one_group_with_a_third_of_the_votes(spark, policy):
    rows = [v for seed in range(3) for v in random_votes(seed, size=200, groups=30)]
    rows += [(0, 7, 7, "hot", *v[4:]) for v in random_votes(99, size=300)]
    rows = [(i, *v[1:]) for i, v in enumerate(rows, 1)]
    assert scored(frame(spark, rows).repartition(6), policy) == score(rows, policy)


@pytest.mark.parametrize("policy", POLICIES)
def test_winning_rating_is_most_frequent_unless_overall(spark, policy):
    rows = random_votes(5, size=400)
    df = frame(spark, rows)
    best = {k: v[2] for k, v in score(rows, "contenders" if policy != "ranked" else policy).items()}
    counts = {k: v[2] for k, v in scored(df, policy).items()}
    assert counts.keys() == best.keys()
    if policy != "overall":
        assert counts == best


def test_null_order_comes_last(spark):
    rows = [(None, 1, 1, "1A", "teacher", E), (5, 1, 1, "1A", "teacher", E)]
    for policy in POLICIES:
        assert consensus(frame(spark, rows), LAYOUT, policy).first().row == 5


def test_equal_order_is_still_repeatable(spark):
    df = frame(spark, [(1, 1, 1, "1A", "teacher", E)])
    df = df.withColumn("extra", F.explode(F.array(*map(F.lit, (2, 0, 1)))))
    for policy in POLICIES:
        assert consensus(df, LAYOUT, policy).first().extra == 0


def test_carry_limits_the_columns(spark):
    result = consensus(frame(spark, EDGE), LAYOUT, carry=())
    assert result.columns == [*LAYOUT.keys, "participantRole", "value", "vote_count"]
    full = consensus(frame(spark, EDGE), LAYOUT).drop("row")
    assert sorted(result.collect(), key=str) == sorted(full.collect(), key=str)


def test_other_level_lists(spark):
    layout = VoteLayout(
        keys=("g",), value="v", role="r", order=("i",),
        value_levels=("good", "bad"), role_levels=("boss", "staff"),
        strict_role_levels=("boss",),
    )
    df = spark.createDataFrame(
        [("a", "bad", "boss", 1), ("a", "good", "staff", 2), ("b", "good", "staff", 3),
         ("b", "bad", "guest", 4)],
        "g string, v string, r string, i int",
    )
    answers = {r.g: (r.v, r.r) for r in consensus(df, layout).collect()}
    assert answers == {"a": ("bad", "boss"), "b": ("good", "staff")}


def test_bad_arguments(spark):
    with pytest.raises(ValueError, match="policy"):
        consensus(frame(spark, EDGE), LAYOUT, "loudest")
    with pytest.raises(ValueError, match="different"):
        VoteLayout(keys=("a",), value="a", role="b", order=("c",))
    with pytest.raises(ValueError, match="order"):
        VoteLayout(keys=("a",), value="v", role="b", order=())
    with pytest.raises(ValueError, match="order"):
        VoteLayout(keys=("a",), value="v", role="b", order=("a",))


def test_ties_and_clear_groups_are_all_groups(spark):
    df = frame(spark, random_votes(11, size=300))
    decided = decide(df, LAYOUT)
    tied = tally.tied_values(df, LAYOUT).select(*LAYOUT.keys).distinct().count()
    clear = tally.clear_values(df, LAYOUT).count()
    assert decided.filter("tied").count() == tied
    assert decided.count() == tied + clear


def test_summary(spark):
    row = score_summary(frame(spark, EDGE), LAYOUT).first()
    assert (row.votes, row.groups, row.ties, row.clear) == (17, 5, 4, 1)
    assert row.groups_message == (
        "The data has 5 entries when grouped by eventId, classroomId, and identifier."
    )
    assert row.ties_message == "The data had  4 ties."


def test_summary_of_nothing(spark):
    row = score_summary(frame(spark, []), LAYOUT).first()
    assert (row.votes, row.groups, row.ties, row.clear) == (0, 0, 0, 0)


def full_table(spark, rows):
    """The 15 rating columns; the other ones repeat the row number."""
    df = frame(spark, rows)
    for name, kind in (
        ("status", "string"), ("districtId", "long"), ("schoolid", "long"),
        ("schoolname", "string"), ("eventname", "string"), ("walkthroughid", "long"),
        ("focusGroup", "string"), ("name", "string"), ("subtext", "string"),
        ("participantId", "long"),
    ):
        df = df.withColumn(name, F.col("row").cast(kind))
    return df


def test_score_votes_reports_the_full_table(spark):
    df = full_table(spark, EDGE)
    result = score_votes(df, order=["row"])
    assert result.columns == [
        "group_index", "eventId", "classroomId", "identifier", "participantRole", "value",
        "status", "districtId", "schoolid", "schoolname", "eventname", "walkthroughid",
        "focusGroup", "name", "subtext",
    ]
    rows = result.orderBy("group_index").collect()
    assert [(r.group_index, r.value, r.schoolid) for r in rows] == [
        (i, value, row) for i, (value, _, row) in enumerate(EDGE_ANSWERS["ranked"], 1)
    ]
    plain = score_votes(df, "overall", order=["row"], numbered=False)
    assert "group_index" not in plain.columns
    assert {(r.eventId, r.value) for r in plain.collect()} == {
        (9952, S), (10413, E), (10425, S), (12230, E), (15432, E)
    }


@pytest.mark.parametrize("policy", POLICIES)
def test_score_and_publish(spark, policy):
    df = full_table(spark, EDGE)
    run = score_and_publish(df, "clean_edge", n=4, policy=policy, order=["row"])
    clean = spark.table("clean_edge").orderBy("group_index").collect()
    assert [(r.value, r.participantRole, r.schoolid) for r in clean] == EDGE_ANSWERS[policy]
    assert run.summary.first().ties == 4 and run.audit.sample.count() == 4
    with pytest.raises(ValueError, match="has 4"):
        score_and_publish(df.filter("row < 100"), "clean_again", n=9, order=["row"])
    assert spark.table("clean_again").count() == 5
    unchecked = score_and_publish(df, "clean_edge", check=False, n=9, order=["row"])
    assert unchecked.audit is None


def test_model_agrees_with_the_edge_answers():
    for policy in POLICIES:
        answers = score(EDGE, policy)
        found = [answers[k] for k in sorted(answers)]
        assert [(v, r, row) for r, v, _, row in found] == EDGE_ANSWERS[policy]


@pytest.mark.parametrize("policy", POLICIES)
def test_maps_are_carried(spark, policy):
    df = frame(spark, EDGE).withColumn("notes", F.create_map(F.lit("row"), F.col("row")))
    for r in consensus(df, LAYOUT, policy).collect():
        assert r.notes == {"row": r.row}
    inside = df.withColumn("notes", F.struct("notes"))
    with pytest.raises(ValueError, match="notes has a map inside"):
        consensus(inside, LAYOUT, policy)


@pytest.mark.parametrize("policy", POLICIES)
def test_published_ratings_are_those_of_scoring(spark, policy):
    rows = random_votes(11, 300)
    df = full_table(spark, rows)
    run = score_and_publish(df, "clean_random", n=1, policy=policy, order=["row"])
    alone = score_votes(df, policy, order=["row"])
    assert sorted(run.clean.collect(), key=str) == sorted(alone.collect(), key=str)
    given = score_summary(df, replace(FORM_LAYOUT, order=("row",)), policy)
    assert run.summary.collect() == given.collect()
