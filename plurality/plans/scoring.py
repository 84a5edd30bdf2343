"""Scoring the 15-column rating table from end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import types as T

from plurality.operators.audit import Audit, audit_ties
from plurality.operators.consensus import POLICIES, consensus, decide, decide_raw
from plurality.operators.indexing import number_rows
from plurality.operators.nested import flatten_forms
from plurality.operators.relational import move_to_front, project
from plurality.operators.reports import summary_of, summary_totals
from plurality.operators.tally import tied_groups, tied_values
from plurality.schema import (
    FORM_LAYOUT,
    PAYLOAD_COLUMN,
    SECTIONS_SCHEMA,
    VOTE_COLUMNS,
    VoteLayout,
)
from plurality.session import drop_shuffles, materialise
from plurality.sources.files import publish


def score_votes(
    votes: DataFrame,
    policy: str = "ranked",
    order: Sequence[str] | None = None,
    numbered: bool = True,
) -> DataFrame:
    """One row per (event, classroom, indicator): the agreed rating.

    Columns: ``group_index`` (if ``numbered``) and the rating table's columns
    without ``participantId``. ``order`` replaces the columns that stand for
    the file order. Numbering reads the ratings several times, so they are written
    first: the votes, and the texts they may come from, are read once.
    """
    layout = _layout(order)
    table = project(votes, [*VOTE_COLUMNS, *layout.order])
    scored = project(consensus(table, layout, policy, _attributes(layout)), _REPORTED)
    if not numbered:
        return scored
    with drop_shuffles(votes.sparkSession):
        scored = materialise(scored, "scored")
    return move_to_front(number_rows(scored, layout.keys, "group_index"), "group_index")


def score_forms(
    forms: DataFrame,
    policy: str = "ranked",
    payload: str = PAYLOAD_COLUMN,
    sections: T.ArrayType = SECTIONS_SCHEMA,
    numbered: bool = True,
) -> DataFrame:
    """:func:`score_votes` for observer forms that hold their fields as JSON text."""
    return score_votes(flatten_forms(forms, payload, sections), policy, numbered=numbered)


class Scoring(NamedTuple):
    """A scoring run: the ratings, its one-row summary, and the audit if asked for."""

    clean: DataFrame
    summary: DataFrame
    audit: Audit | None


def score_and_publish(
    votes: DataFrame,
    name: str,
    check: bool = True,
    seed: int = 2024,
    n: int = 5,
    policy: str = "ranked",
    order: Sequence[str] | None = None,
) -> Scoring:
    """Score the rating table, publish it as view ``name``, and audit ``n`` ties.

    The votes are tallied once, into a table of one row per group, from which ratings
    and tied groups are read; the summary is observed as that table is written. The audit goes back to the votes for
    the pool it samples and for its listing. The view exists before the audit runs,
    also when the audit refuses ``n``.
    """
    layout = _layout(order)
    table = project(votes, [*VOTE_COLUMNS, *layout.order])
    attributes = _attributes(layout)
    if policy == "ranked":
        decided = decide(table, layout, attributes, counts=True)
    elif policy in POLICIES:
        decided = decide_raw(table, layout, policy, attributes)
    else:
        raise ValueError(f"unknown policy {policy!r}; choose one of {POLICIES}")
    # The summary's numbers are taken as the decisions are written.
    totals = Observation()
    decided = materialise(decided.observe(totals, *summary_totals()), "decided")
    scored = number_rows(project(decided, _REPORTED), layout.keys, "group_index")
    clean = publish(move_to_front(scored, "group_index"), name)
    summary = summary_of(votes.sparkSession, totals.get, layout)
    audit = None
    if check:
        ranked = policy == "ranked"
        tied = (tied_values if ranked else tied_groups)(votes, layout, decided)
        audit = audit_ties(votes, layout, n, seed, clean, policy, tied)
    return Scoring(clean, summary, audit)


_REPORTED = [c for c in VOTE_COLUMNS if c != "participantId"]


def _attributes(layout: VoteLayout) -> list[str]:
    """The reported columns that are neither key nor role nor rating."""
    return [c for c in _REPORTED if c not in (*layout.keys, layout.role, layout.value)]


def _layout(order: Sequence[str] | None) -> VoteLayout:
    return FORM_LAYOUT if order is None else replace(FORM_LAYOUT, order=tuple(order))
