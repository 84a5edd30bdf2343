"""Declared schemas, label lists and the layout of a vote table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

# Rating labels, best first.
VALUE_LEVELS = ("Evident", "Somewhat Evident", "Not Evident")

# Observer roles, most senior first (policy "ranked").
# A role outside the list counts as the last rank.
ROLE_LEVELS = (
    "el coach",
    "principal",
    "school coach",
    "asst principal",
    "district leader",
    "teacher",
    "el admin",
)

# Observer roles of the policies "contenders" and "overall".
# A role outside the list has no rank and sorts last.
STRICT_ROLE_LEVELS = (
    "el coach",
    "principal",
    "school coach",
    "asst principal",
    "district leader",
    "teacher",
    "other",
)

# Columns of the rating table, in report order.
VOTE_SCHEMA = T.StructType(
    [
        T.StructField("eventId", T.LongType()),
        T.StructField("classroomId", T.LongType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("participantRole", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("districtId", T.LongType()),
        T.StructField("schoolid", T.LongType()),
        T.StructField("schoolname", T.StringType()),
        T.StructField("eventname", T.StringType()),
        T.StructField("walkthroughid", T.LongType()),
        T.StructField("focusGroup", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("subtext", T.StringType()),
        T.StructField("participantId", T.LongType()),
    ]
)
VOTE_COLUMNS = tuple(VOTE_SCHEMA.names)

# CSV exports carry an unnamed row number before the vote columns.
CSV_SCHEMA = T.StructType([T.StructField("_c0", T.LongType()), *VOTE_SCHEMA.fields])

# The JSON text inside each observer form, and the form itself.
SECTIONS_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("focusGroup", T.StringType()),
            T.StructField(
                "fields",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("identifier", T.StringType()),
                            T.StructField("name", T.StringType()),
                            T.StructField("subtext", T.StringType()),
                            T.StructField("value", T.StringType()),
                            T.StructField(
                                "imageUpload",
                                T.StructType([T.StructField("show", T.BooleanType())]),
                            ),
                        ]
                    )
                ),
            ),
        ]
    )
)
PAYLOAD_COLUMN = "walkthroughdata"
FORM_SCHEMA = T.StructType(
    [
        T.StructField("eventId", T.LongType()),
        T.StructField("classroomId", T.LongType()),
        T.StructField("participantId", T.LongType()),
        T.StructField("participantRole", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("districtId", T.LongType()),
        T.StructField("schoolid", T.LongType()),
        T.StructField("schoolname", T.StringType()),
        T.StructField("eventname", T.StringType()),
        T.StructField("walkthroughid", T.LongType()),
        T.StructField(PAYLOAD_COLUMN, T.StringType()),
    ]
)


@dataclass(frozen=True)
class VoteLayout:
    """Which columns of a vote table play which part.

    ``order`` stands for the file order of the input: together with ``keys``
    it should identify a vote. Where it does not, equal votes are told apart
    by their remaining reported columns, so results stay repeatable.
    """

    keys: Sequence[str]
    value: str
    role: str
    order: Sequence[str]
    value_levels: Sequence[str] = VALUE_LEVELS
    role_levels: Sequence[str] = ROLE_LEVELS
    strict_role_levels: Sequence[str] = STRICT_ROLE_LEVELS

    def __post_init__(self) -> None:
        parts = [*self.keys, self.value, self.role]
        if len(set(parts)) != len(parts):
            raise ValueError(f"keys, value and role must be different columns: {parts}")
        if not self.keys or not self.order:
            raise ValueError("keys and order must name at least one column each")
        if set(self.order) & set(parts):
            raise ValueError("order columns must differ from keys, value and role")

    def carried(self, columns: Sequence[str]) -> list[str]:
        """Columns besides keys, role and value, order columns first."""
        taken = {*self.keys, self.value, self.role}
        rest = [c for c in columns if c not in taken and c not in self.order]
        return [*self.order, *rest]


# Layout of the 15-column rating table. A form has one field of each name.
FORM_LAYOUT = VoteLayout(
    keys=("eventId", "classroomId", "identifier"),
    value="value",
    role="participantRole",
    order=("walkthroughid", "participantId", "name"),
)
