"""Chat formatting: a state machine checks turn order, a template emits segments.

A :class:`Template` declares the control strings around a turn, which roles bear
loss, and which role may follow which state. One fold over a conversation's turns
runs the machine; every turn becomes three segments of text (opening, content,
closing), each flagged for loss. Control strings inside roles and texts are
escaped, so the formatted text splits back into the same turns. All of it is SQL
functions; a conversation is one row, as its digest needs it whole.

Results for odd input: a NULL role or text counts as empty; an unknown role is
formatted, bears no loss and makes the conversation invalid; turns with equal or
NULL numbers come in order of number (NULL first), role, text; repeated rows are
repeated turns; rows with a NULL id form one conversation; very long texts
are escaped and written whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import col

START, INVALID = "start", "invalid"


@dataclass(frozen=True)
class Template:
    """Control strings, loss flags and turn order.

    A control string starts with the same character, found nowhere else in it,
    and holds no escape character: then none can straddle a boundary, and one
    escape character behind its first character hides it.
    """

    open: str = "<turn>"
    says: str = "<says>"
    close: str = "</turn>"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if len(self.escape) != 1:
            raise ValueError("the escape must be one character")
        first = {c[:1] for c in self.controls}
        for c in self.controls:
            if len(c) < 2 or len(first) != 1 or c[0] in c[1:] or self.escape in c:
                raise ValueError(f"unusable control string {c!r}")

    @property
    def controls(self) -> tuple[str, str, str]:
        return self.open, self.says, self.close

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        for c in self.controls:
            text = F.replace(text, F.lit(c), F.lit(c[0] + self.escape + c[1:]))
        return text

    def unescaped(self, text: Column) -> Column:
        """Drop every escape character and keep the character behind it."""
        return F.regexp_replace(text, rf"(?s)\Q{self.escape}\E(.)", "$1")

    def next_state(self, state: Column, role: Column) -> Column:
        """The machine's transition; ``invalid`` is never left."""
        to = F.lit(INVALID)
        for source, roles in self.order.items():
            to = F.when((state == source) & role.isin(*roles), role).otherwise(to)
        return to


def format_chats(
    turns: DataFrame,
    template: Template = Template(),
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``segments`` (text, loss), ``formatted``, ``valid``."""
    one = F.struct(
        col(turn).alias("turn"),
        F.coalesce(col(role), F.lit("")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"),
    )
    chats = turns.groupBy(col(conv_id).alias("conv_id")).agg(
        F.array_sort(F.collect_list(one)).alias("turns")
    )
    last = F.aggregate("turns", F.lit(START), lambda s, t: template.next_state(s, t["role"]))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def emitted(t: Column) -> Column:
        head = F.concat(
            F.lit(template.open), template.escaped(t["role"]), F.lit(template.says)
        )
        return F.array(
            segment(head, F.lit(False)),
            segment(template.escaped(t["text"]), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.close), F.lit(False)),
        )

    chats = chats.select(
        "conv_id",
        last.isin(*template.final).alias("valid"),
        F.flatten(F.transform("turns", emitted)).alias("segments"),
    )
    formatted = F.concat_ws("", F.transform("segments", lambda s: s["text"]))
    return chats.withColumn("formatted", formatted)


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text holds."""
    closed = F.split(formatted, rf"\Q{template.close}\E")
    whole = F.slice(closed, 1, F.size(closed) - 1)
    skip = len(template.open)

    def parsed(t: Column) -> Column:
        body = F.substr(t, F.lit(skip + 1))
        at = F.locate(template.says, body)
        role = F.substr(body, F.lit(1), at - 1)
        content = F.substr(body, at + len(template.says))
        return F.struct(
            template.unescaped(role).alias("role"),
            template.unescaped(content).alias("text"),
        )

    return F.transform(whole, parsed)


def loss_texts(segments: Column, template: Template = Template()) -> Column:
    """The original texts under the loss mask, in order."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.transform(masked, lambda s: template.unescaped(s["text"]))


def digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns and loss text of formatted chats, read back and hashed."""
    read = chats.select(
        "conv_id",
        "valid",
        read_turns(F.col("formatted"), template).alias("turns"),
        F.concat_ws("", loss_texts(F.col("segments"), template)).alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
