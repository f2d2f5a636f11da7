"""Chat formatting with a finite-state machine over roles.

A template declares the control strings, the roles whose text is trained on
and the allowed role transitions. Texts and roles are escaped so that no
control string can be forged from inside, and every text can be read back.

Defined results: a NULL role or text is empty; a NULL conversation id is one
conversation of its own; turns are ordered by turn (NULL first), then role,
then text, so ties and repeated rows have one order; repeated rows are turns of
their own; an empty table gives no rows. A conversation that breaks the turn
order is formatted all the same, with ``valid`` false and the position of the
first bad turn. A conversation is one training text and therefore one row: its
turns meet in one task, after they were formatted where they were read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BAD = "start", "bad"


@dataclass(frozen=True)
class Template:
    """Control strings all begin with ``<|``; ``turns`` maps a state (the last
    role, or "start") to the roles that may follow."""

    open: str = "<|im_start|>"
    after_role: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    turns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )


CHATML = Template()


def escape(c: Column) -> Column:
    """``<|`` becomes ``<\\|``; a backslash more where some stand already."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", "<$1|")


def _validate(roles: Column, template: Template) -> Column:
    """Position of the first turn the machine refuses, or NULL."""
    allowed = F.array(*[F.lit(f"{a}\n{b}") for a, after in template.turns.items() for b in after])
    begin = F.struct(F.lit(START).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        fits = F.array_contains(allowed, F.concat(acc["state"], F.lit("\n"), role))
        return F.struct(
            F.when(fits, role).otherwise(F.lit(BAD)).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc["bad"], F.when(~fits, acc["at"])).alias("bad"),
        )

    return F.aggregate(roles, begin, step, lambda acc: acc["bad"])


def format_chats(
    rows: DataFrame,
    template: Template = CHATML,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: its id, ``segments`` (array of text and loss
    flag, in order; joined they are the training text), ``formatted``,
    ``valid`` and ``first_bad_turn`` (position from 0)."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    loss = who.isin(*template.loss_roles)
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            who.alias("role"),
            what.alias("raw"),
            F.array(
                F.struct(
                    F.concat(F.lit(template.open), escape(who), F.lit(template.after_role)).alias("text"),
                    F.lit(False).alias("loss"),
                ),
                F.struct(escape(what).alias("text"), loss.alias("loss")),
                F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
            ).alias("parts"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    segments = F.flatten(F.transform("t", lambda x: x["parts"]))
    shaped = grouped.select(
        "conv_id",
        segments.alias("segments"),
        _validate(F.transform("t", lambda x: x["role"]), template).alias("first_bad_turn"),
    )
    return shaped.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("first_bad_turn").isNull().alias("valid"),
        "first_bad_turn",
    )


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """Array of (role, text) parsed from a formatted conversation."""
    quote = lambda s: "\\Q" + s + "\\E"
    pieces = F.split(formatted, quote(template.close), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parse(piece: Column) -> Column:
        halves = F.split(F.substr(piece, F.lit(len(template.open) + 1)), quote(template.after_role), 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(pieces, parse)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, joined in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
