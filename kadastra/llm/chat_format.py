"""Chat formatting by a declarative template and a finite-state machine over roles.

``format_conversations(df)`` gives one row a conversation: its segments with loss flags, the text they
make, and whether the order of turns is one the machine accepts.  ``read_back(df)`` takes the formatted
text alone apart again.  Both use DataFrame functions only.

Control strings inside texts are broken up by an escape sign and restored when read back.  Rows are
ordered by turn, then role, then text, so ties and repeated rows have one result.

Defined cases: null text and null role are empty; a role the template does not know gets the generic
markers and makes the conversation invalid; null conv_id is a conversation of its own; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers of each role, roles under loss, and the machine's moves (state, role) -> state."""

    bos: str = "<s>"
    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("[SYS] ", " [/SYS]\n"),
            "user": ("[INST] ", " [/INST]\n"),
            "assistant": ("[ANS] ", "</s>\n"),
        }
    )
    other: tuple[str, str, str] = ("[ROLE:", "] ", " [/ROLE]\n")
    loss: tuple[str, ...] = ("assistant",)
    start: str = "begin"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "briefed",
            ("begin", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accept: tuple[str, ...] = ("answered",)
    escape: str = "␛"

    @property
    def controls(self) -> list[str]:
        marks = [self.bos, *self.other, *(m for pair in self.marks.values() for m in pair)]
        return sorted({m.strip() for m in marks if len(m.strip()) > 1})


DEFAULT = Template()


def escape(c: Column, t: Template = DEFAULT) -> Column:
    e = t.escape
    c = F.replace(c, F.lit(e), F.lit(e + "0"))
    for x in t.controls:
        c = F.replace(c, F.lit(x), F.lit(x[0] + e + "1" + x[1:]))
    return c


def unescape(c: Column, t: Template = DEFAULT) -> Column:
    return F.replace(F.replace(c, F.lit(t.escape + "1"), F.lit("")), F.lit(t.escape + "0"), F.lit(t.escape))


def _escape_role(c: Column, t: Template) -> Column:
    return F.replace(escape(c, t), F.lit("]"), F.lit(t.escape + "2"))


def _unescape_role(c: Column, t: Template) -> Column:
    return unescape(F.replace(c, F.lit(t.escape + "2"), F.lit("]")), t)


def _segments(turn: Column, t: Template) -> Column:
    """The three segments of a turn: marker, text, marker; only the text of a loss role is under loss."""
    role, a, b, c = turn["role"], F.lit(t.other[0]), F.lit(t.other[1]), F.lit(t.other[2])
    head, tail = F.concat(a, _escape_role(role, t), b), c
    for name, (left, right) in t.marks.items():
        head, tail = F.when(role == name, left).otherwise(head), F.when(role == name, right).otherwise(tail)

    def seg(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    return F.array(
        seg(head, F.lit(False)), seg(escape(turn["text"], t), role.isin(*t.loss)), seg(tail, F.lit(False))
    )


def format_conversations(df: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, segments array<struct<text, loss>>, formatted, valid, bad_turn (1 based, null if none)."""
    empty = F.lit("")
    turns = df.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
            )
        ).alias("turns")
    )
    moves = F.create_map(*(F.lit(x) for (s, r), to in t.moves.items() for x in (f"{s}\n{r}", to)))

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat_ws("\n", acc["state"], turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("bad")).alias("state"),
            (acc["n"] + 1).alias("n"),
            F.when(acc["bad"].isNull() & to.isNull(), acc["n"] + 1).otherwise(acc["bad"]).alias("bad"),
        )

    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    walked = turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat(
            F.array(F.struct(F.lit(t.bos).alias("text"), F.lit(False).alias("loss"))),
            F.flatten(F.transform("turns", lambda x: _segments(x, t))),
        ).alias("segments"),
        F.aggregate("turns", begin, step).alias("end"),
    )
    return walked.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("end.bad").isNull() & F.col("end.state").isin(*t.accept)).alias("valid"),
        F.col("end.bad").alias("bad_turn"),
    )


def read_back(formatted: Column, t: Template = DEFAULT) -> Column:
    """array<struct<role, text, loss>> from a formatted text alone."""
    opens = [left for left, _ in t.marks.values()] + [t.other[0]]
    pieces = F.filter(
        F.split(formatted, "(?=" + "|".join(re.escape(x.strip()) for x in opens) + ")"),
        lambda p: p != t.bos,
    )

    def turn(p: Column) -> Column:
        a, b, c = t.other
        end = F.instr(p, b)
        role = _unescape_role(F.substring(p, F.lit(len(a) + 1), end - 1 - len(a)), t)
        text = F.substring(p, end + len(b), F.length(p) - end - len(b) + 1 - len(c))
        for name, (left, right) in t.marks.items():
            here = F.startswith(p, F.lit(left))
            role = F.when(here, name).otherwise(role)
            text = F.when(
                here, F.substring(p, F.lit(len(left) + 1), F.length(p) - len(left) - len(right))
            ).otherwise(text)
        return F.struct(
            role.alias("role"), unescape(text, t).alias("text"), role.isin(*t.loss).alias("loss")
        )

    return F.transform(pieces, turn)
