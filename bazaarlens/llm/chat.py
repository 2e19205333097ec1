"""Chat formatting: a role machine checks the turn order, a template gives text segments with loss flags.

Everything is a DataFrame expression. A conversation is one row of the output, so
it has to fit in one task; that is what a formatted training example is.

Defined results: null text and null role count as empty strings; a role without a
template of its own is written with its name; rows of one turn number are ordered
by role, then text; a null turn comes first; repeated rows are turns of their own;
rows with a null conv_id form one conversation; no rows give no conversations.
Columns other than the four used are ignored. A conversation is valid if every turn is
in order and the last one leaves the machine in an accepting state.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Text around each turn, roles that carry loss, and the allowed role order.

    ``turns`` maps a role to what opens and closes its text; any other role is
    written as ``other[0] + role + other[1] + text + other[2]``. Every turn ends
    with ``end``. A template that could not be read back raises ValueError.
    """

    end: str = "</s>"
    turns: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<s>[SYS] ", " [/SYS]</s>"),
            "user": ("<s>[INST] ", " [/INST]</s>"),
            "assistant": ("<s>[ANS] ", "</s>"),
        }
    )
    other: tuple[str, str, str] = ("<s>[ROLE] ", " [TEXT] ", "</s>")
    loss_roles: tuple[str, ...] = ("assistant",)
    # (state, role) -> next state; anything else is an error that stays one.
    order: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        markers = [self.end, *self.other, *[m for pair in self.turns.values() for m in pair]]
        openings = [self.other[0], *[start for start, _ in self.turns.values()]]
        broken = [m for m in markers if ESCAPE in m]
        broken += [m for m in (self.other[2], *[stop for _, stop in self.turns.values()]) if not m.endswith(self.end)]
        broken += [a for i, a in enumerate(openings) for j, b in enumerate(openings) if i != j and b.startswith(a)]
        # What ends a turn or a role has to hold a control string, which no escaped text holds, and may not
        # overlap itself: then it is found where it was written.
        for m in (self.end, self.other[1]):
            if not _control_strings(m) or any(c[:k] == c[-k:] for c in _control_strings(m) for k in range(1, len(c))):
                broken.append(m)
        if broken:
            raise ValueError(f"markers {broken} cannot be told from texts")

    @property
    def control(self) -> tuple[str, ...]:
        """The strings that may appear only as markers, the longest first: bracketed names, or a marker without one as a whole."""
        markers = [self.end, *self.other, *[m for pair in self.turns.values() for m in pair]]
        return tuple(sorted({c for m in markers for c in _control_strings(m)}, key=lambda c: (-len(c), c)))


def _control_strings(marker: str) -> list[str]:
    named = re.findall(r"<[^<>\s]+>|\[[^\[\]\s]+\]", marker)
    return named or [x for x in [marker.strip()] if len(x) > 1]


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """Doubles backslashes and breaks every control string by a backslash after its first character."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for marker in template.control:
        out = F.replace(out, F.lit(marker), F.lit(marker[0] + ESCAPE + marker[1:]))
    return out


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: one scan that drops a lone backslash and halves a pair."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _around(role: Column, template: Template) -> tuple[Column, Column]:
    """What opens and closes a turn of ``role``."""
    head, middle, tail = template.other
    opened, closed = F.concat(F.lit(head), escape(role, template), F.lit(middle)), F.lit(tail)
    for name, (start, stop) in template.turns.items():
        opened = F.when(role == name, F.lit(start)).otherwise(opened)
        closed = F.when(role == name, F.lit(stop)).otherwise(closed)
    return opened, closed


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: ``segments`` (text, loss), ``formatted``, ``valid`` and ``error_turn``.

    ``error_turn`` is the position, from 0, of the first turn out of order, or the number of turns where
    one more is wanted, else null.
    """
    turns = rows.select(
        "conv_id",
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    opened, closed = _around(F.col("role"), template)
    turns = turns.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "text",
            F.array(
                F.struct(opened.alias("text"), F.lit(False).alias("loss")),
                F.struct(
                    escape(F.col("text"), template).alias("text"),
                    F.col("role").isin(*template.loss_roles).alias("loss"),
                ),
                F.struct(closed.alias("text"), F.lit(False).alias("loss")),
            ).alias("segments"),
        ).alias("t"),
    )
    conversations = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    table = F.create_map(*[F.lit(x) for (state, role), after in template.order.items() for x in (f"{state}>{role}", after)])

    def step(seen: Column, turn: Column) -> Column:
        after = F.coalesce(F.try_element_at(table, F.concat(seen["state"], F.lit(">"), turn["role"])), F.lit("error"))
        failed = (after == "error") & seen["error_turn"].isNull()
        return F.struct(
            after.alias("state"),
            (seen["at"] + 1).alias("at"),
            F.when(failed, seen["at"]).otherwise(seen["error_turn"]).alias("error_turn"),
        )

    start = F.struct(
        F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error_turn")
    )
    machine = F.aggregate("turns", start, step)
    segments = F.flatten(F.transform("turns", lambda t: t["segments"]))
    ended = conversations.select("conv_id", segments.alias("segments"), machine.alias("m"))
    unfinished = F.when(~F.col("m.state").isin(*template.accepting), F.col("m.at"))
    return ended.select("conv_id", "segments", F.coalesce("m.error_turn", unfinished).alias("error_turn")).select(
        "conv_id",
        "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        F.col("error_turn").isNull().alias("valid"),
        "error_turn",
    )


def parse_formatted(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) that a formatted conversation holds, unescaped."""
    chunks = F.split(formatted, rf"\Q{template.end}\E")
    chunks = F.slice(chunks, 1, F.size(chunks) - 1)
    head, middle, tail = template.other

    def turn(chunk: Column) -> Column:
        at = F.locate(middle, chunk)
        role = F.substring(chunk, F.lit(len(head) + 1), at - len(head) - 1)
        text = F.substring(chunk, at + len(middle), F.length(chunk) - at - len(middle) + 1 - (len(tail) - len(template.end)))
        for name, (start, stop) in template.turns.items():
            own = F.startswith(chunk, F.lit(start))
            inner = F.length(chunk) - len(start) - (len(stop) - len(template.end))
            role = F.when(own, F.lit(name)).otherwise(role)
            text = F.when(own, F.substring(chunk, F.lit(len(start) + 1), inner)).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(chunks, turn)


def loss_text(segments: Column) -> Column:
    """The unescaped text of all segments under the loss mask."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.concat_ws("", F.transform(kept, lambda s: unescape(s["text"])))
