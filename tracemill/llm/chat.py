"""Chat formatting with DataFrame functions only.

A template declares the marks around turns, the roles under the loss mask and a
finite-state machine over roles. Each turn becomes segments (header, body, end),
each with a loss flag; control strings inside texts are broken by a backslash,
reversibly, so a formatted conversation can be cut at its marks and read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks, loss roles and transitions; a conversation is valid if it walks from ``start`` to one of ``accept``."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    #: strings beside the marks that no text may hold unescaped
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
            ("assistant", "tool"): "tool",
            ("tool", "assistant"): "assistant",
        }
    )

    @property
    def body_end(self) -> str:
        return self.end + "\n"


REJECT = "reject"


def escape(text: Column, template: ChatTemplate) -> Column:
    """Doubles backslashes, then puts one after the first character of each control string."""
    tails: dict[str, list[str]] = {}
    for s in (template.begin, template.end, *template.control):
        tails.setdefault(s[0], []).append(re.escape(s[1:]))
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for head, rest in tails.items():
        text = F.regexp_replace(text, f"({re.escape(head)})(?=(?:{'|'.join(rest)}))", r"$1\\")
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def final_state(roles: Column, template: ChatTemplate) -> Column:
    """The machine's state after all roles; ``reject`` is kept once reached."""

    def move(state: Column, role: Column) -> Column:
        out = F.lit(REJECT)
        for (at, r), to in template.transitions.items():
            out = F.when((state == at) & (role == r), F.lit(to)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(template.start), move)


def turn_segments(turn: Column, template: ChatTemplate) -> Column:
    """array<struct<text, loss>> of one turn (struct with role and text): header, body, end."""
    role = F.replace(escape(turn["role"], template), F.lit("\n"), F.lit("\\\n"))
    return F.array(
        F.struct(F.concat(F.lit(template.begin), role, F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(turn["text"], template).alias("text"), turn["role"].isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.body_end).alias("text"), F.lit(False).alias("loss")),
    )


def format_chats(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, valid (the machine accepts it), segments (array<struct<text, loss>>), formatted.

    Null texts and roles count as empty; a null role is accepted by no
    transition. Turns are ordered by number, ties (repeated rows too, which are
    all kept) by role, then text; null turn numbers come first. Rows with a null
    conversation form one conversation of their own. Invalid conversations are
    formatted too. No rows give no conversations. Other columns are ignored. A
    conversation is one result row, so it must fit one (2 GB).
    """
    template = template or ChatTemplate()
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    talks = talks.select(
        "conv_id",
        final_state(F.transform("turns", lambda t: t["role"]), template).isin(*template.accept).alias("valid"),
        F.flatten(F.transform("turns", lambda t: turn_segments(t, template))).alias("segments"),
    )
    return talks.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """array<struct<role, text>> of a formatted conversation; marks cannot occur inside escaped texts, so the cuts are exact."""
    template = template or ChatTemplate()
    chunks = F.filter(F.split(formatted, re.escape(template.body_end)), lambda c: c.startswith(template.begin))
    header = re.escape(template.begin) + r"((?:[^\\\n]|\\.)*)\n"

    def turn(chunk: Column) -> Column:
        role = F.regexp_extract(chunk, "(?s)^" + header, 1)
        text = F.substring(chunk, F.length(role) + len(template.begin) + 2, F.length(chunk))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(chunks, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
