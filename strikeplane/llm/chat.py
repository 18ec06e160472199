"""Chat formatting: a finite-state machine over roles and a declarative template, by DataFrame functions alone.

The machine reads a conversation's roles in order and says whether they may follow each other. The template
says what stands before and after a turn, and which parts are under the loss. Texts may hold the template's own
control strings: each such string gets a backslash in front (one more than it has), and loses one when read
back. A control string of the template itself never has one in front, as each starts after a line break.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns look. Roles without a header of their own are written by their name, percent-encoded."""

    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other_header: str = "### @{role}: "
    footer: str = "\n</turn>\n"
    #: Strings that a text must not hold as they are.
    control: tuple[str, ...] = ("###", "</turn>")
    #: Roles whose text is under the loss; headers and footers never are.
    learned: tuple[str, ...] = ("assistant",)


#: What may follow what. A conversation starts in "start" and may end in any state but it.
TRANSITIONS = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}


def _any_of(strings: tuple[str, ...]) -> str:
    """A pattern for any of the strings, every character of which is taken literally."""
    return "|".join("".join(c if c.isalnum() else "\\" + c for c in s) for s in strings)


def escape(text: Column, template: Template) -> Column:
    # a match starts where no backslash is before it and gives none back: a long run of them is read once
    return F.regexp_replace(text, rf"(?<!\\)(\\*+(?:{_any_of(template.control)}))", r"\\$1")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+(?:{_any_of(template.control)}))", "$1")


def first_fault(roles: Column, transitions: dict[tuple[str, str], str] | None = None) -> Column:
    """Place (from 0) of the first role that the machine doesn't take, -1 if it takes all, null for no roles."""
    steps = TRANSITIONS if transitions is None else transitions
    table = F.create_map(*(F.lit(x) for (state, role), to in steps.items() for x in (f"{state}\x00{role}", to)))
    start = F.struct(F.lit("start").alias("state"), F.lit(-1).alias("fault"), F.lit(0).alias("at"))

    def step(s: Column, role: Column) -> Column:
        to = F.element_at(table, F.concat(s["state"], F.lit("\x00"), role))
        return F.struct(
            F.coalesce(to, F.lit("fault")).alias("state"),
            F.when((s["fault"] < 0) & to.isNull(), s["at"]).otherwise(s["fault"]).alias("fault"),
            (s["at"] + 1).alias("at"),
        )

    return F.when(F.size(roles) > 0, F.aggregate(roles, start, step, lambda s: s["fault"]))


def format_chats(rows: DataFrame, template: Template = Template(), transitions: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """(conv_id, n_turns, valid, first_fault, segments, formatted) from rows of (conv_id, turn, role, text).

    segments is an array of struct(text, loss): header, text and footer of every turn in order; formatted joins
    them. Rows go by turn (null first), equal turns by role and text; rows that repeat are turns of their own.
    A null role or text is empty. Rows whose conv_id is null are one conversation. An empty table gives an empty
    one, and other columns are not read. A conversation is one training example and so one row.
    """
    turns = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )
    known = F.create_map(*(F.lit(x) for role, header in template.headers.items() for x in (role, header)))
    before, after = template.other_header.split("{role}")

    def segments(t: Column) -> Column:
        header = F.coalesce(F.element_at(known, t["role"]), F.concat(F.lit(before), F.url_encode(t["role"]), F.lit(after)))
        learned = t["role"].isin(*template.learned) if template.learned else F.lit(False)
        return F.array(
            F.struct(header.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), learned.alias("loss")),
            F.struct(F.lit(template.footer).alias("text"), F.lit(False).alias("loss")),
        )

    fault = first_fault(F.transform("turns", lambda t: t["role"]), transitions)
    made = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), fault.alias("first_fault"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return made.select("conv_id", "n_turns", (F.col("first_fault") == -1).alias("valid"), "first_fault", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """Array of struct(role, text) of a formatted conversation."""
    footer = _any_of((template.footer,)).replace("\\\n", "\\n")
    parts = F.split(formatted, footer)
    names = F.create_map(*(F.lit(x) for role, header in template.headers.items() for x in (header, role)))
    headers = _any_of(tuple(template.headers.values()))
    before, after = (_any_of((x,)) for x in template.other_header.split("{role}"))
    pattern = rf"(?s)^({headers}|{before}([^:]*){after})(.*)$"

    def turn(p: Column) -> Column:
        role = F.coalesce(F.element_at(names, F.regexp_extract(p, pattern, 1)), F.url_decode(F.regexp_extract(p, pattern, 2)))
        return F.struct(role.alias("role"), unescape(F.regexp_extract(p, pattern, 3), template).alias("text"))

    # behind the last footer there is nothing
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def learned_text(segments: Column, template: Template = Template()) -> Column:
    """What is under the loss, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
