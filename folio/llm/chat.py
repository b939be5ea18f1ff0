"""Chat formatting by a finite-state machine over roles (operator 6), in DataFrame functions only.

A template is data: the strings that open, label and close a turn, the role names, which roles bear loss, and the
transitions of the machine. Inside texts and unknown roles the control characters of the template are escaped by a
backslash and a letter, so no control string can occur there, and splitting the output at the control strings gives the
turns back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import let


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are written and which orders of roles are legal."""

    turn_open: str = "### "
    role_close: str = ": "
    turn_close: str = " </turn>\n"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple = ("assistant",)
    #: state -> role -> next state; "start" is the first state.
    transitions: dict = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final_states: tuple = ("answered",)
    #: Control character -> letter after the backslash. The first characters of the control strings must be here.
    escapes: dict = field(default_factory=lambda: {"\\": "b", "#": "h", "<": "l", ":": "c"})

    def __post_init__(self):
        for control in (self.turn_open, self.role_close, self.turn_close):
            if not any(c in control for c in self.escapes):
                raise ValueError(f"no character of {control!r} is escaped")


def escape(text: Column, template: ChatTemplate) -> Column:
    """Text without any control character of the template."""
    for char, letter in sorted(template.escapes.items(), key=lambda x: x[0] != "\\"):
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescape(text: Column, template: ChatTemplate) -> Column:
    """The inverse of escape()."""
    for char, letter in sorted(template.escapes.items(), key=lambda x: x[0] == "\\"):
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def _label(role: Column, template: ChatTemplate) -> Column:
    """The written name of a role; a role without a label is marked by a backslash and `o`, and escaped."""
    out = F.concat(F.lit("\\o"), escape(F.coalesce(role, F.lit("")), template))
    for name, label in template.labels.items():
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return out


def _role(label: Column, template: ChatTemplate) -> Column:
    """The inverse of _label()."""
    out = unescape(F.substring(label, 3, 1 << 30), template)
    for name, shown in template.labels.items():
        out = F.when(label == shown, F.lit(name)).otherwise(out)
    return out


def _walk(turns: Column, template: ChatTemplate) -> Column:
    """Run the machine over the roles: struct(state, error_at): the last state and the first turn (from 0) that no transition allows."""

    def step(acc: Column, turn: Column) -> Column:
        state = F.lit(None).cast("string")
        for source, moves in template.transitions.items():
            for role, target in moves.items():
                state = F.when((acc["state"] == source) & (turn["role"] == role), F.lit(target)).otherwise(state)
        return F.struct(
            F.coalesce(state, F.lit("broken")).alias("state"),
            F.when(acc["error_at"].isNull() & state.isNull(), acc["at"]).otherwise(acc["error_at"]).alias("error_at"),
            (acc["at"] + 1).alias("at"),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("error_at"), F.lit(0).alias("at"))
    return F.aggregate(turns, start, step)


def format_conversations(df: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, formatted string, segments array<struct<text, loss>>, valid boolean, error_at int, state string.

    Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have one order and all are kept. Null
    text is empty, null role is the empty role; both are legal output though the machine rejects the role. A conversation
    whose roles the machine rejects is formatted all the same and has valid = false and error_at = the first offending
    turn (or the number of turns, if it only ends too early); state is the machine's last state, `broken` after an offence. Rows with a null conv_col form one conversation. The segments'
    texts, concatenated, are `formatted`; loss is true for the escaped texts of the template's loss roles and for nothing
    else. Only the four named columns are read; an empty table gives an empty result. One shuffle, by conversation.
    """
    template = template or ChatTemplate()
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = df.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.turn_open), _label(t["role"], template), F.lit(template.role_close))
        loss = F.coalesce(t["role"].isin(list(template.loss_roles)), F.lit(False))
        part = lambda text, bears: F.struct(text.alias("text"), bears.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escape(t["text"], template), loss), part(F.lit(template.turn_close), F.lit(False)))

    out = turns.select("conv", F.flatten(F.transform("turns", segments)).alias("segments"), _walk(F.col("turns"), template).alias("end"), F.size("turns").alias("n"))
    ended = F.col("end.state").isin(list(template.final_states))
    return out.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        (F.col("end.error_at").isNull() & ended).alias("valid"),
        F.when(F.col("end.error_at").isNull() & ~ended, F.col("n")).otherwise(F.col("end.error_at")).alias("error_at"),
        F.col("end.state").alias("state"),
    )


def parse_formatted(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """Read a formatted conversation back: array<struct<role, text>>, unescaped."""
    template = template or ChatTemplate()
    # Every turn ends with the close string and escaped texts never hold it, so a plain split is exact.
    chunks = F.split(formatted, _quoted(template.turn_close), -1)
    chunks = F.slice(chunks, F.lit(1), F.size(chunks) - 1)

    def turn(chunk: Column) -> Column:
        body = F.substring(chunk, len(template.turn_open) + 1, 1 << 30)
        label = F.substring_index(body, template.role_close, 1)
        text = F.substring(body, F.char_length(label) + len(template.role_close) + 1, F.lit(1 << 30))
        return F.struct(_role(label, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(chunks, turn)


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped and joined without anything between."""
    template = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def _quoted(literal: str) -> str:
    """A regular expression that matches just this string."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def digest_turns(turns: Column) -> Column:
    """Lowercase hex SHA-256 of role, newline, text, newline for each turn."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)


def summarize(formatted: DataFrame, conv_col: str = "conv_id", template: ChatTemplate | None = None) -> DataFrame:
    """What can be read back from the output of format_conversations(), with what its state machine found."""
    # The turns and the loss text are each computed once per row.
    turns = parse_formatted(F.col("formatted"), template)
    facts = let(turns, lambda t: F.struct(F.size(t).cast("long").alias("n"), digest_turns(t).alias("sha")))
    loss = let(loss_text(F.col("segments"), template), lambda t: F.struct(F.char_length(t).cast("long").alias("n"), F.sha2(t, 256).alias("sha")))
    out = formatted.select(conv_col, facts.alias("facts"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "error_at", "state")
    return out.select(
        conv_col,
        F.col("facts.n").alias("n_turns"),
        F.col("facts.sha").alias("turns_sha256"),
        F.col("loss.n").alias("loss_chars"),
        F.col("loss.sha").alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "error_at",
        "state",
    )
