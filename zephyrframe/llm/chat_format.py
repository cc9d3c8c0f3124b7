"""Chat formatting by a state machine over roles, with loss flags by segment.

A template is plain data: how a turn is marked, which roles bear loss and which
role may follow which. Every conversation becomes a list of segments (text,
loss), whose texts joined are the formatted conversation. Inside roles and texts
the escape character and the first character of every mark are replaced by
two-character codes, so marks can't be forged and reading back is exact.

All of it is built from DataFrame functions. A conversation is one output row,
so its turns are gathered in one place; that is bounded by the conversation.

Defined results: null texts and roles are empty. Turns of equal number are
ordered by role, then text; null turns come first. A row with a null
conversation id belongs to no other row: it is a conversation of one turn, so
such rows are never gathered. Roles the machine does not know make a
conversation invalid, and bear no loss. Repeated rows are turns of their own; an
empty table gives no conversations. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks, loss and turn order of a chat format.

    The mark that begins a turn begins with `lead`, a character that texts have only escaped, and no mark
    has the escape character; else a text could forge a turn, so other templates are refused.
    The mark after a role may be any that no role has; the one after a text is taken off its end.
    """

    before_role: str = "<turn "
    after_role: str = "<:>"
    after_text: str = "</turn>"
    lead: str = "<"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role, next state); a conversation begins in "start" and may end in a state of `ends`.
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "ready"),
        ("start", "user", "asked"),
        ("ready", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    ends: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        if len(self.lead) != 1 or len(self.escape) != 1 or self.lead == self.escape or {self.lead, self.escape} & set("el"):
            raise ValueError("lead and escape are two characters, other than the code letters e and l")
        if not self.before_role.startswith(self.lead):
            raise ValueError(f"the mark {self.before_role!r} doesn't begin with {self.lead!r}, so texts could forge it")
        if not self.after_role or any(self.escape in mark for mark in (self.before_role, self.after_role, self.after_text)):
            raise ValueError("a role needs a mark after it, and no mark may have the escape character")


def escaped(text: Column, template: ChatTemplate) -> Column:
    """A text in which neither the escape character nor a mark's first character is left alone."""
    e = template.escape
    return F.replace(F.replace(text, F.lit(e), F.lit(e + "e")), F.lit(template.lead), F.lit(e + "l"))


def unescaped(text: Column, template: ChatTemplate) -> Column:
    """The inverse of `escaped`: every escape character is followed by its code letter."""
    e = template.escape
    return F.replace(F.replace(text, F.lit(e + "l"), F.lit(template.lead)), F.lit(e + "e"), F.lit(e))


def final_state(roles: Column, template: ChatTemplate) -> Column:
    """The state after all roles; "invalid" once a role may not follow."""
    pairs = [x for state, role, after in template.moves for x in (F.lit(f"{state}>{role}"), F.lit(after))]
    moves = F.create_map(*pairs)
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(">"), role)), F.lit("invalid")))


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segments (array of text, loss), formatted, valid: one row for each conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named, alone = turns.filter(F.col(conv_col).isNotNull()), turns.filter(F.col(conv_col).isNull())
    grouped = named.groupBy(F.col(conv_col).alias("conv")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    grouped = grouped.unionByName(alone.select(F.col(conv_col).alias("conv"), F.array(turn).alias("turns")))

    def segments(t: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(template.before_role), escaped(t["role"], template), F.lit(template.after_role))
        return F.array(segment(head, F.lit(False)), segment(escaped(t["text"], template), t["role"].isin(*template.loss_roles)), segment(F.lit(template.after_text), F.lit(False)))

    laid = grouped.select("conv", F.flatten(F.transform("turns", segments)).alias("segments"), final_state(F.col("turns.role"), template).isin(*template.ends).alias("valid"))
    return laid.select(F.col("conv").alias(conv_col), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns of a formatted conversation: array of (role, text), as they went in."""
    # Escaped texts hold no `lead`, so turns begin where the first mark stands and nowhere else.
    pieces = F.split(formatted, _literal(template.before_role), -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda p: _turn(p, template))


def _turn(piece: Column, template: ChatTemplate) -> Column:
    inner = F.substring(piece, F.lit(1), F.length(piece) - len(template.after_text))
    cut = F.instr(inner, template.after_role)
    role = F.substring(inner, F.lit(1), cut - 1)
    text = F.substring(inner, cut + len(template.after_role), F.length(inner))
    return F.struct(unescaped(role, template).alias("role"), unescaped(text, template).alias("text"))


def _literal(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def read_loss(segments: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def digests(laid: DataFrame, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id") -> DataFrame:
    """What the output holds, read back from it: turns, loss text and lengths with their hashes."""
    turns = read_turns(F.col("formatted"), template)
    read = laid.select(conv_col, "formatted", "valid", turns.alias("turns"), read_loss(F.col("segments"), template).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
