"""Chat formatting with DataFrame functions only.

A declarative template says how a turn is opened and closed, which roles carry loss, and which role may follow which. The
turns of a conversation run through that finite-state machine, and the result lists the formatted text as segments with
a loss flag each. Control strings inside texts and roles are escaped, which `unescape` undoes: an escaped text holds no
"<" and no "[", and every control string begins with one of them.

A conversation becomes one row, so it has to fit into a row; the number of conversations is not limited.

Behaviour at the edges: turns are ordered by (turn, role, text), null turns first; a null text or role is empty; repeated
rows are turns of their own; rows with a null conv_id form one conversation; conversations that break the turn order are
formatted too, with `valid` false and the number of the first wrong turn (from 0) in `broken_at`; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes, in the order in which they are applied; every escape is a backslash and a letter.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    open: tuple[str, str] = ("[", "] ")  # around the role
    close: str = "</s>\n"
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    accept: tuple[str, ...] = ("assistant", "user")

    def __post_init__(self) -> None:
        if not all(x[:1] in ("<", "[") for x in (self.begin, self.open[0], self.close)) or self.open[1][:1] != "]":
            raise ValueError('control strings begin with "<" or "[", and what ends a role with "]"')


LLAMA_LIKE = Template()


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _walk(roles: Column, template: Template) -> Column:
    """(state, at, broken_at) after all roles; the state is empty once a role may not follow."""
    table = F.create_map(*[x for now, after in template.moves.items() for role in after for x in (F.lit(f"{now}>{role}"), F.lit(role))])
    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("broken_at"))

    def step(s: Column, role: Column) -> Column:
        state = F.coalesce(F.element_at(table, F.concat(s["state"], F.lit(">"), role)), F.lit(""))
        broken = F.coalesce(s["broken_at"], F.when(state == "", s["at"]))
        return F.struct(state.alias("state"), (s["at"] + 1).alias("at"), broken.alias("broken_at"))

    return F.aggregate(roles, first, step)


def format_conversations(conversations: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text, loss), valid, broken_at."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def parts(t: Column) -> Column:
        opening = F.concat(F.lit(template.open[0]), escape(t["role"]), F.lit(template.open[1]))
        pieces = ((opening, F.lit(False)), (escape(t["text"]), t["role"].isin(*template.loss)), (F.lit(template.close), F.lit(False)))
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in pieces])

    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    made = grouped.select(
        "conv_id",
        F.concat(begin, F.flatten(F.transform("turns", parts))).alias("segments"),
        _walk(F.transform("turns", lambda t: t["role"]), template).alias("end"),
    )
    return made.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        (F.col("end.broken_at").isNull() & F.col("end.state").isin(*template.accept)).alias("valid"),
        "end.broken_at",
    )


def read_turns(formatted: Column, template: Template = LLAMA_LIKE) -> Column:
    """The (role, text) turns of a formatted text, unescaped."""
    body = F.substring(formatted, F.lit(len(template.begin) + 1), F.length(formatted))
    cut = F.split(body, f"\\Q{template.close}\\E")
    whole = F.slice(cut, F.lit(1), F.size(cut) - 1)

    def turn(t: Column) -> Column:
        role = F.substring(F.substring_index(t, template.open[1], 1), F.lit(len(template.open[0]) + 1), F.length(t))
        skip = F.length(F.substring_index(t, template.open[1], 1)) + len(template.open[1])
        return F.struct(unescape(role).alias("role"), unescape(F.substring(t, skip + 1, F.length(t))).alias("text"))

    return F.transform(whole, turn)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
