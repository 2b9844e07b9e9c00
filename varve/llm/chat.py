"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A declarative template gives each role a header, and all turns an end mark.  A conversation's
turns, in order, become segments ``struct<text, loss>``: the header (never learned), the turn's
escaped text (learned if the role is one the template learns), the end mark.  Control strings in
texts are written as escapes that contain no control string, so the output can be read back
exactly.  The machine walks the roles and names the first turn that is out of order; such
conversations are formatted all the same.

All DataFrame functions.  One conversation is one row, as one training sample is.

Results: null texts are empty; null roles are the role "" and, like other unknown ones, get a
header with their own name; turns of equal number go by role, then text; a null conv_id is a
conversation of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``header`` + role's label + ``header_end``, text, ``turn_end``; ``order``: role after role."""

    header: str = "### "
    header_end: str = ": "
    turn_end: str = "</turn>\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learned: tuple[str, ...] = ("assistant",)
    # Control string -> the letter that stands for it after a backslash.
    escapes: dict[str, str] = field(default_factory=lambda: {"</turn>": "e", "### ": "h"})
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )


def escape(text: Column, t: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, letter in t.escapes.items():
        text = F.replace(text, F.lit(control), F.lit("\\" + letter))
    return text


def unescape(text: Column, t: Template) -> Column:
    """A doubled backslash always begins an escape, so the text is cut there first."""

    def plain(part: Column) -> Column:
        for control, letter in t.escapes.items():
            part = F.replace(part, F.lit("\\" + letter), F.lit(control))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _map(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def _label(role: Column, t: Template) -> Column:
    """A known role's label; an unknown role's own name, escaped, in quotes."""
    safe = F.replace(escape(role, t), F.lit(t.header_end), F.lit("\\c"))
    known = _map({k: F.lit(v) for k, v in t.labels.items()})
    return F.coalesce(F.try_element_at(known, role), F.concat(F.lit('"'), safe, F.lit('"')))


def _role(label: Column, t: Template) -> Column:
    known = _map({v: F.lit(k) for k, v in t.labels.items()})
    inner = F.substring(label, F.lit(2), F.length(label) - 2)
    # \c is undone between doubled backslashes, as the other escapes are.
    inner = F.array_join(F.transform(F.split(inner, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\c"), F.lit(t.header_end))), "\\\\")
    return F.coalesce(F.try_element_at(known, label), unescape(inner, t))


def first_invalid(roles: Column, t: Template) -> Column:
    """Index of the first role the machine does not accept, -1 if it accepts all."""
    follows = _map({k: F.array(*[F.lit(r) for r in v]) for k, v in t.order.items()})
    ended = F.aggregate(
        roles,
        F.struct(F.lit("").alias("state"), F.lit(0).alias("seen"), F.lit(-1).alias("bad")),
        lambda acc, role: F.struct(
            role.alias("state"),
            (acc["seen"] + 1).alias("seen"),
            F.when(acc["bad"] >= 0, acc["bad"])
            .when(F.coalesce(F.array_contains(F.try_element_at(follows, acc["state"]), role), F.lit(False)), -1)
            .otherwise(acc["seen"])
            .alias("bad"),
        ),
    )
    return ended["bad"]


def format_chats(rows: DataFrame, t: Template = Template()) -> DataFrame:
    """conv_id, segments (array<struct<text, loss>>), first_invalid of ``rows`` (conv_id, turn, role, text)."""
    blank = F.lit("")
    turn = F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    learned = F.array(*[F.lit(r) for r in t.learned]).cast("array<string>")

    def segments(x: Column) -> Column:
        header = F.concat(F.lit(t.header), _label(x["role"], t), F.lit(t.header_end))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(header, F.lit(False)),
            piece(escape(x["text"], t), F.array_contains(learned, x["role"])),
            piece(F.lit(t.turn_end), F.lit(False)),
        )

    return turns.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        first_invalid(F.transform("turns", lambda x: x["role"]), t).alias("first_invalid"),
    )


def formatted(segments: Column | str) -> Column:
    """The segments' text in one string."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, t: Template = Template()) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    blocks = F.split(text, t.turn_end, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(block: Column) -> Column:
        at = F.instr(block, t.header_end)
        label = F.substring(block, F.lit(len(t.header) + 1), at - F.lit(len(t.header) + 1))
        body = F.substring(block, at + F.lit(len(t.header_end)), F.length(block))
        return F.struct(_role(label, t).alias("role"), unescape(body, t).alias("text"))

    return F.transform(blocks, turn)


def digests(rows: DataFrame, t: Template = Template()) -> DataFrame:
    """Per conversation, read back from the formatted output: turns and what is learned."""
    made = format_chats(rows, t).select("conv_id", formatted("segments").alias("whole"), "segments", "first_invalid")
    turns = read_back(F.col("whole"), t)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), ""
    )
    return (
        made.withColumn("turns", turns)
        .withColumn("learned", learned)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"),
            F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
            F.length("whole").cast("long").alias("formatted_chars"),
            "first_invalid",
        )
    )
