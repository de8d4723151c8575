"""Chat formatting by prefix-target expansion, on DataFrame functions alone.

A conversation becomes one template string; every assistant turn becomes one example: the text before the reply is its
context (all preceding turns), the reply alone is trainable. Examples point into the conversation's string by code
points, so a long conversation isn't stored once for each of its turns; ``render`` cuts the contexts out where wanted.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts a backslash is doubled and ``<|``
becomes ``<\\|``, so no text can hold a control string, and :func:`unescape` gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    # a single backslash stands between "<" and "|" only; all others come in pairs
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role stands on one line: its line feeds become ``<\\n|``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted (string), targets (array of example, start, length, turns before).

    Rows are ordered by turn, then role and text where a turn is repeated; a repeated row stays a turn of its own. Null
    text or role is empty; a null turn comes first; a null conv_id is a conversation of its own; an empty table gives no
    rows; other columns are ignored. ``start`` is the number of code points before the reply, ``length`` the reply's
    escaped code points; a conversation without an assistant turn has no targets.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, tail = F.concat(F.lit(START), escape_role(role), F.lit("\n")), F.concat(escape(text), F.lit(END + "\n"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), tail.alias("tail"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    chars = F.sum(F.length("head") + F.length("tail")).over(order.rowsBetween(W.unboundedPreceding, 0))
    # the window and the groups are dealt by conv_id once
    placed = rows.withColumns({"before": F.row_number().over(order) - 1, "start": (chars - F.length("tail")).cast("long")}).select(
        "conv_id",
        F.struct("before", "start", (F.length("tail") - len(END) - 1).cast("long").alias("length"), (F.col("role") == TRAINABLE).alias("on"), F.concat("head", "tail").alias("turn")).alias("row"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return whole.select(
        "conv_id",
        F.array_join(F.col("rows.turn"), "").alias("formatted"),
        F.transform(
            F.filter("rows", lambda r: r["on"]),
            lambda r, i: F.struct(i.alias("example"), r["start"].alias("start"), r["length"].alias("length"), r["before"].alias("before")),
        ).alias("targets"),
    )


def expand_targets(formatted: DataFrame) -> DataFrame:
    """One example per assistant turn: conv_id, example, context, reply (both escaped, as in the template), context_turns.

    ``context`` holds all preceding turns and the reply's header and isn't trained on; ``reply`` is.
    """
    each = formatted.select("conv_id", "formatted", F.explode("targets").alias("t"))
    return each.select(
        "conv_id",
        F.col("t.example").alias("example"),
        F.substring("formatted", F.lit(1), F.col("t.start").cast("int")).alias("context"),
        F.substring("formatted", (F.col("t.start") + 1).cast("int"), F.col("t.length").cast("int")).alias("reply"),
        F.col("t.before").alias("context_turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns as the formatted string tells them: conv_id, turns (array of role, text), replies (array of texts)."""
    parts = F.slice(F.split("formatted", START.replace("|", r"\|"), -1), F.lit(2), F.greatest(F.size(F.split("formatted", START.replace("|", r"\|"), -1)) - 1, F.lit(0)))
    turns = F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.length(p) - F.instr(p, F.lit("\n")) - len(END) - 1)).alias("text"),
        ),
    )
    replies = F.transform("targets", lambda t: unescape(F.substring(F.col("formatted"), (t["start"] + 1).cast("int"), t["length"].cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), replies.alias("replies"), F.length("formatted").cast("long").alias("formatted_chars"))
