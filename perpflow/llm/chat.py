"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its reply
alone under the loss mask. Turns after the last reply (or all turns, where there is no reply) make one
more example with nothing to train on, so that the examples hold the whole conversation.

Template: ``### Role: text </turn>`` and a line break for each turn. In texts, ``\\`` ``#`` and
the ``<`` of ``</turn>`` get a backslash before them, so no text can open or close a turn, and taking
one backslash off gives the text back.

A conversation is gathered in one row, as its digest over all turns in order asks for; its
examples are exploded one at a time. Their text grows with the square of the turns, which is the
method's own size.

Cases: null text is empty; a null role reads back as an empty role; turns are ordered by turn, then role, then
text, nulls first, so ties and repeated rows have one order; a null conv_id is a conversation of
its own; an empty table gives no examples; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

END = " </turn>\n"
#: How the known roles are written.
ROLES = {"assistant": "Assistant", "user": "User", "system": "System"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#]|<(?=/turn>))", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_mark(role: Column) -> Column:
    mark = F.concat(F.lit("="), F.regexp_replace(F.coalesce(role, F.lit("")), r"([\\#:<])", r"\\$1"))
    for name, shown in ROLES.items():
        mark = F.when(role == name, shown).otherwise(mark)
    return mark


def _role(mark: Column) -> Column:
    role = unescape(F.substring(mark, 2, 2**31 - 1))
    for name, shown in ROLES.items():
        role = F.when(mark == shown, name).otherwise(role)
    return role


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, whole): offsets in code points; ``whole`` marks the one with all turns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", text.alias("text"),
        F.concat(F.lit("### "), _role_mark(F.col("role")), F.lit(": "), escape(text), F.lit(END)).alias("piece"),
        F.length(escape(text)).alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("reply"))
    grouped = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "piece", "body", "reply"))).alias("turns"))
    at = F.explode(F.expr("filter(sequence(1, size(turns)), i -> turns[i - 1].reply OR i = size(turns))")).alias("example")
    examples = grouped.select(
        "conv_id", F.expr("transform(turns, t -> t.piece)").alias("pieces"), F.expr("transform(turns, t -> t.body)").alias("bodies"),
        F.expr("transform(turns, t -> t.reply)").alias("replies"), at)
    shown = examples.select(
        "conv_id", F.col("example").cast("long"), F.array_join(F.expr("slice(pieces, 1, example)"), "").alias("text"),
        F.expr("bodies[example - 1]").alias("body"), F.expr("replies[example - 1]").alias("reply"),
        (F.col("example") == F.size("pieces")).alias("whole"))
    stop = F.length("text") - F.lit(len(END))
    return shown.select(
        "conv_id", "example", "text", F.when(F.col("reply"), stop - F.col("body")).otherwise(F.length("text")).cast("long").alias("loss_start"),
        F.when(F.col("reply"), stop).otherwise(F.length("text")).cast("long").alias("loss_end"), "whole")


def read_turns(text: Column) -> Column:
    """Array of (role, text) out of a formatted text."""
    parts = F.filter(F.split(text, END, -1), lambda p: p != "")

    def turn(part: Column) -> Column:
        mark = F.regexp_extract(part, r"(?s)^### ((?:\\.|[^:\\])*+): ", 1)
        return F.struct(_role(mark).alias("role"), unescape(F.substr(part, F.length(mark) + F.lit(7))).alias("text"))

    return F.transform(parts, turn)


def digests(examples: DataFrame) -> DataFrame:
    """What the formatted examples say, one row for each conversation."""
    loss = unescape(F.substr("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    turns = F.when(F.col("whole"), read_turns(F.col("text")))
    read = examples.select(
        "conv_id", "example", F.when(F.col("loss_end") > F.col("loss_start"), loss).otherwise("").alias("loss"),
        F.length("text").cast("long").alias("chars"), turns.alias("turns"))
    by_conv = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"),
        F.max(F.struct(F.size("turns").alias("n"), "turns")).alias("last"))
    said = F.array_join(F.transform("last.turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    losses = F.array_join(F.transform("losses", lambda x: x.loss), "")
    return by_conv.select(
        "conv_id", F.col("last.n").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(losses).cast("long").alias("loss_chars"), F.sha2(losses, 256).alias("loss_sha256"), "formatted_chars")
