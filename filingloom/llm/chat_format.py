"""Conversations as one marked string each, with loss spans; expressions only, and reversible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template, then marks of other templates that texts must not carry either.
OPEN, ROLE_END, JOIN, CLOSE = "<s>[INST]", "[/INST]", "<|join|>", "</s>"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<|join|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


def escape(text: Column) -> Column:
    """Double backslashes, then break each control string behind its first character with one."""
    out = F.regexp_replace(text, "\\\\", "\\\\\\\\")
    marks = "|".join("(?<=" + _literal(c[0]) + ")" + _literal(c[1:]) for c in CONTROL)
    return F.regexp_replace(out, "(" + marks + ")", "\\\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _literal(s: str) -> str:
    return "".join("\\" + c if c in "[]|/<>" else c for c in s)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans`` (start from 0 and length, in code points).

    Turns are sorted by number (ties by role, then text); adjacent turns of the
    same role become one block that keeps their bounds:
    ``<s>[INST] role [/INST] text (<|join|> text)* </s>`` without the blanks.
    Roles and texts are escaped, so that marks in the output are the template's
    only. Loss spans hold each text of ``loss_role``: where it starts is a running
    sum over the sorted turns, so the work is in proportion to them.

    Null texts and roles count as empty. A row with a null conversation id is a
    conversation of its own, with rows equal to it, so that such rows spread.
    Repeated rows are turns of their own, an empty table gives no rows, other
    columns are not read.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    own = F.when(F.col(conv_col).isNull(), F.sha2(F.to_json(F.struct(F.col(turn_col).alias("t"), role.alias("r"), text.alias("x"))), 256))
    rows = turns.select(F.col(conv_col).alias("conv_id"), own.alias("own"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    sorted_turns = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "text")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))
    joined = F.coalesce(F.lag("role").over(sorted_turns) == F.col("role"), F.lit(False))
    goes_on = F.coalesce(F.lead("role").over(sorted_turns) == F.col("role"), F.lit(False))
    # For each turn: what stands before its text, its text, what closes it; a block opens or closes where the role changes.
    pieces = rows.select(
        "conv_id", "own", "turn", "role", "text", escape(F.col("text")).alias("body"), F.row_number().over(sorted_turns).alias("at"),
        F.when(joined, F.lit(JOIN)).otherwise(head).alias("before"), F.when(goes_on, F.lit("")).otherwise(F.lit(CLOSE)).alias("after"),
    )
    upto = F.sum(F.length("before") + F.length("body") + F.length("after")).over(sorted_turns.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = pieces.withColumn("end", upto).select(
        "conv_id", "own", "at", F.concat("before", "body", "after").alias("piece"),
        F.when(
            F.col("role") == loss_role,
            F.struct((F.col("end") - F.length("after") - F.length("body")).cast("int").alias("start"), F.length("body").cast("int").alias("length")),
        ).alias("span"),
    )
    done = placed.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "span"))).alias("t"))
    return done.select(
        "conv_id", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns that a formatted string holds: array of (role, text), one for each original turn."""
    blocks = F.filter(F.split(formatted, _literal(CLOSE), -1), lambda b: b != "")

    def of_block(b: Column) -> Column:
        inner = F.substr(b, F.lit(len(OPEN) + 1))
        parts = F.split(inner, _literal(ROLE_END), 2)
        return F.transform(
            F.split(F.get(parts, F.lit(1)), _literal(JOIN), -1),
            lambda text: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(text).alias("text")),
        )

    return F.flatten(F.transform(blocks, of_block))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
