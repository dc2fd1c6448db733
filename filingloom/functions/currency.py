"""Currency and percentage texts: format, parse, compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that mean no number.
SENTINELS = ["N/M", "N/A", "NM", "NA", "-", "—", "–", "-%", "$-", "$ -"]


def currency(value: Column) -> Column:
    """``$1,234``, ``($248)``; two decimals if not whole and below 1000; null and not a number stay null."""
    v = value.cast("double")
    size = F.abs(v)
    body = F.when((size % 1 == 0) | (size >= 1000), F.format_number(size, 0)).otherwise(F.format_number(size, 2))
    return F.when(v.isNull() | F.isnan(v) | (size == float("inf")), None).when(v < 0, F.concat(F.lit("($"), body, F.lit(")"))).otherwise(F.concat(F.lit("$"), body))


def percentage(value: Column) -> Column:
    """One decimal and ``%``; ratios within -1 and 1 (not 0) are scaled by 100."""
    v = value.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), F.concat(F.format_number(F.when((F.abs(v) <= 1) & (v != 0), v * 100).otherwise(v), 1), F.lit("%")))


def parse(text: Column) -> Column:
    """Number of a cell: ``$``, ``,`` and ``%`` dropped, parentheses negative, sentinels null."""
    t = F.trim(text)
    bare = F.regexp_replace(t, "[$,%()\\s]", "")
    v = bare.try_cast("double")
    return F.when(t.isin(SENTINELS), None).when(t.rlike("^\\$?\\s*\\(.*\\)%?$"), -v).otherwise(v)


def scaled(text: Column) -> Column:
    """Number with a unit word or letter: thousand, million, billion or k, m, b."""
    low = F.lower(F.trim(text))
    v = F.regexp_extract(F.regexp_replace(low, "[$,]", ""), "(-?\\d+(?:\\.\\d+)?)", 1).try_cast("double")
    unit = F.when(low.rlike("billion|\\db$"), 1e9).when(low.rlike("million|\\dm$"), 1e6).when(low.rlike("thousand|\\dk$"), 1e3).otherwise(1.0)
    return v * unit


def matches(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return (a == b) | (F.abs(a - b) <= F.abs(b) * tolerance)


def cell_format(text: Column) -> Column:
    """A data cell by its own signs: with ``%`` a percentage of one decimal, else an amount; ranges and cells without a number stay, without the blank before ``%``; empty if missing."""
    t = F.trim(text)
    tight = F.replace(t, F.lit(" %"), F.lit("%"))
    ranged = F.lower(t).contains(" to ") | (F.length(t) - F.length(F.replace(t, F.lit("%"), F.lit(""))) > 1)
    share = F.when(~ranged & parse(t).isNotNull(), F.format_string("%.1f%%", parse(t))).otherwise(tight)
    return F.when(text.isNull(), "").when(t == "—", "-").when(t.contains("%"), share).otherwise(F.coalesce(currency(parse(t)), t))
