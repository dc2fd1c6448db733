"""Wide period tables to long facts and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.functions.period import sort_key, split_header

#: Columns of a long fact, and unit headers that are no periods.
FIXED = ["Source", "Section", "Table Title", "Category", "Product/Entity"]
UNITS = ["$ in millions", "$ in billions", "$ in thousands", "in millions", "in billions", "in thousands"]


def to_long(wide: DataFrame, fixed: Sequence[str] = FIXED, drop: Sequence[str] = UNITS) -> DataFrame:
    """Every period column of every row as ``Dates``, ``Header``, ``Data Value``; empty cells stay."""
    ids = [c for c in wide.columns if c in fixed]
    periods = [c for c in wide.columns if c not in fixed and c.lower() not in drop]
    if not periods:
        return wide
    long = wide.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in periods], "_period", "Data Value")
    dates, header = split_header(F.col("_period"))
    return long.select(*[F.col(f"`{c}`") for c in ids], dates.alias("Dates"), header.alias("Header"), "Data Value")


def to_wide(long: DataFrame, keys: Sequence[str], column: str, value: str, order: str, values: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys`` and one column per value of ``column``: its first non-null ``value`` by ``order``; rows with a null key go.

    Without ``values`` every period code of ``column`` gets a column, in order of time.
    """
    if values is None:
        found = long.select(F.col(column).alias("c")).where("c IS NOT NULL").distinct()
        values = [r.c for r in found.orderBy(sort_key(F.col("c")), "c").collect()]
    kept = long.dropna(subset=list(keys)).where(F.col(value).isNotNull())
    return kept.groupBy(*keys).pivot(column, list(values)).agg(F.min_by(value, order))


def inject(df: DataFrame, source: str, section: str, title: str) -> DataFrame:
    """``Source``, ``Section``, ``Table Title`` before the other columns; their own non-blank values win."""
    new = {"Source": source, "Section": section, "Table Title": title}
    pick = lambda n, v: F.coalesce(F.when(F.trim(F.col(f"`{n}`")) != "", F.col(f"`{n}`")), F.lit(v)) if n in df.columns else F.lit(v)
    return df.select(*[pick(n, v).alias(n) for n, v in new.items()], *[F.col(f"`{c}`") for c in df.columns if c not in new])


def check_long(wide: DataFrame, long: DataFrame, fixed: Sequence[str] = FIXED, drop: Sequence[str] = UNITS) -> DataFrame:
    """One row: the period columns of ``wide``, its rows, the rows that ``to_long`` owes, those found, and ``whole``: whether those and the columns are as they should be."""
    ids = [c for c in wide.columns if c in fixed]
    periods = [c for c in wide.columns if c not in fixed and c.lower() not in drop]
    named = set(long.columns) == (set(ids) | {"Dates", "Header", "Data Value"} if periods else set(wide.columns))
    counts = wide.agg(F.count("*").alias("rows")).crossJoin(long.agg(F.count("*").alias("found")))
    wanted = F.col("rows") * (len(periods) or 1)
    return counts.select(F.lit(len(periods)).alias("periods"), "rows", wanted.alias("wanted"), "found", ((wanted == F.col("found")) & F.lit(named)).alias("whole"))
