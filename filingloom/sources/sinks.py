"""Cells for sinks, views per table, metrics lines, and sources of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_cell(value: Column) -> Column:
    """Text of a cell: missing is empty, whole floats lose their ``.0``, line ends become ``; `` and white space is single."""
    t = F.coalesce(value.cast("string"), F.lit(""))
    t = F.when(F.lower(t) == "nan", "").otherwise(F.regexp_replace(t, "^(-?\\d+)\\.0+$", "$1"))
    t = F.regexp_replace(F.regexp_replace(t, "\\s*\\r?\\n\\s*", "; "), "[ \\t]+", " ")
    return F.trim(t)


def write_views(facts: DataFrame, path: str, table: str = "Table_ID") -> None:
    """CSV files in one folder per table. Rows of a table are spread as they lie: a large table has many files, not one task."""
    facts.select(*[F.col(f"`{c}`") if c == table else clean_cell(F.col(f"`{c}`")).alias(c) for c in facts.columns]).write.partitionBy(table).option("header", True).option("emptyValue", "").csv(path)


def source_summary(index: DataFrame, source: str = "Source") -> DataFrame:
    """Tables per source, for the summary sheet of a consolidated index."""
    return index.groupBy(source).agg(F.count("*").alias("Table Count"))


def append_metrics(rows: DataFrame, path: str) -> None:
    """One JSON line per row, in a folder per day (column ``day``)."""
    rows.write.mode("append").partitionBy("day").json(path)


def series_source(raw: DataFrame, date: str, expected: tuple[str, str]) -> DataFrame:
    """Rows of a deviation series: a readable date and one of the two expected values; missing columns are an error."""
    missing = {date, *expected} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    a, b = (F.col(f"`{c}`").try_cast("double") for c in expected)
    return raw.withColumn(date, F.col(f"`{date}`").cast("string").try_cast("timestamp")).where(F.col(f"`{date}`").isNotNull() & (a.isNotNull() | b.isNotNull()))


def html_rows(html: Column) -> Column:
    """Cells of every table row in a page: array of arrays of texts, inner tags dropped."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "\\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), bare))


def markdown(rows: Column) -> Column:
    """Rows of cells as a markdown table: the first is its header, pipes inside cells are escaped; empty without rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), body), "\n")).otherwise("")


def chart_records(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON record per row with the named columns in order, empty ones as null."""
    return df.select("*", F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}).alias("record"))
