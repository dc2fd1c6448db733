"""Scores of tables, retrieved contexts and answers; bands and unit factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Factors of unit words.
UNITS = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != ""))


def table_count(n: Column) -> Column:
    """0, 10, 15 and 20 for no table, one or two, up to five, more."""
    return F.when(n <= 0, 0).when(n <= 2, 10).when(n <= 5, 15).otherwise(20)


def column_consistency(widths: Column) -> Column:
    """Share of rows that have the most common width; 0 without rows."""
    counts = F.transform(F.array_distinct(widths), lambda w: F.size(F.filter(widths, lambda x: x == w)))
    return F.when(F.size(widths) > 0, F.array_max(counts) / F.size(widths)).otherwise(0.0)


def width_consistency(has_headers: Column, widths: Column) -> Column:
    """15 for headers, 10 for at most two widths."""
    return F.when(has_headers, 15).otherwise(0) + F.when(F.size(F.array_distinct(widths)) <= 2, 10).otherwise(0)


def structure(rows: Column, columns: Column, headed: Column, least_rows: int = 2, least_columns: int = 2) -> Column:
    """1, less 0.3 for few rows, 0.3 for few columns and 0.2 for a first row that is no header."""
    return F.greatest(
        F.lit(0.0),
        F.lit(1.0) - F.when(rows < least_rows, 0.3).otherwise(0.0) - F.when((rows > 0) & (columns < least_columns), 0.3).otherwise(0.0) - F.when((rows > 0) & ~headed, 0.2).otherwise(0.0),
    )


def conciseness(answer: Column, least: int = 20, most: int = 2000) -> Column:
    """Rises to 1 at ``least`` characters, falls by the share of excess over ``most``, by half at most."""
    n = F.length(F.coalesce(answer, F.lit("")))
    return F.when(n < least, n / least).when(n > most, 1.0 - F.least((n - most) / most, F.lit(0.5))).otherwise(1.0)


def keyword_overlap(query: Column, context: Column) -> Column:
    """Share of the query's words that the context holds."""
    q = _words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, _words(context))) / F.size(q)).otherwise(0.0)


def term_coverage(terms: Column, text: Column) -> Column:
    """Share of the terms that stand in the text, whatever their case; 1 without terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))) / F.size(terms)).otherwise(1.0)


def estimated_recall(scores: Column) -> Column:
    """Mean score and 0.1 for each of 0.7 or more (0.3 at most), 1 at most; 0 without scores."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    high = F.size(F.filter(scores, lambda x: x >= 0.7))
    return F.when(F.size(scores) > 0, F.least(mean + F.least(high * 0.1, F.lit(0.3)), F.lit(1.0))).otherwise(0.0)


def context_relevance(scores: Column, coverage: Column) -> Column:
    """0.7 of the scores' mean weighed by 1 / rank and 0.3 of the terms' coverage, 1 at most."""
    weight = F.transform(scores, lambda s, i: 1.0 / (i + 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = F.when(F.size(scores) > 0, total(F.zip_with(scores, weight, lambda s, w: s * w)) / total(weight)).otherwise(0.0)
    return F.least(0.7 * mean + 0.3 * coverage, F.lit(1.0))


def within_budget(chunks: DataFrame, keys: list[str], order: list[str], text: str, most: int = 4000) -> DataFrame:
    """Chunks of each key, in order, while their summed length stays within ``most``; it stops at the first that doesn't fit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The sum never falls, so all behind the first overflow are over too.
    return chunks.withColumn("_upto", upto).where(F.col("_upto") <= most).drop("_upto")


def thresholds(tolerance: Column, amber: float = 10.0) -> Column:
    """Green up to the tolerance, amber for ``amber`` more, red up to 50 more and to 100 at least."""
    return F.struct(tolerance.alias("green"), (tolerance + amber).alias("amber"), F.greatest(tolerance + 50, F.lit(100.0)).alias("red"))


def bands(expected: Column, percent: Column) -> Column:
    """(upper, lower): values that deviate from the expected one by ``percent`` of themselves."""
    return F.struct((expected / (1 - percent / 100)).alias("upper"), (expected / (1 + percent / 100)).alias("lower"))


def to_base(value: Column, unit: Column) -> Column:
    """The value times its unit word's factor; unknown words count one."""
    factor = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return value * F.coalesce(F.try_element_at(factor, F.regexp_replace(F.lower(F.trim(unit)), "s$", "")), F.lit(1.0))


#: Well-formed numbers of a cell, and garbled or numeric contents of a table.
WELL_FORMED = "^\\$?[\\d,]+\\.?\\d*$|^\\([\\d,]+\\.?\\d*\\)$|^-?[\\d.]+%$|^-?[\\d,]+\\.?\\d*$"
GARBLED = "[^\\x00-\\x7F]{5,}|\\?{3,}|\\x{FFFD}{2,}"
#: Shares of the parts of a table's score and of an extraction's.
TABLE_SHARES = {"structure": 0.20, "completeness": 0.15, "consistency": 0.10, "numbers": 0.20, "header": 0.10, "content": 0.15, "metadata": 0.10}
EXTRACTION_SHARES = {"tables": 0.20, "cells": 0.30, "structure": 0.25, "text": 0.15, "backend": 0.10}


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def numeric_accuracy(rows: Column) -> Column:
    """Share of well-formed numbers among the cells with digits that are no label and no header; 0 without any."""
    data = lambda r: F.slice(r, F.lit(2), F.greatest(F.size(r), F.lit(1)))
    cells = F.flatten(F.transform(data(rows), data))
    digits = F.filter(F.transform(cells, lambda x: F.trim(x)), lambda c: c.rlike("\\d") & (F.lower(c) != "n/a"))
    return _share(F.size(F.filter(digits, lambda c: c.rlike(WELL_FORMED))), F.size(digits), 0.0)


def header_score(header: Column) -> Column:
    """1, less 0.1 for each empty, numeric or one-letter cell; not below 0."""
    plain = F.transform(header, lambda c: F.trim(F.coalesce(c, F.lit(""))))
    count = lambda p: F.size(F.filter(plain, lambda c: c.rlike(p)))
    return F.greatest(F.lit(0.0), 1.0 - 0.1 * (count("^$") + count("^\\d") + count("^.$")))


def content_score(rows: Column) -> Column:
    """1 less the share of cells of which over 30% are odd characters; 0 under two rows."""
    cells = F.transform(F.flatten(rows), lambda c: F.coalesce(c, F.lit("")))
    odd = lambda c: F.length(F.regexp_replace(c, "[\\p{L}\\p{N} .,%\\-$()]", "")) > 0.3 * F.greatest(F.length(c), F.lit(1))
    return F.when(F.size(rows) < 2, 0.0).otherwise(1.0 - _share(F.size(F.filter(cells, odd)), F.size(cells), 0.0))


def filled_share(*fields: Column) -> Column:
    """Share of the fields that are not null."""
    return sum((f.isNotNull().cast("int") for f in fields), F.lit(0)) / len(fields)


def table_score(**parts: Column) -> Column:
    """0 to 100 by the shares of TABLE_SHARES; all parts are wanted."""
    return 100 * sum((parts[name] * share for name, share in TABLE_SHARES.items()), F.lit(0.0))


def extraction_quality(**parts: Column) -> Column:
    """Points of an extraction by EXTRACTION_SHARES, 100 at most."""
    return F.least(sum((parts[name] * share for name, share in EXTRACTION_SHARES.items()), F.lit(0.0)), F.lit(100.0))


def text_quality(content: Column) -> Column:
    """0 without a table, 5 for garbled text, 15 for one with numbers, else 10."""
    return F.when(F.coalesce(content, F.lit("")) == "", 0).when(content.rlike(GARBLED), 5).when(content.rlike("\\d"), 15).otherwise(10)
