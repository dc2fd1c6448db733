"""Fiscal period codes such as ``Q3-2025``, ``Q3-QTD-2025``, ``Q3-YTD-2025`` and ``YTD-2024``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code at the head of a period column, tried in this order.
CODE = "^(Q[1-4]-QTD-\\d{4}|Q[1-4]-YTD-\\d{4}|Q[1-4]-\\d{4}|YTD-\\d{4})"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def split_header(header: Column) -> tuple[Column, Column]:
    """(code, rest) of a period column's name; (name, '') if it has no code."""
    code = F.regexp_extract(header, CODE, 1)
    found = code != ""
    return F.when(found, code).otherwise(header), F.when(found, F.trim(F.substr(header, F.length(code) + 1))).otherwise(F.lit(""))


def quarter_of_month(text: Column) -> Column:
    """Quarter of the first month named in a text, null without one."""
    name = F.regexp_extract(F.lower(text), "(" + "|".join(MONTHS) + ")", 1)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    return F.when(name != "", F.ceil(month / 3).cast("int"))


def header_code(text: Column) -> Column:
    """Period code of a spoken header: ``Three Months Ended June 30, 2024`` is ``Q2-QTD-2024``; null if unknown."""
    low, year = F.lower(text), F.regexp_extract(text, "(20\\d{2})", 1)
    q = F.concat(F.lit("Q"), quarter_of_month(text).cast("string"))
    return F.when(year == "", None).when(low.rlike("three months ended"), F.concat(q, F.lit("-QTD-"), year)).when(
        low.rlike("(six|nine) months ended"), F.concat(q, F.lit("-YTD-"), year)
    ).when(low.rlike("year ended|twelve months ended"), F.concat(F.lit("YTD-"), year)).when(low.rlike("^(at|as of) "), F.concat(q, F.lit("-"), year))


def code_of_date(date: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(date).cast("string"), F.lit("-"), F.year(date).cast("string"))


def display(code: Column) -> Column:
    """Readable form of a code; other texts stay."""
    ends = F.create_map(*[F.lit(x) for kv in {"1": "March 31", "2": "June 30", "3": "September 30", "4": "December 31"}.items() for x in kv])
    spans = F.create_map(*[F.lit(x) for kv in {"1": "Three", "2": "Six", "3": "Nine", "4": "Twelve"}.items() for x in kv])
    q, year = F.regexp_extract(code, "^Q([1-4])", 1), F.regexp_extract(code, "(\\d{4})$", 1)
    at = lambda m: F.try_element_at(m, q)
    return (
        F.when(code.rlike("^Q[1-4]-QTD-\\d{4}$"), F.concat(F.lit("Three Months Ended "), at(ends), F.lit(", "), year))
        .when(code.rlike("^Q[1-4]-YTD-\\d{4}$"), F.concat(at(spans), F.lit(" Months Ended "), at(ends), F.lit(", "), year))
        .when(code.rlike("^Q[1-4]-\\d{4}$"), F.concat(F.lit("At "), at(ends), F.lit(", "), year))
        .when(code.rlike("^YTD-\\d{4}$"), F.concat(F.lit("Year Ended December 31, "), year))
        .otherwise(code)
    )


def kind(header: Column) -> Column:
    """period_based, annual_ytd, point_in_time, annual or other."""
    return (
        F.when(header.rlike("^Q[1-4]-(QTD|YTD)-\\d{4}"), "period_based").when(header.rlike("^YTD-\\d{4}"), "annual_ytd")
        .when(header.rlike("^Q[1-4]-\\d{4}"), "point_in_time").when(header.rlike("^\\d{4}$"), "annual").otherwise("other")
    )


def sort_key(code: Column) -> Column:
    """year * 100 + quarter * 10 + rank of point, QTD, YTD; 999900 if unknown."""
    year = F.regexp_extract(code, "((?:19|20)\\d{2})", 1)
    q = F.regexp_extract(code, "^Q([1-4])", 1)
    rank = F.when(code.contains("QTD"), 1).when(code.contains("YTD"), 2).otherwise(0)
    return F.when(year == "", 999900).otherwise(year.try_cast("int") * 100 + F.when(q == "", 4).otherwise(q.try_cast("int")) * 10 + rank)


def end_date(year: Column, quarter: Column) -> Column:
    """Last day of a quarter; without a quarter the year's."""
    return F.last_day(F.make_date(year, F.coalesce(quarter, F.lit(4)) * 3, F.lit(1)))


#: Month and days in which each quarter's filing comes.
FILING_WINDOWS = {"Q1": (5, 5, 15), "Q2": (8, 5, 15), "Q3": (11, 5, 15), "10K": (2, 20, 28)}


def relation(year: Column, quarter: Column, other_year: Column, other_quarter: Column) -> Column:
    """same, sequential (neighbouring quarters), yoy (the quarter a year apart) or different; a whole year has a null quarter."""
    years, quarters = F.abs(year - other_year), F.abs(quarter - other_quarter)
    equal = quarter.eqNullSafe(other_quarter)
    apart = F.coalesce(F.abs((year * 4 + quarter) - (other_year * 4 + other_quarter)) == 1, F.lit(False)) & quarters.isNotNull()
    return F.when((years == 0) & equal, "same").when(apart, "sequential").when((years == 1) & equal, "yoy").otherwise("different")


def in_filing_window(quarter: Column, day: Column) -> Column:
    """Whether a date lies in the window in which a quarter (Q1 to Q3, 10K) is filed."""
    fits = F.lit(False)
    for name, (month, first, last) in FILING_WINDOWS.items():
        fits = fits | ((quarter == name) & (F.month(day) == month) & F.dayofmonth(day).between(first, last))
    return F.coalesce(fits, F.lit(False))
