"""Source names, years and period phrases: columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a cell as a header, and phrases that name a fiscal period, first fit wins.
HEADER_WORDS = ["in millions", "in billions", "$", "months ended", "at "]
FISCAL = ["(Three|Six|Nine|Twelve) Months Ended (\\w+ \\d{1,2}, \\d{4})", "Year Ended (\\w+ \\d{1,2}, \\d{4})", "Quarter Ended (\\w+ \\d{1,2}, \\d{4})", "At (\\w+ \\d{1,2}, \\d{4})"]
#: Month tokens of quarterly sources, first fit wins.
MONTH_TOKENS = [("03", "Q1"), ("06", "Q2"), ("09", "Q3"), ("12", "Q4")]


def source_period(source: Column) -> Column:
    """(year, quarter) of names like ``10q0624``; annual ones are Q4, January and February ones Q4 of the year before; else empty."""
    low = F.lower(source)
    part = lambda i: F.regexp_extract(low, "10([kq])(\\d{2})(\\d{2})", i)
    month, year = part(2).cast("int"), part(3).cast("int") + 2000
    early = (part(1) == "q") & (month <= 2)
    year = F.when(early, year - 1).otherwise(year)
    quarter = F.when((part(1) == "k") | early, F.lit("Q4"))
    # A report of a quarter's last month names it; others count from January.
    quarter = quarter.otherwise(F.concat(F.lit("Q"), (F.floor((month - 1) / 3) + 1).cast("string")))
    known = part(1) != ""
    return F.struct(F.when(known, year.cast("string")).otherwise("").alias("year"), F.when(known, quarter).otherwise("").alias("quarter"))


def report_type(source: Column) -> Column:
    low = F.lower(source)
    out = F.lit("Unknown")
    for kind in ("8", "10-q", "10-k"):
        plain = {"8": "8-k"}.get(kind, kind)
        out = F.when(low.contains(plain) | low.contains(plain.replace("-", "")), plain.upper()).otherwise(out)
    return out


def year_to_period(year: Column, source: Column) -> Column:
    """YTD-2024 for annual sources, Q2-2024 by the month in a quarterly source's name, else the text; only years 2010 to 2039."""
    text, low = F.trim(year), F.lower(F.coalesce(source, F.lit("")))
    quarter = F.lit(None).cast("string")
    for token, q in reversed(MONTH_TOKENS):
        quarter = F.when(low.contains(token), q).otherwise(quarter)
    code = F.when(report_type(low) == "10-K", F.concat(F.lit("YTD-"), text)).when(low.contains("10q") & quarter.isNotNull(), F.concat_ws("-", quarter, text))
    return F.when(text.rlike("^20[1-3][0-9]$"), F.coalesce(code, text)).otherwise(text)


def is_year(value: Column) -> Column:
    """Four digits within 2000 to 2035."""
    text = F.trim(value)
    return F.coalesce(text.rlike("^\\d{4}$") & F.try_to_number(text, F.lit("9999")).between(2000, 2035), F.lit(False))


def fiscal_period(text: Column) -> Column:
    """The first period phrase of a table's text, by the order of FISCAL; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?i)" + p, 0), F.lit("")) for p in FISCAL])


def is_number(value: Column) -> Column:
    """A cell of data: no header word, no bare year 20xx, a number once %, commas, $ and - are gone."""
    text = F.trim(F.coalesce(value, F.lit("")))
    header = F.lit(False)
    for word in HEADER_WORDS:
        header = header | F.lower(text).contains(word)
    bare = F.trim(F.regexp_replace(text, "[%,$-]", ""))
    return ~header & ~text.rlike("^20\\d{2}$") & bare.rlike("^(\\d+\\.?\\d*|\\.\\d+)$")


def mixed(kinds: Column) -> Column:
    """Whether an array of period kinds holds several besides ``other``."""
    return F.size(F.array_distinct(F.filter(kinds, lambda k: k != "other"))) > 1


#: Words of a label that is a date, and full period codes.
DATED = "months ended|at |as of |q[1-4]-|ytd-|qtd-"
FULL_CODE = "^(Q[1-4]-(QTD|YTD)?-?20\\d{2}|YTD-20\\d{2})$"


def with_periods(labels: Column, codes: Column) -> Column:
    """Each label that is no date before each period code, each combination once; other codes stand alone. Without such labels the codes as they are."""
    plain = F.filter(F.transform(labels, lambda x: F.trim(x)), lambda s: (s != "") & ~F.lower(s).rlike(DATED))
    join = lambda s: F.transform(codes, lambda c: F.when(F.trim(c).rlike(FULL_CODE), F.concat_ws(" ", s, F.trim(c))).otherwise(F.trim(c)))
    crossed = F.array_distinct(F.flatten(F.transform(plain, join)))
    return F.when(F.size(crossed) > 0, crossed).otherwise(codes)


def with_dates(spans: Column, dates: Column) -> Column:
    """Period codes of spans such as ``Three Months Ended`` with each date; spans with a year give their own code, others stay. Each once."""
    from filingloom.functions.period import MONTHS, header_code

    dated = lambda d: d.rlike("^20\\d{2}$") | (F.lower(d).rlike("|".join(m[:3] for m in MONTHS)) & d.rlike("20\\d{2}"))
    bare = lambda s: F.regexp_replace(s, ",+$", "")

    def of(span: Column) -> Column:
        s = F.trim(span)
        period = F.lower(s).rlike("months ended|at |as of ")
        each = F.transform(F.filter(F.transform(dates, lambda x: F.trim(x)), dated), lambda d: header_code(F.concat_ws(" ", bare(s), d)))
        return F.when(period & s.rlike("20\\d{2}"), F.array(header_code(s))).when(period & (F.size(dates) > 0), each).otherwise(F.array(s))

    codes = F.array_distinct(F.filter(F.flatten(F.transform(spans, of)), lambda c: c.isNotNull() & (c != "")))
    return F.when(F.size(codes) > 0, codes).otherwise(spans)
