"""Header rows that lie over each other, as one code a column: cells become tokens, tokens fold down each column, spans run along the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions import headers, titles
from filingloom.functions.period import MONTHS
from filingloom.functions.text import dedupe_words

#: Spans of time by their phrases, first fit wins; heads of a date; how a span is shown.
SPANS = [("three\\s+months?\\s+ended", "QTD"), ("six\\s+months?\\s+ended", "YTD"), ("nine\\s+months?\\s+ended", "YTD"), ("year\\s+ended", "ANNUAL"), ("fiscal\\s+year\\s+ended", "ANNUAL")]
POINT = "^\\s*(at|as\\s+of)\\s+"
#: Headers that are no dates and stay as they are.
KEPT = [
    "\\$\\s*in\\s*(millions?|billions?)", "%\\s*change$", "%$", "change$", "total$", "average$", "high$", "low$", "period\\s+end$", "inflows?$", "outflows?$", "market\\s+impact$",
]
#: Short months, looked for behind the long ones; words of dates; a fiscal quarter; two dates in one header.
SHORT = ["jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"]
DATE_WORDS = ["ended", "at", "as of", "months", "year", "quarter", "fiscal"]
FISCAL = "(?i)^(\\d)Q\\s*(20\\d{2})$"
TWO_DATES = "(at|as\\s+of)\\s+(\\w+)\\s+(\\d+),?\\s*(20\\d{2})\\s+and\\s+(\\w+)\\s+(\\d+),?\\s*(20\\d{2})"
#: Categories whose number is no footnote.
NUMBERED = "(?i)^(level|tier|type|class|category)\\s+\\d+$"


def _once(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _month(low: Column) -> Column:
    """The first month of the lists that a text contains, in full; null without one."""
    full = {m[:3]: m for m in MONTHS} | {"sept": "september"}
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), m) for m in MONTHS], *[F.when(F.contains(low, F.lit(s)), full[s]) for s in SHORT])


def _quarter(month: Column) -> Column:
    """``Q1`` to ``Q4`` of a month's long or short name; null of another word."""
    quarters = {m: f"Q{i // 3 + 1}" for i, m in enumerate(MONTHS)} | {s: f"Q{MONTHS.index(m) // 3 + 1}" for s in SHORT for m in MONTHS if m.startswith(s)}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in quarters.items() for x in kv]), month)


def _year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(20\\d{2})", 1), F.lit(""))


def _plain(cell: Column) -> Column:
    return F.trim(F.coalesce(cell, F.lit("")))


def _unnumbered(text: Column) -> Column:
    """Without a footnote's number at the end."""
    return F.when(F.trim(text).rlike(NUMBERED), F.trim(text)).otherwise(F.regexp_replace(F.trim(text), "\\s+\\d+$", ""))


def _kept(low: Column) -> Column:
    return low.rlike("^(" + "|".join(KEPT) + ")")


def _period(low: Column) -> Column:
    return F.coalesce(*[F.when(low.rlike(p), kind) for p, kind in SPANS])


def token(cell: Column) -> Column:
    """What a cell says, null for a blank one: ``kind`` (code, kept, fiscal, two, text), its text, ``period``, a month and year that it sets, those that it
    gives where none is set, and a ``category``."""

    def of(v: Column) -> Column:
        def with_low(low: Column) -> Column:
            code = F.upper(v).rlike("^(Q[1-4](-(QTD|YTD))?|YTD)-20\\d{2}$")
            digit = F.regexp_extract(v, "^[Qq]([1-4])", 1)
            last = F.when(digit == "", "december").otherwise(F.element_at(F.array(*map(F.lit, MONTHS)), F.coalesce(digit.try_cast("int"), F.lit(4)) * 3))
            code_period = F.when(digit == "", "ANNUAL").otherwise(F.coalesce(F.nullif(F.regexp_extract(F.upper(v), "-(QTD|YTD)-", 1), F.lit("")), F.lit("POINT")))
            kind = F.when(code, "code").when(_kept(low), "kept").when(v.rlike(FISCAL), "fiscal").when(low.rlike(TWO_DATES), "two").otherwise("text")
            point, span = low.rlike(POINT), _period(low)
            dated = low.rlike("20\\d{2}|" + "|".join([*MONTHS, *SHORT, *DATE_WORDS]))
            category = F.when(~dated & (F.length(v) <= 50) & ~v.rlike("^\\d+$"), _unnumbered(v))

            def fields(k: Column) -> Column:
                text = k == "text"
                return F.struct(
                    k.alias("kind"), v.alias("text"),
                    F.when(k == "code", code_period).when(k == "fiscal", F.concat(F.substring(v, 1, 1), F.lit("Q"))).when(k == "two", "COMBINED").when(text & point, "POINT").when(text, span).alias("period"),
                    F.when(k == "code", last).when(text & (point | span.isNotNull()), _month(low)).alias("month"),
                    F.when(k == "code", _year(v)).when(k == "fiscal", F.regexp_extract(v, FISCAL, 2)).when(text & point, _year(v)).alias("year"),
                    F.when(text, _month(low)).alias("other_month"), F.when(text, _year(v)).alias("other_year"), F.when(text, category).alias("category"),
                )

            return _once(kind, fields)

        return _once(F.lower(v), with_low)

    return _once(_plain(cell), lambda v: F.when((v != "") & (F.lower(v) != "nan"), of(v)))


_CONTEXT = "struct<texts:array<string>,period:string,month:string,year:string,category:string,l1:string,dated:boolean>"


def _fold(tokens: Column) -> Column:
    """The context of a column: its tokens from top to bottom."""
    start = F.from_json(F.lit('{"texts": [], "l1": "", "dated": true}'), _CONTEXT)

    def step(c: Column, t: Column) -> Column:
        # A second category moves the first up.
        up = t["category"].isNotNull() & c["category"].isNotNull() & (c["l1"] == "")
        return F.struct(
            F.concat(c["texts"], F.array_repeat(t["text"], F.when(t["kind"] == "two", 2).otherwise(1))).alias("texts"), F.coalesce(t["period"], c["period"]).alias("period"),
            F.coalesce(t["month"], c["month"], t["other_month"]).alias("month"), F.coalesce(t["year"], c["year"], t["other_year"]).alias("year"),
            F.when(up | c["category"].isNull(), F.coalesce(t["category"], c["category"])).otherwise(c["category"]).alias("category"),
            F.when(up, c["category"]).otherwise(c["l1"]).alias("l1"), (c["dated"] & (t["kind"] != "kept")).alias("dated"),
        )

    return F.aggregate(F.filter(tokens, lambda t: t.isNotNull()), start, lambda c, t: step(c, t).cast(_CONTEXT))


_SPAN = "struct<period:string,month:string,year:string>"


def _spans(row: Column) -> Column:
    """For each cell of a row the span that it stands under: that of the last cell up to it that names one; null for blank cells."""

    def own(v: Column) -> Column:
        return _once(F.lower(v), lambda low: F.struct(F.coalesce(_period(low), F.when(low.rlike(POINT), "POINT")).alias("period"), _month(low).alias("month"), _year(v).alias("year")))

    found = F.transform(row, lambda cell: _once(_plain(cell), lambda v: F.when(v != "", own(v)).cast(_SPAN)))
    begin = F.struct(F.lit(None).cast(_SPAN).alias("now"), F.array().cast(f"array<{_SPAN}>").alias("all"))

    def step(a: Column, s: Column) -> Column:
        return _once(F.when(s["period"].isNotNull(), s).otherwise(a["now"]), lambda now: F.struct(now.alias("now"), F.concat(a["all"], F.array(F.when(s.isNotNull(), now))).alias("all")))

    return F.aggregate(found, begin, step, lambda a: a["all"])


def _under(context: Column, spans: Column) -> Column:
    """A context with what the spans over its column add where it has nothing, row by row."""
    first = lambda name: F.get(F.filter(F.transform(spans, lambda s: s[name]), lambda x: x.isNotNull()), F.lit(0))
    return F.struct(*[(F.coalesce(context[n], first(n)) if n in ("period", "month", "year") else context[n]).alias(n) for n in ("texts", "period", "month", "year", "category", "l1", "dated")])


def _along(contexts: Column) -> Column:
    """Contexts with what columns to their left hand on: to columns with a category, a year, or no date."""
    none = F.lit(None).cast("string")
    begin = F.struct(none.alias("p"), none.alias("m"), none.alias("y"), none.alias("c"), F.array().cast(f"array<{_CONTEXT}>").alias("all"))

    def step(a: Column, x: Column) -> Column:
        last = F.struct(F.coalesce(x["period"], a["p"]).alias("p"), F.coalesce(x["month"], a["m"]).alias("m"), F.coalesce(x["year"], a["y"]).alias("y"), F.coalesce(x["category"], a["c"]).alias("c"))

        def give(n: Column) -> Column:
            named, bare = x["category"].isNotNull(), ~x["dated"] & (F.size(x["texts"]) > 0) & n["p"].isNotNull()
            year = F.coalesce(x["year"], F.when(named | bare, n["y"]))
            got = named | bare | F.coalesce(x["year"], F.when(named, n["y"])).isNotNull()
            out = F.struct(
                x["texts"].alias("texts"), F.coalesce(x["period"], F.when(got, n["p"])).alias("period"), F.coalesce(x["month"], F.when(got, n["m"])).alias("month"), year.alias("year"),
                F.coalesce(x["category"], F.when(x["year"].isNotNull(), n["c"])).alias("category"), x["l1"].alias("l1"), x["dated"].alias("dated"),
            )
            return F.struct(n["p"].alias("p"), n["m"].alias("m"), n["y"].alias("y"), n["c"].alias("c"), F.concat(a["all"], F.array(out.cast(_CONTEXT))).alias("all"))

        return _once(last, give)

    return F.aggregate(contexts, begin, step, lambda a: a["all"])


def _coded(x: Column, source: Column) -> Column:
    """(code, l1, l2, l3) of a context."""
    out = lambda code, l1="", l2="", l3="": F.struct(*[F.coalesce(c if isinstance(c, Column) else F.lit(c), F.lit("")).alias(n) for n, c in zip(("code", "l1", "l2", "l3"), (code, l1, l2, l3), strict=True)])
    texts, quarter, year = x["texts"], _quarter(x["month"]), x["year"]
    both = F.lower(F.array_join(texts, " "))
    kept = F.coalesce(F.get(F.filter(F.transform(texts, lambda t: F.lower(t)), _kept), F.lit(0)), F.lower(F.get(texts, F.lit(0))))
    spanned = F.concat_ws("-", quarter, F.when(x["period"].isin("QTD", "YTD"), x["period"]), year)
    undated = F.when(F.size(texts) == 0, out("")).when((F.size(texts) == 2) & both.isin("% change", "change %"), out("% change", l3="% change")).otherwise(
        F.when(x["period"].isNotNull() & quarter.isNotNull() & year.isNotNull(), out(F.concat_ws(" ", spanned, titles.title_letters(kept)), l3=spanned)).otherwise(out(kept, l3=kept))
    )
    two = F.get(F.filter(F.transform(texts, lambda t: F.lower(t)), lambda t: t.rlike(TWO_DATES)), F.lit(0))
    part = lambda i: F.regexp_extract(two, TWO_DATES, i)
    at = lambda m, y: F.concat(F.coalesce(_quarter(part(m)), F.lit("Q4")), F.lit("-"), part(y))
    combined = F.concat_ws(" ", at(2, 4), F.lit("&"), at(5, 7), x["category"])
    fiscal = x["period"].rlike("^\\dQ$")
    bare = F.when(x["category"].isNotNull(), _once(dedupe_words(F.coalesce(x["category"], F.lit(""))), lambda c: out(c, x["l1"], "", c))).otherwise(out(dedupe_words(_unnumbered(F.coalesce(F.get(texts, F.lit(0)), F.lit(""))))))
    parts = {"POINT": F.concat_ws("-", quarter, year), "QTD": F.concat_ws("-", quarter, F.lit("QTD"), year), "YTD": F.concat_ws("-", quarter, F.lit("YTD"), year)}
    code = F.when(x["period"] == "ANNUAL", F.concat(F.lit("YTD-"), year)).when(x["period"].isNull(), headers.year_to_period(year, source))
    for kind, made in parts.items():
        code = F.when((x["period"] == kind) & quarter.isNotNull() & year.isNotNull(), made).otherwise(code)
    shown = F.when(x["period"] == "QTD", "Three Months Ended").when(x["period"] == "YTD", F.when(quarter == "Q2", "Six Months Ended").otherwise("Nine Months Ended")).when(x["period"] == "ANNUAL", "Year Ended")
    dated = _once(code, lambda c: out(dedupe_words(F.when(F.coalesce(c, F.lit("")) != "", F.concat_ws(" ", c, x["category"])).otherwise("")), x["l1"], shown, year))
    return (
        F.when(~x["dated"], undated).when(fiscal, out(F.concat_ws("-", x["period"], year), "", x["period"], year)).when((x["period"] == "COMBINED") & two.isNotNull(), out(combined, x["l1"], "", combined))
        .when(quarter.isNull() & year.isNull(), bare).otherwise(dated)
    )


def normalise_headers(tables: DataFrame, rows: str, source: str) -> DataFrame:
    """``tables`` with ``normalized_headers``, ``l1_headers``, ``l2_headers``, ``l3_headers`` of the header rows (an array of arrays, top to bottom).

    Each column's tokens fold from top to bottom into a period, month, year, category
    and what stands over it. Spans that begin in a cell of a row hold for the filled
    cells to its right, and what is missing still comes from the columns to the left.
    A context then gives ``Q2-QTD-2024``, ``Q3-YTD-2024``, ``Q1-2025``, ``YTD-2023``, ``4Q-2024``, two codes joined by
    ``&``, or a text that is no date; a category follows. A year alone takes its code from the ``source``'s name.

    Rows may differ in length; no rows give empty arrays; null and blank cells, and ``nan``, say nothing.
    """
    each = F.coalesce(F.col(rows), F.array().cast("array<array<string>>"))
    width = F.coalesce(F.array_max(F.transform(each, F.size)), F.lit(0))
    cells = tables.withColumns({"_rows": each, "_columns": F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))})
    staged = cells.withColumns({"_tokens": F.transform("_rows", lambda r: F.transform(r, token)), "_spans": F.transform("_rows", _spans)})
    column = lambda grid, i: F.transform(F.col(grid), lambda r: F.get(r, i))
    staged = staged.withColumn("_contexts", F.transform("_columns", lambda i: _once(_fold(column("_tokens", i)), lambda c: _under(c, F.filter(column("_spans", i), lambda s: s.isNotNull())))))
    staged = staged.withColumn("_contexts", _along(F.col("_contexts")))
    done = staged.withColumn("_coded", F.transform("_contexts", lambda x: _coded(x, F.coalesce(F.col(source), F.lit("")))))
    names = {"code": "normalized_headers", "l1": "l1_headers", "l2": "l2_headers", "l3": "l3_headers"}
    return done.select(*tables.columns, *[F.col(f"_coded.{n}").alias(name) for n, name in names.items()])


#: First cells of rows that are no headers, and words of each kind of header row, first fit wins.
NO_HEADERS = ("Source", "source", "←", "Row Label", "Category", "Line Items")
ROW_WORDS = [
    ("CUMULATIVE", "three months|six months|nine months|months ended|quarter ended"), ("ANNUAL", "year ended|fiscal year|years ended"), ("L1", "average monthly|balance|total assets|other assets"),
    ("POINT", "at march|at june|at september|at december|as of|december 31|march 31|june 30|september 30"),
]


def structure_pattern(rows: Column) -> Column:
    """``L1_L2_L3``, ``L2_L3`` or ``L3_ONLY`` and, behind ``::``, the periods' family, by the first other cell of the first five rows."""

    def kind(r: Column) -> Column:
        first = _plain(F.get(r, F.lit(0)))
        others = F.filter(F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r), F.lit(1))), _plain), lambda v: v != "")
        sample = F.lower(F.get(others, F.lit(0)))
        skipped = F.greatest(*[first.startswith(h) for h in NO_HEADERS])
        return F.when(~skipped, F.coalesce(*[F.when(sample.rlike(p), name) for name, p in ROW_WORDS]))

    def pattern(kinds: Column) -> Column:
        spans = F.filter(kinds, lambda k: k.isin("CUMULATIVE", "ANNUAL"))
        # A date gives the family only where none is known yet; a span always does.
        last = F.coalesce(F.element_at(F.when(F.size(spans) > 0, spans), -1), F.when(F.array_contains(kinds, "POINT"), "POINT_IN_TIME"))
        base = F.when(F.size(spans) > 0, F.when(F.array_contains(kinds, "L1"), "L1_L2_L3").otherwise("L2_L3")).otherwise("L3_ONLY")
        return F.concat(base, F.lit("::"), F.coalesce(last, F.lit("POINT_IN_TIME")))

    known = _once(F.filter(F.transform(F.slice(rows, 1, 5), kind), lambda k: k.isNotNull()), pattern)
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 2, "UNKNOWN::UNKNOWN").otherwise(known)
