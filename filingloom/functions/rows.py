"""Kinds and formats of rows and cells, and their repair; rows are arrays of cell texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingloom.functions import currency, headers, period, text, titles

#: Words of a metadata row, of dates in a header row, of a header inside a table, and of units.
METADATA = ["column header", "row header", "year/quarter", "year(s):", "table title:", "source:", "product/entity:"]
DATE_WORDS = ["three months ended", "six months ended", "nine months ended", "twelve months ended", "fiscal year ended", "year ended"] + [f"at {m}" for m in period.MONTHS]
NEW_HEADER = DATE_WORDS + ["quarter ended", "as of march", "as of june", "as of september", "as of december", "for the period", "for the year", "for the quarter", "ytd-20"]
NEW_HEADER += [f"q{q}-{span}-" for q in (1, 2, 3, 4) for span in ("qtd", "ytd")]
UNITS = [
    "$ in million", "$ in billion", "$ in thousand", "in millions", "in billions", "in thousands", "dollars in millions", "dollars in billions",
    "(in millions)", "(in billions)", "(in thousands)", "amounts in millions", "amounts in billions",
]
SPANS = ["three months ended", "six months ended", "nine months ended", "year ended", "at ", "as of ", "for the period"]
#: Labels of percentage rows: whole ones, and words of them.
RATIOS = ["roe", "roa", "rotce", "tier 1 capital ratio", "cet1 ratio", "leverage ratio", "efficiency ratio", "expense efficiency ratio"]
RATIO_WORDS = ["ratio", "yield", "rate", "as a percentage", "percent"]
#: Cells that hold no value.
NO_VALUE = ["n/a", "-", "—", "nm", "n.a.", ""]


def _has_any(text: Column, words: list[str]) -> Column:
    low, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))


def _filled(cells: Column) -> Column:
    """The trimmed cells that are not blank."""
    return F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")


def _behind(cells: Column) -> Column:
    return F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1)))


def valid_header(header: Column) -> Column:
    """Whether a column may have this header: no number but a period, four digits, a range or a small decimal; false for none."""
    t = F.trim(header)
    bare = F.regexp_replace(t, "[,.-]", "")
    ranged = t.rlike("^[<>]?\\d+(-\\d+)?$") | (t.rlike("^\\d+\\.\\d+$") & (t.try_cast("double") < 1000))
    fits = (t == "") | F.lower(t).isin("row label", "% change", "nan", "none") | (period.kind(t) != "other") | ranged | ~(bare.rlike("^\\d+$") & (F.length(bare) != 4))
    return F.coalesce((header != "") & fits, F.lit(False))


def embedded_header(cells: Column) -> Column:
    """Whether a row inside a table is a header: its label names metadata, a period or a year, or all its other cells are dates or years."""
    label = F.lower(F.trim(F.coalesce(F.get(cells, F.lit(0)), F.lit(""))))
    others = _filled(_behind(cells))
    dated = lambda c: headers.is_year(c) | _has_any(c, DATE_WORDS) | (F.lower(c) == "nan")
    return _has_any(label, METADATA + DATE_WORDS) | headers.is_year(label) | ((F.size(others) > 0) & F.forall(others, dated))


def new_table(cells: Column) -> Column:
    """Whether a row begins another table: its first cell is empty or a unit, and others name periods."""
    first = F.lower(F.trim(F.coalesce(F.get(cells, F.lit(0)), F.lit(""))))
    return (first.isin("", "nan", "none") | _has_any(first, UNITS)) & _has_any(F.array_join(_filled(_behind(cells)), " "), NEW_HEADER)


def voted_header(cells: Column) -> Column:
    """Whether a row is a header: it has two cells at least, its first is no number of three digits or more but a year's,
    and numbers of that length don't outnumber texts and years (one number alone never does)."""
    digits = lambda c, drop: F.regexp_replace(c, drop, "")
    first = F.trim(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))
    lead = digits(first, "[,.$%-]")
    data = lead.rlike("^\\d{3,}$") & ~F.coalesce(lead.try_cast("long").between(1900, 2100), F.lit(False))
    others = F.transform(_filled(_behind(cells)), lambda c: digits(c, "[,.$% -]"))
    year = lambda c: c.rlike("^\\d{4}$") & F.coalesce(c.try_cast("int").between(1990, 2100), F.lit(False))
    numbers = F.size(F.filter(others, lambda c: c.rlike("^\\d{3,}$") & ~year(c)))
    texts = F.size(others) - numbers
    return F.coalesce((F.size(cells) >= 2) & ~data & ~((numbers > texts) & (numbers > 1)) & ((texts > 0) | (first == "")), F.lit(False))


def spanning(cells: Column) -> Column:
    """Whether a row spans columns: under 30% of its cells are filled, or under half and one names a period."""
    share = F.size(_filled(cells)) / F.size(cells)
    return (F.size(cells) > 0) & ((share < 0.3) | ((share < 0.5) & _has_any(F.array_join(cells, "\n"), SPANS)))


def percent_row(values: Column) -> Column:
    """Whether all numbers of a row lie within -1 and 1 and one isn't zero."""
    there = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.forall(there, lambda v: F.abs(v) <= 1) & F.exists(there, lambda v: v != 0)


def table_format(head: Column) -> Column:
    """(type, unit, exceptions) by a table's first header."""
    low = F.lower(F.coalesce(head, F.lit("")))
    money = low.contains("$") | low.contains("dollar")
    unit = F.when(money & low.contains("billion"), "billions").when(money & low.contains("million"), "millions")
    return F.struct(F.when(money, "currency").otherwise("number").alias("type"), unit.alias("unit"), (money & low.contains("except")).alias("exceptions"))


def column_format(name: Column) -> Column:
    return F.when(_has_any(name, ["%", "change"]), "percentage").otherwise("default")


def row_format(label: Column) -> Column:
    """percentage for ratios, yields, rates and margins that are no lending's; else currency."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    ratio = low.isin(RATIOS) | low.rlike(f"({'|'.join(RATIO_WORDS)}|margin)$") | low.rlike(f"\\b({'|'.join(RATIO_WORDS)})\\b")
    margin = low.rlike("\\b(pre-tax|net|operating|profit|interest)\\s+margin\\b") & ~low.rlike("\\bmargin\\s+(and|lending|loan|balance)")
    return F.when(ratio | margin, "percentage").otherwise("currency")


def cell_value(cell: Column, first: Column) -> Column:
    """(text, value, format) of a cell: the first one of a row is a label, others percentages (as shares), amounts or texts."""
    t = F.trim(F.coalesce(cell, F.lit("")))
    share = F.regexp_replace(t, "[%,]", "").try_cast("double") / 100
    amount = currency.parse(t)
    empty = F.lower(t).isin(NO_VALUE)
    value = F.when(empty | first, None).when(t.contains("%"), F.coalesce(share, amount)).otherwise(amount)
    form = F.when(value.isNull(), None).when(t.contains("%") & share.isNotNull(), "percent").when(value < 0, "negative").otherwise("currency")
    shown = F.when(empty, cell).when(first, text.footnotes(titles.mend_words(t))["clean"]).otherwise(t)
    return F.struct(shown.alias("text"), value.alias("value"), form.alias("format"))


def split_cell(cell: Column) -> Column:
    """The cells of which one was made: ``$10,207 $ 2,762`` holds two amounts, ``Loans 5 7`` a label and two; dates and other texts stay whole."""
    t, low = F.trim(cell), F.lower(F.trim(cell))
    dated = (low.rlike("|".join(period.MONTHS)) & low.rlike("\\b20[0-3]\\d\\b")) | low.startswith("at ") | low.startswith("as of ")
    labelled = "^([A-Za-z][A-Za-z\\s]*?)\\s+(\\$?\\s*[\\d,()\\-]+(?:\\s+\\$?\\s*[\\d,()\\-]+)+)\\s*$"
    values = F.regexp_extract_all(F.regexp_extract(t, labelled, 2), F.lit("\\$?\\s*[\\d,]+(?:\\.\\d+)?|\\$?\\s*\\([\\d,]+(?:\\.\\d+)?\\)"), F.lit(0))
    values = F.filter(F.transform(values, lambda v: F.regexp_replace(F.trim(v), "\\$\\s+", "\\$")), lambda v: v != "")
    amounts = F.regexp_extract_all(t, F.lit("\\$?\\s*([\\d,]+(?:\\.\\d+)?)"), F.lit(1))
    return (
        F.when(dated, F.array(t)).when(t.rlike(labelled) & (F.size(values) >= 2), F.concat(F.array(F.trim(F.regexp_extract(t, labelled, 1))), values))
        .when(~t.rlike("[a-zA-Z]") & t.contains("$") & (F.size(amounts) >= 2), F.transform(amounts, lambda a: F.concat(F.lit("$"), a))).otherwise(F.array(t))
    )


def repair_cells(cells: Column) -> Column:
    """A row's cells with those of several amounts split, ``$ 10`` as ``$10``, and no remains such as ``12,``."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\\$\\s*$", ""), "\\$\\s+(\\d)", "\\$$1"), "\\s+", " "))
    return F.filter(F.transform(F.flatten(F.transform(cells, split_cell)), plain), lambda c: ~c.rlike("^[\\d\\s,]+,$"))


def repeated_label(cells: Column) -> Column:
    """A row whose first cell doubles its text, in itself or in the second cell, with one of the two and a blank in place of the other; numbers stay."""
    first, second = F.trim(F.get(cells, F.lit(0))), F.trim(F.get(cells, F.lit(1)))
    half = text.halve(first)
    rest = F.slice(cells, F.lit(3), F.greatest(F.size(cells), F.lit(1)))
    doubled = (second == first) & (F.length(first) > 3) & ~F.regexp_replace(first, "[,.$%]", "").rlike("^\\d+$")
    return F.when(F.size(cells) < 2, cells).when(half != first, F.concat(F.array(half, F.lit("")), _behind(cells))).when(doubled, F.concat(F.array(F.get(cells, F.lit(0)), F.lit("")), rest)).otherwise(cells)


def has_data(headers_: Column, values: Column) -> Column:
    """Whether a column (its header and cells) holds a value that is not the header, a unit or a year."""
    unit = lambda v: v.startswith("$") & F.lower(v).contains("in")
    return F.exists(_filled(values), lambda v: (v != headers_) & (F.lower(v) != "nan") & ~unit(v) & ~v.rlike("^20\\d{2}$"))
