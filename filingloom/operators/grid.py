"""Table blocks in raw sheet grids: rows in order, without a header.

``first`` is the text of a row's first column and ``cells`` the whole row
(array<string>). A sheet (``keys``) is the unit that windows sort; sheets are
bounded by their format, so many sheets spread over many tasks. Null cells
count as empty, a sheet without markers gives no rows, and other columns pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heads of metadata rows, and the column that each fills.
TITLE = "Table Title:"
BACK = "← Back to Index"
LABELS = {
    "Category (Parent):": "Category_Parent", "Line Items:": "Line_Items", "Product/Entity:": "Product_Entity", "Column Header L1:": "Column_Header_L1",
    "Column Header L2:": "Column_Header_L2", "Column Header L3:": "Column_Header_L3", "Year/Quarter:": "Year_Quarter", "Table Title:": "Table_Title_Metadata",
    "Source(s):": "Sources_Metadata", "Source:": "Sources_Metadata", "Sources:": "Sources_Metadata",
}
#: First cells that head a table of amounts.
UNIT_HEAD = "^\\(?(\\$ )?in (millions|billions|thousands)"
#: Period texts of a header row.
PERIOD_HEAD = "(three|six|nine|twelve) months ended|(fiscal )?year ended|quarter ended|(at|as of) (january|february|march|april|may|june|july|august|september|october|november|december)|for the (period|year|quarter)"
#: Labels of key-value tables.
PAIR_LABELS = ["announcement date", "record date", "payment date", "amount per share", "total amount", "quarter ended", "fiscal year", "company name", "ticker symbol", "exchange", "industry", "sector"]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _starts(c: Column, heads: Sequence[str]) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | c.startswith(h)
    return out


def _cell(cells: str, i: int) -> Column:
    return F.trim(_text(F.get(F.col(cells), F.lit(i))))


def _marked(grid: DataFrame, first: str) -> DataFrame:
    a = _text(F.col(first))
    meta = _starts(a, [BACK, *LABELS])
    return grid.select("*", meta.alias("_meta"), (~meta & (F.trim(a) != "")).alias("_data"), a.startswith(TITLE).alias("_title"), _starts(a, ["Source(s):", "Source:", "Sources:"]).alias("_source"))


def _running(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def table_rows(grid: DataFrame, keys: Sequence[str], order: Sequence[str], first: str, reach: int = 4) -> DataFrame:
    """Data rows of each titled table, with ``table_no`` (from 1 in a sheet).

    A table's metadata ends at the first source row within ``reach`` rows after
    its title, else at the title. Its data are the rows from the first data row
    after that to the last before the next metadata row or the end; blank rows
    within stay. A title without data of its own gives no rows.
    """
    on = _running(keys, order)
    numbered = _marked(grid, first).withColumn("table_no", F.sum(F.col("_title").cast("int")).over(on)).where("table_no > 0")
    title = [*keys, "table_no"]
    at = numbered.withColumn("_pos", F.row_number().over(Window.partitionBy(*title).orderBy(*order))).withColumn("_seg", F.sum(F.col("_meta").cast("int")).over(_running(title, order)))
    ends = F.min(F.when(F.col("_source") & (F.col("_pos") > 1) & (F.col("_pos") <= reach + 1), F.col("_pos"))).over(Window.partitionBy(*title))
    ended = at.withColumn("_end", F.coalesce(ends, F.lit(1)))
    real = F.col("_data") & (F.col("_pos") > F.col("_end"))
    begun = ended.withColumn("_own", F.min(F.when(real, F.col("_seg"))).over(Window.partitionBy(*title))).where("_seg = _own AND _pos > _end")
    span = Window.partitionBy(*title)
    place = F.when(F.col("_data"), F.col("_pos"))
    spanned = begun.withColumn("_lo", F.min(place).over(span)).withColumn("_hi", F.max(place).over(span))
    return spanned.where("_pos BETWEEN _lo AND _hi").drop("_meta", "_data", "_title", "_source", "_pos", "_seg", "_end", "_own", "_lo", "_hi")


def sub_tables(tables: DataFrame, keys: Sequence[str], order: Sequence[str], first: str, least: int = 2) -> DataFrame:
    """Splits a table at its unit rows (``$ in millions``): adds ``sub_no``, 0 for an undivided one.

    Only where two or more parts have ``least`` rows up to their last non-blank
    row; rows before the first unit row and shorter parts then go.
    """
    a = F.trim(_text(F.col(first)))
    own = [*keys, "_sub"]
    numbered = tables.withColumn("_unit", F.lower(a).rlike(UNIT_HEAD)).withColumn("_sub", F.sum(F.col("_unit").cast("int")).over(_running(keys, order)))
    at = numbered.withColumn("_pos", F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    sized = at.withColumn("_hi", F.max(F.when(a != "", F.col("_pos"))).over(Window.partitionBy(*own)))
    valid = F.col("_unit") & (F.col("_hi") >= least)
    parted = sized.withColumn("_parts", F.sum(valid.cast("int")).over(Window.partitionBy(*keys)))
    kept = parted.where((F.col("_parts") < 2) | ((F.col("_sub") > 0) & (F.col("_hi") >= least) & (F.col("_pos") <= F.col("_hi"))))
    return kept.withColumn("sub_no", F.when(F.col("_parts") < 2, 0).otherwise(F.col("_sub"))).drop("_unit", "_sub", "_pos", "_hi", "_parts")


def metadata(grid: DataFrame, keys: Sequence[str], order: Sequence[str], first: str, cells: str) -> DataFrame:
    """One row per titled table: ``table_no`` and a column per metadata label, the last one's value wins.

    The metadata of a table are the metadata rows around its title with no data
    row between. A value is the rest of the first cell and the other non-empty
    cells, joined by ``, ``; ``Column_Header`` joins the three levels by `` | ``.
    """
    on = _running(keys, order)
    counted = _marked(grid, first).withColumn("_title_no", F.sum(F.col("_title").cast("int")).over(on)).withColumn("_run", F.sum(F.col("_data").cast("int")).over(on))
    run = Window.partitionBy(*keys, "_run")
    ours = counted.withColumn("_has", F.max(F.col("_title").cast("int")).over(run)).withColumn("table_no", F.max("_title_no").over(run)).where("_has = 1 AND _meta")
    a, rest = _text(F.col(first)), F.transform(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda c: F.trim(_text(c)))
    found, at = [], F.struct(*order)
    for column in dict.fromkeys(LABELS.values()):
        heads = [h for h, c in LABELS.items() if c == column]
        tail = F.lit("")
        for h in heads:
            tail = F.when(a.startswith(h), F.trim(F.substr(a, F.lit(len(h) + 1)))).otherwise(tail)
        value = F.array_join(F.filter(F.concat(F.array(tail), rest), lambda c: c != ""), ", ")
        found.append(F.max_by(F.when(_starts(a, heads), value), F.when(_starts(a, heads), at)).alias(column))
    out = ours.groupBy(*keys, "table_no").agg(*found)
    levels = F.filter(F.array("Column_Header_L1", "Column_Header_L2", "Column_Header_L3"), lambda x: x != "")
    return out.withColumn("Column_Header", F.array_join(levels, " | "))


def header_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cells: str, most: int = 4) -> DataFrame:
    """``is_header``: among a table's first ``most`` rows, before the first labelled row, those with an empty first cell and others filled, or headed by a unit, a period or a year."""
    a = F.lower(_cell(cells, 0))
    filled = F.size(F.filter(cells, lambda c: F.trim(_text(c)) != "")) > 0
    headed = a.rlike(UNIT_HEAD) | a.rlike(PERIOD_HEAD) | a.rlike("^\\d{4}$")
    label = (a != "") & ~headed
    broken = F.max(label.cast("int")).over(_running(keys, order))
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("is_header", (pos <= most) & (broken == 0) & filled)


def split_on_headers(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cells: str) -> DataFrame:
    """``part_no`` (from 0): a row with an empty first cell and a period text in another one, after a labelled row, opens a part."""
    a = _cell(cells, 0)
    labelled = ~F.lower(a).isin("", "nan", "none")
    others = F.lower(F.array_join(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), " "))
    seen = rows.withColumn("_seen", F.max(labelled.cast("int")).over(_running(keys, order)))
    opens = (F.col("_seen") == 1) & ~labelled & F.coalesce(others, F.lit("")).rlike(PERIOD_HEAD)
    return seen.withColumn("part_no", F.sum(opens.cast("int")).over(_running(keys, order))).drop("_seen")


def row_labels(rows: DataFrame, keys: Sequence[str], order: Sequence[str], first: str) -> DataFrame:
    """Ordered lower-case row labels of each table."""
    a = F.lower(F.trim(_text(F.col(first))))
    kept = rows.select(*keys, F.struct(*order, a.alias("_label")).alias("_at")).where(~F.col("_at._label").isin("", "nan", "none"))
    return kept.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("_at")), lambda x: x["_label"]).alias("labels"))


def until_blanks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], first: str) -> DataFrame:
    """Rows of a block before its first two blank rows in succession."""
    blank = F.trim(_text(F.col(first))) == ""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = rows.withColumn("_blank", blank)
    pair = F.col("_blank") & (F.coalesce(F.lead("_blank").over(w), F.lit(False)))
    paired = flagged.withColumn("_pair", pair)
    return paired.withColumn("_over", F.max(F.col("_pair").cast("int")).over(_running(keys, order))).where("_over = 0").drop("_blank", "_pair", "_over")


def key_value_sheets(grid: DataFrame, keys: Sequence[str], order: Sequence[str], cells: str, rows: int = 7) -> DataFrame:
    """``is_key_value`` of each sheet: 2 points or more in its first ``rows`` rows; a known label gives 1, a second cell without a third 0.5."""
    a, b, c = (_cell(cells, i) for i in range(3))
    known = F.lit(False)
    for w in PAIR_LABELS:
        known = known | F.lower(a).contains(w)
    points = F.when((a != "") & (b != ""), F.when(known, 1.0).otherwise(0.0) + F.when(c == "", 0.5).otherwise(0.0)).otherwise(0.0)
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    top = grid.select(*keys, points.alias("_points"), pos.alias("_pos")).where(F.col("_pos") <= rows)
    return top.groupBy(*keys).agg((F.sum("_points") >= 2).alias("is_key_value"))


def key_value_pairs(grid: DataFrame, keys: Sequence[str], order: Sequence[str], cells: str, rows: int = 20) -> DataFrame:
    """(``key``, ``value``) of the first ``rows`` rows of each sheet that have both."""
    a, b = _cell(cells, 0), _cell(cells, 1)
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return grid.select(*keys, a.alias("key"), b.alias("value"), pos.alias("_pos")).where((F.col("_pos") <= rows) & (F.col("key") != "") & (F.col("value") != "")).drop("_pos")


def flatten_headers(levels: Sequence[Column]) -> Column:
    """One array of column names from header rows, top first: a blank of an upper row takes the cell to its left, repeated texts of a column count once."""

    def spread(row: Column) -> Column:
        def step(acc, c):
            left = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
            return F.concat(acc, F.array(F.when(F.trim(_text(c)) == "", left).otherwise(F.trim(c))))

        return F.aggregate(row, F.array().cast("array<string>"), step)

    rows = [spread(r) for r in levels[:-1]] + [F.transform(levels[-1], lambda c: F.trim(_text(c)))]
    names = F.transform(rows[0], lambda c: F.array(_text(c)))
    for r in rows[1:]:
        names = F.zip_with(names, r, lambda n, c: F.concat(F.coalesce(n, F.array(F.lit(""))), F.array(_text(c))))
    return F.transform(names, lambda n: F.array_join(F.array_distinct(F.filter(n, lambda c: c != "")), " "))


#: Levels of a section, outermost first.
LEVELS = ["toc", "main", "section1", "section2", "section3", "section4"]


def section_levels(headings: DataFrame, keys: Sequence[str], order: Sequence[str], level: str, text: str) -> DataFrame:
    """Open sections at each heading: a column per level of LEVELS, empty if none.

    A heading closes those of deeper levels; ``main`` closes none, as it is
    repeated over pages. Other values of ``level`` change nothing.
    """
    on = _running(keys, order)
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = headings.withColumn("_pos", pos)
    for k, name in enumerate(LEVELS):
        closers = [n for n in LEVELS[:k] if n != "main"]
        last = F.max(F.when(F.col(level) == name, F.struct("_pos", F.col(text).alias("t")))).over(on)
        closed = F.max(F.when(F.col(level).isin(closers), F.col("_pos"))).over(on) if closers else F.lit(0)
        out = out.withColumn(name, F.when(last["_pos"] > F.coalesce(closed, F.lit(0)), last["t"]).otherwise(F.lit("")))
    return out.drop("_pos")
