"""Tables as wholes: why one is empty, its index rows, period parts, hierarchy, names, and the table on its side."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from filingloom.functions import currency, period, titles

#: Words of a sheet's metadata rows.
SHEET_HEADS = ["Category", "Line Items", "Product/Entity", "Column Header", "Year/Quarter", "Table Title", "Source", "← Back to Index"]
#: The part of a split table that holds a kind of period.
PARTS = {"point_in_time": 1, "period_based": 2, "annual_ytd": 3, "annual": 3}


def _upto(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def diagnose(tables: DataFrame, cells: DataFrame, processed: DataFrame, keys: Sequence[str], column: str, value: str) -> DataFrame:
    """``rows`` and ``processed`` rows of each table, and for empty results a ``reason``.

    ``cells`` hold a row per cell (``column`` from 0, null for an empty ``value``), ``processed`` a row per row kept.
    Without cells it is empty_input; under 5% numbers metadata_only; with labels and under 10% of other cells
    all_headers; else filtered_out.
    """
    there = F.col(value).isNotNull()
    facts = cells.groupBy(*keys).agg(
        F.count("*").alias("_cells"), F.count_if(F.col(column) == 0).alias("rows"), F.count_if(F.col(value).try_cast("double").isNotNull()).alias("_numbers"),
        F.count_if(there & (F.col(column) == 0)).alias("_labels"), F.count_if(there & (F.col(column) > 0)).alias("_others"), F.max(column).alias("_behind"),
    )
    joined = tables.join(facts, list(keys), "left").join(processed.groupBy(*keys).agg(F.count("*").alias("processed")), list(keys), "left")
    joined = joined.na.fill(0, ["rows", "processed", "_cells", "_numbers", "_labels", "_others", "_behind"])
    headed = (F.col("_behind") > 0) & (F.col("_labels") > 0) & (F.col("_others") < 0.1 * F.col("_labels") * F.col("_behind"))
    reason = (
        F.when(F.col("processed") > 0, None).when(F.col("_cells") == 0, "empty_input").when(F.col("_numbers") < 0.05 * F.col("_cells"), "metadata_only")
        .when(headed, "all_headers").otherwise("filtered_out")
    )
    return joined.select(*keys, "rows", "processed", reason.alias("reason"))


def near_empty(grid: DataFrame, keys: Sequence[str], cells: str, least: int = 3) -> DataFrame:
    """Sheets with fewer than ``least`` rows that are neither blank nor metadata."""
    first = F.coalesce(F.get(F.col(cells), F.lit(0)), F.lit(""))
    heads = F.greatest(F.lit(False), *[F.contains(first, F.lit(h)) for h in SHEET_HEADS])
    filled = F.exists(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    return grid.groupBy(*keys).agg(F.count_if(filled & ~heads).alias("rows")).where(F.col("rows") < least)


def _greedy(index: list[tuple], tables: list[tuple]) -> list[tuple]:
    """Links (at, table's at) of one sheet: each index row, in order, takes the first free table of its title, else the first free one."""
    plain = lambda t: (t or "").strip().lower()
    free = [(at, plain(t)) for at, t in tables]
    links = []
    for at, title in index:
        name = plain(title)
        alike = next((i for i, (_, t) in enumerate(free) if name == t or (len(name) > 5 and name in t) or (len(t) > 5 and t in name)), 0) if name else 0
        links.append((at, free.pop(alike)[0] if free else None))
    # What is left hangs on the last row, so no table is lost.
    return links + ([(index[-1][0], t) for t, _ in free] if index else [])


def _greedy_sheets(sheet: pa.DataType):
    """``_greedy`` for batches of sheets: a row has a sheet with its sorted index rows and tables."""
    plain = lambda rows: [(r["at"], r["title"]) for r in rows or ()]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            links = [(name, *x) for name, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in _greedy(plain(a), plain(b))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], t) for k, t in enumerate((sheet, pa.int64(), pa.int64()))], names=["sheet", "at", "table_at"])

    return batches


def enhanced_index(index: DataFrame, tables: DataFrame) -> DataFrame:
    """Which table each index row describes: (sheet, at, table_at); both sides hold sheet, at and title.

    With as many tables as rows they meet by position. Else each row takes, in
    order, the first free table of an equal or containing title, or the first
    free one; rows beyond the tables have null, tables beyond the rows the last
    row. Rows without a sheet and tables of sheets without index rows go.
    """
    # New names for the columns, as both sides may stem from one table.
    tables = tables.select(*[F.col(c).alias(c) for c in ("sheet", "at", "title")])
    w = Window.partitionBy("sheet")
    number = lambda df: df.where("sheet IS NOT NULL").select("sheet", F.col("at").cast("long").alias("at"), "title", F.row_number().over(w.orderBy("at")).alias("_n"), F.count("*").over(w).alias("_of"))
    left, right = number(index), number(tables)
    even = left.join(right.select("sheet", "_n", "_of", F.col("at").alias("table_at")), ["sheet", "_n", "_of"]).select("sheet", "at", "table_at")
    # Sheets are rows of their lists, as a Python call for each sheet costs more than its links.
    lists = lambda df, n: df.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct(F.isnull("at").alias("none"), "at", "title"))).alias(n))
    both = lists(left, "rows").join(lists(right, "tables"), "sheet", "left")
    uneven = both.where(F.size("rows") != F.coalesce(F.size("tables"), F.lit(0)))
    schema = StructType([left.schema["sheet"], left.schema["at"]]).add("table_at", "long")
    return even.unionByName(uneven.mapInArrow(_greedy_sheets(to_arrow_type(left.schema["sheet"].dataType)), schema))


def compare_columns(df: DataFrame, label: str, first: str, second: str) -> DataFrame:
    """The label, the first columns whose names the two patterns match, and their ``Change`` and ``Change %``; cells are amounts as texts."""
    import re

    find = lambda p: next((c for c in df.columns if re.search(p, c)), None)
    a, b = find(first), find(second)
    if a is None or b is None:
        raise ValueError(f"no columns for {first} and {second}")
    x, y = currency.parse(F.col(f"`{a}`")), currency.parse(F.col(f"`{b}`"))
    return df.select(label, x.alias(first), y.alias(second), (x - y).alias("Change"), (F.try_divide(x - y, F.abs(y)) * 100).alias("Change %"))


def children(parents: DataFrame, rows: DataFrame, label: str, parent: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose parent is one of the found rows."""
    heads = parents.select(*keys, F.col(label).alias(parent)).distinct()
    return rows.join(heads, [*keys, parent], "left_semi")


def period_parts(columns: DataFrame, keys: Sequence[str], header: str) -> DataFrame:
    """``part`` of each column: null if its table has one kind of period, else 1 for points in time, 2 for spans, 3 for years.

    Columns of no period stand in every part of a table that is split.
    """
    parts = F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv])
    own = columns.withColumn("_p", F.try_element_at(parts, period.kind(F.col(header))))
    found = own.groupBy(*keys).agg(F.array_sort(F.collect_set("_p")).alias("_all"))
    mine = F.when(F.size("_all") < 2, F.array(F.lit(None).cast("int"))).when(F.col("_p").isNull(), F.col("_all")).otherwise(F.array("_p"))
    return own.join(found, list(keys)).withColumn("part", F.explode(mine)).drop("_p", "_all")


def merge_sets(rows: DataFrame, keys: Sequence[str], sets: Sequence[str], falling: Sequence[str] = ()) -> DataFrame:
    """The distinct elements of array columns over a key's rows, sorted (downwards for ``falling``)."""
    merged = [F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))), c not in falling).alias(c) for c in sets]
    return rows.groupBy(*keys).agg(*merged)


def repeating(headings: DataFrame, keys: Sequence[str], text: str, least: int = 3) -> DataFrame:
    """Headings that a document has ``least`` times or more: its main sections."""
    return headings.groupBy(*keys, text).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _fresh_names(names: pd.DataFrame) -> pd.DataFrame:
    taken: set[str] = set(names.name)
    seen: set[str] = set()
    out = []
    for name in names.sort_values("at").name:
        k, one = 0, name
        while one in seen or (k and one in taken):
            k += 1
            one = f"{name}_{k}"
        seen.add(one)
        out.append(one)
    return names.sort_values("at").assign(unique=out)


def unique_names(names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``unique`` for columns ``at`` and ``name``: the first of equal names keeps it, others get ``_1``, ``_2``, ... as far as it is free.

    Only names that are equal but for such endings can meet, so each such group is a task of its own.
    """
    rooted = names.withColumn("_root", F.regexp_replace("name", "(_\\d+)+$", ""))
    group = [*keys, "_root"]
    # Groups without such an ending are numbered in place; only the others need a look at what is taken.
    w = Window.partitionBy(*group)
    ended = F.coalesce(F.max(F.col("_root") != F.col("name")).over(w), F.lit(False))
    n = F.row_number().over(w.orderBy("at")) - 1
    marked = rooted.withColumns({"_ended": ended, "unique": F.when(n > 0, F.concat_ws("_", "name", n.cast("string"))).otherwise(F.col("name"))})
    out = StructType(list(rooted.schema.fields)).add("unique", "string")
    some = marked.where("_ended").select(*rooted.columns).groupBy(*group).applyInPandas(_fresh_names, out)
    return some.unionByName(marked.where("NOT _ended").drop("_ended")).drop("_root")


def future_labels(rows: DataFrame, keys: Sequence[str], order: str, date: str, actual: str, predicted: str) -> DataFrame:
    """``label``: the date; for predictions without date and actual value, ``Future - Qn,YYYY`` three months after the last date."""
    last = F.add_months(F.last(date, ignorenulls=True).over(_upto(keys, [order])), 3)
    name = F.concat(F.lit("Future - Q"), F.quarter(last).cast("string"), F.lit(","), F.year(last).cast("string"))
    future = F.col(actual).isNull() & F.col(predicted).isNotNull() & F.col(date).isNull()
    return rows.withColumn("label", F.when(future, F.coalesce(name, F.lit("Future"))).otherwise(F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("Future"))))


def hierarchy(rows: DataFrame, keys: Sequence[str], order: str, first: str, second: str) -> DataFrame:
    """``level``, ``category`` and ``subcategory`` of rows by their two leading cells: 0 with the first filled, 1 with the second only, 2 with neither."""
    a, b = F.nullif(F.col(first), F.lit("")), F.nullif(F.col(second), F.lit(""))
    w = Window.partitionBy(*keys).orderBy(order)
    named = rows.withColumn("category", F.last(a, ignorenulls=True).over(_upto(keys, [order])))
    fresh = (a.isNotNull() & ~a.eqNullSafe(F.lag("category").over(w))) | (a.isNull() & b.isNotNull())
    named = named.withColumn("_set", F.when(fresh, F.struct(b.alias("v"))))
    sub = F.last("_set", ignorenulls=True).over(_upto(keys, [order]))["v"]
    return named.withColumn("subcategory", sub).withColumn("level", F.when(a.isNotNull(), 0).when(b.isNotNull(), 1).otherwise(2)).drop("_set")


def rolling_bands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, before: int = 4) -> DataFrame:
    """Mean and deviation of the ``before`` rows before each, and the bands two and three deviations off."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, -1)
    out = rows.withColumn("mean", F.avg(value).over(w)).withColumn("std", F.stddev_pop(value).over(w))
    for k in (2, 3):
        out = out.withColumn(f"lower_{k}", F.col("mean") - k * F.col("std")).withColumn(f"upper_{k}", F.col("mean") + k * F.col("std"))
    return out


def contents_order(page: Column, section: Column, title: Column) -> list[Column]:
    """Sort columns of a table of contents: the page as a number, section and title in any case."""
    return [page.try_cast("int").asc_nulls_last(), F.lower(section), F.lower(title)]


def sheet_pages(tables: DataFrame, keys: Sequence[str], source: str, page: str) -> DataFrame:
    """``page`` that a merged sheet is sorted by: the first page in a quarterly filing, without one that in any."""
    quarterly = F.lower(F.col(source)).rlike("10-?q")
    return tables.groupBy(*keys).agg(F.coalesce(F.min(F.when(quarterly, F.col(page))), F.min(page)).alias("page"))


def sections_of_labels(rows: DataFrame, keys: Sequence[str], order: str, label: str, values: Sequence[str]) -> DataFrame:
    """``section`` of each row: the last label before it whose values are all blank; empty for those labels themselves."""
    blank = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).isin("", "nan")
    name = F.trim(F.coalesce(F.col(label), F.lit("")))
    head = (name != "") & F.forall(F.array(*[blank(c) for c in values]), lambda x: x)
    above = F.last(F.when(head, name), ignorenulls=True).over(_upto(keys, [order]))
    return rows.withColumn("section", F.when(head, "").otherwise(F.coalesce(above, F.lit(""))))


def on_side(wide: DataFrame, keys: Sequence[str], label: str, section: str, periods: Sequence[str]) -> DataFrame:
    """Period columns become rows (``Dates``, ``Header``) and each label a column ``Section - Label`` in title letters; of equal labels the first value counts.

    The columns are the distinct labels of the tables, which a table of filings bounds.
    """
    name = F.concat_ws(" - ", F.nullif(titles.title_letters(F.col(section)), F.lit("")), titles.title_letters(F.col(label)))
    long = wide.select(*keys, name.alias("_c"), *[F.col(f"`{p}`").alias(p) for p in periods]).unpivot([*keys, "_c"], list(periods), "_period", "_v")
    dates, header = period.split_header(F.col("_period"))
    kept = long.select(*keys, "_c", dates.alias("Dates"), header.alias("Header"), "_v")
    return kept.groupBy(*keys, "Dates", "Header").pivot("_c").agg(F.min("_v"))


def rows_with_expected(rows: DataFrame, predicted: str, mean: str) -> DataFrame:
    """Rows that a chart can show: those with a predicted value or a rolling mean."""
    return rows.where(F.col(predicted).isNotNull() | F.col(mean).isNotNull())


def in_periods(rows: DataFrame, date: str, years: Sequence[int] = (), quarters: Sequence[int] = ()) -> DataFrame:
    """Rows of the years and quarters; all of either if none is given."""
    kept = rows.where(F.year(date).isin(list(years))) if years else rows
    return kept.where(F.quarter(date).isin(list(quarters))) if quarters else kept


def infer_columns(df: DataFrame, words: dict[str, Sequence[str]], fallback: Sequence[str] = ()) -> dict[str, str | None]:
    """The column for each role: the first whose name contains the first word that any does; for roles in ``fallback`` else the first number column."""
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    pick = lambda keys: next((c for k in keys for c in df.columns if k in c.lower()), None)
    return {role: pick(keys) or (numbers[0] if role in fallback and numbers else None) for role, keys in words.items()}


def category_scores(scores: DataFrame, keys: Sequence[str], category: str, score: str) -> DataFrame:
    """Mean score of each category, and of all as category null."""
    sets = [[*keys, category], [*keys]]
    return scores.groupingSets([[F.col(c) for c in s] for s in sets], *keys, category).agg(F.avg(score).alias("mean"))
