"""Whole table blocks: groups of equal label sequences, blocks beside and below each other, tables on their side, tables as rows of a sheet.

A block is rows of cells in long form; nothing here makes a column of a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.functions import label as labels_
from filingloom.functions import period, titles
from filingloom.operators.shared import cut


def _fingerprint(at: Column, value: Column) -> list[Column]:
    """Aggregates over the rows of a sequence that depend on the order and can be summed by parts: length and two sums of hashes salted by place."""
    salted = lambda seed: F.sum(F.xxhash64(F.lit(seed), at, value).cast("decimal(38,0)"))
    return [F.count("*").alias("n"), salted(1).alias("f1"), salted(2).alias("f2")]


_PRINT = ["n", "f1", "f2"]


def _confirmed(rows: DataFrame, prints: DataFrame, within: Sequence[str], block: Sequence[str], at: str, value: str) -> DataFrame:
    """``prints`` with ``exact``: empty where all rows under a fingerprint are equal byte by byte, else a digest of the whole sequence.

    Only blocks that share their fingerprint are compared; their rows stay where they are if they are dealt so already.
    """
    same = F.count("*").over(Window.partitionBy(*within, *_PRINT))
    shared = prints.withColumn("_same", same).where("_same > 1").select(*block, *_PRINT)
    each = rows.join(shared, list(block)).groupBy(*within, *_PRINT, at).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(value).isNull()).alias("gone"), F.count("*").alias("all"))
    doubtful = cut(each.where((F.col("lo") != F.col("hi")) | F.col("gone").between(1, F.col("all") - 1)).select(*within, *_PRINT).distinct())
    if doubtful.isEmpty():
        return prints.withColumn("exact", F.lit(""))
    few = rows.join(prints.join(doubtful, [*within, *_PRINT], "left_semi").select(*block), list(block), "left_semi")
    whole = few.groupBy(*block).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.coalesce(F.col(value), F.lit("\x00")).alias("v"))))), 256).alias("exact"))
    return prints.join(whole, list(block), "left").withColumn("exact", F.coalesce("exact", F.lit("")))


def sequence_groups(rows: DataFrame, keys: Sequence[str], block: str, at: str, label: str) -> DataFrame:
    """Blocks of one sheet (``keys``) with equal labels in equal order: ``block``, ``group`` (its first block) and ``blocks``, for groups of two or more.

    Labels are compared in any case and without outer blanks; ``at`` numbers
    a block's rows. Sequences meet by fingerprints that every task sums over its
    rows, so no block is held whole; labels under one fingerprint are then compared.
    A sequence that many blocks share gives one row for each of them, and no pairs.
    """
    of = [*keys, block]
    number = F.row_number().over(Window.partitionBy(*of).orderBy(at))
    numbered = rows.select(*of, number.alias("_at"), F.lower(F.trim(F.coalesce(F.col(label), F.lit("")))).alias("_l"))
    prints = numbered.groupBy(*of).agg(*_fingerprint(F.col("_at"), F.col("_l")))
    sure = _confirmed(numbered, prints, keys, of, "_at", "_l")
    w = Window.partitionBy(*keys, *_PRINT, "exact")
    return sure.withColumns({"group": F.min(block).over(w), "blocks": F.count("*").over(w)}).where("blocks > 1").select(*of, "group", "blocks")


def merge_beside(cells: DataFrame, groups: DataFrame, keys: Sequence[str], block: str, row: str, column: str, value: str) -> DataFrame:
    """Cells of one table for each group of ``sequence_groups``: the labels (column 1) and columns of its first block, then those of the others.

    A column that equals one before it in all its cells, header included, is left out.
    Rows are numbered as in the blocks; columns anew. Blocks outside groups are not returned.
    """
    of = [*keys, block]
    # Every step below asks for the groups.
    groups = cut(groups)
    mine = cells.join(groups.select(*of, "group"), of)
    # Labels are those of the first block.
    mine = mine.where((F.col(column) > 1) | (F.col(block) == F.col("group")))
    numbered = mine.select(*keys, "group", block, F.col(column).alias("_c"), F.col(row).alias("_r"), F.col(value).alias("_v")).where("_v IS NOT NULL")
    which = [*keys, "group", block, "_c"]
    prints = numbered.groupBy(*which).agg(*_fingerprint(F.col("_r"), F.col("_v")))
    sure = _confirmed(numbered, prints, [*keys, "group"], which, "_r", "_v")
    # Column 1 stands apart: a data column may repeat the labels.
    first = sure.groupBy(*keys, "group", *_PRINT, "exact", (F.col("_c") == 1).alias("_label")).agg(F.min(F.struct(block, "_c")).alias("_of")).select(*keys, "group", "_label", F.col(f"_of.{block}").alias(block), "_of._c")
    place = F.row_number().over(Window.partitionBy(*keys, "group").orderBy(F.desc("_label"), block, "_c"))
    kept = first.withColumn("_to", place)
    return numbered.join(kept, which).select(*keys, F.col("group").alias(block), F.col("_r").alias(row), F.col("_to").alias(column), F.col("_v").alias(value))


def distinct_columns(cells: DataFrame, keys: Sequence[str], row: str, column: str, header: str, value: str) -> DataFrame:
    """The columns of each table that no column before them equals in header and all cells, in any case and without outer blanks."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    numbered = cells.select(*keys, F.col(column).alias("_c"), plain(header).alias("_h"), F.col(row).alias("_r"), plain(value).alias("_v"))
    which = [*keys, "_h", "_c"]
    prints = numbered.groupBy(*which).agg(*_fingerprint(F.col("_r"), F.col("_v")))
    sure = _confirmed(numbered, prints, [*keys, "_h"], which, "_r", "_v")
    return sure.groupBy(*keys, F.col("_h").alias(header), *_PRINT, "exact").agg(F.min("_c").alias(column)).select(*keys, column, header)


def stacked_groups(tables: DataFrame, keys: Sequence[str], at: str, header: str, section: str, title: str, metadata: str, least: float = 0.75) -> DataFrame:
    """``group`` of each table, from 1: it goes on while header (or none), section and title equal those of the table just before, and metadata are alike.

    ``(Part N)`` in titles and sections does not count; metadata are compared by the
    ratio of matching blocks.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    part = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "(?i)\\s*\\(part\\s*\\d+\\)", ""))
    rows = tables.withColumns({"_h": F.coalesce(F.col(header), F.lit("")), "_s": part(section), "_t": part(title), "_m": F.coalesce(F.col(metadata), F.lit(""))})
    rows = rows.withColumns({f"_p{c}": F.lag(c).over(w) for c in ("_h", "_s", "_t", "_m")})
    named = (F.col("_p_t") == F.col("_t")) & (F.col("_p_s") == F.col("_s")) & ((F.col("_h") == "") | (F.col("_h") == F.col("_p_h")))
    # Only tables that agree so far are measured.
    alike = labels_.similarity(F.when(named, F.col("_p_m")).otherwise(""), F.when(named, F.col("_m")).otherwise(""))
    marked = rows.withColumn("_new", F.when(named & (alike >= least), 0).otherwise(1))
    group = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("group", group).select(*tables.columns, "group")


def on_side(wide: DataFrame, keys: Sequence[str], order: str, label: str, section: str, periods: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Tables on their side: (rows, columns), with as many labels as there are.

    ``rows`` has a row for each table and period: keys, ``Dates``, ``Header``, and ``cells``, a
    map from column number to value. ``columns`` names them: keys, ``column`` from 1 in
    the order of the labels' first rows, ``section``, ``label``, both in title letters. Of equal labels of a
    section the first value that is not null counts; null values have no cell.
    """
    named = wide.select(*keys, F.col(order).alias("_at"), *[titles.title_letters(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in ((section, "section"), (label, "label"))], *[F.col(f"`{p}`").alias(p) for p in periods])
    # By windows within the table, so that its rows are dealt once and need not meet their columns again.
    first = F.min("_at").over(Window.partitionBy(*keys, "section", "label"))
    named = named.withColumn("_first", first).withColumn("column", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first", "section", "label")))
    columns = named.groupBy(*keys, "column").agg(F.first("section").alias("section"), F.first("label").alias("label"))
    # As an array, since an unpivot forgets that rows are dealt by table.
    kind = named.select(F.coalesce(*[F.col(f"`{p}`") for p in periods])).schema[0].dataType
    parts = {p: period.split_header(F.lit(p)) for p in periods}
    each = F.inline(F.array(*[F.struct(F.lit(p).alias("_p"), dates.alias("Dates"), header.alias("Header"), F.col(f"`{p}`").cast(kind).alias("_v")) for p, (dates, header) in parts.items()]))
    long = named.select(*keys, "_at", "column", each).where("_v IS NOT NULL")
    one = long.groupBy(*keys, "column", "_p", "Dates", "Header").agg(F.min(F.struct("_at", "_v")).alias("_f"))
    cells = one.select(*keys, "Dates", "Header", F.struct("column", F.col("_f._v").alias("value")).alias("_e"))
    # A map holds one period of one table.
    rows = cells.groupBy(*keys, "Dates", "Header").agg(F.map_from_entries(F.array_sort(F.collect_list("_e"))).alias("cells"))
    return rows, columns


def cells_of(rows: DataFrame, columns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells of ``on_side`` by name: keys, ``section``, ``label``, ``Dates``, ``Header``, ``value``."""
    # Names stand in an array by their number, so tables meet their columns as one row.
    names = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("column", "section", "label"))).alias("_names"))
    name = lambda e: F.get("_names", e["key"] - 1)
    each = F.transform(F.map_entries("cells"), lambda e: F.struct(name(e)["section"].alias("section"), name(e)["label"].alias("label"), e["value"].alias("value")))
    found = rows.join(names, list(keys)).select(*keys, "Dates", "Header", F.inline(each))
    return found.select(*keys, "section", "label", "Dates", "Header", "value")


#: Names of a block's metadata rows, in their order.
HEADS = ["Category (Parent)", "Line Items", "Product/Entity", "Column Header (Level 1)", "Column Header (Level 2)", "Column Header (Level 3)", "Year/Quarter", "Table Title", "Source(s)"]


def serialise(tables: DataFrame, keys: Sequence[str], page: str, metadata: dict[str, Column], rows: str) -> DataFrame:
    """Rows of a sheet for tables that go over several pages: keys, ``line`` from 1, ``cells``.

    First the metadata rows of HEADS (of the first page; sources of all pages joined by ``; ``),
    a blank row, then each page's rows (an array of arrays) with a blank row between pages.
    ``metadata`` gives the values by head; a head without one stays as a bare name.
    """
    named = tables.select(*keys, F.col(page).alias("_p"), F.col(rows).alias("_rows"), *[(metadata[h] if h in metadata else F.lit(None)).cast("string").alias(f"_m{i}") for i, h in enumerate(HEADS)])
    last = len(HEADS) - 1
    first = F.min(F.struct("_p", *[f"_m{i}" for i in range(last)])).alias("f")
    sources = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(f"_m{last}").alias("s")))), lambda x: x["s"])), "; ").alias("s")
    heads = named.groupBy(*keys).agg(first, sources)
    pairs = [F.struct(F.lit(i).alias("i"), F.array(F.lit(h + ":"), F.coalesce(F.col("s") if i == last else F.col(f"f._m{i}"), F.lit(""))).alias("cells")) for i, h in enumerate(HEADS)]
    top = heads.select(*keys, F.lit(None).cast("long").alias("_p"), F.inline(F.array(*pairs, F.struct(F.lit(len(HEADS)).alias("i"), F.array().cast("array<string>").alias("cells")))))
    before = F.lag("_p").over(Window.partitionBy(*keys).orderBy("_p"))
    body = named.withColumn("_before", before).select(*keys, F.col("_p").cast("long").alias("_p"), F.posexplode(F.when(F.col("_before").isNull(), F.col("_rows")).otherwise(F.concat(F.array(F.array().cast("array<string>")), "_rows"))).alias("i", "cells"))
    line = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_p").asc_nulls_first(), "i"))
    return top.unionByName(body).select(*keys, line.alias("line"), "cells")
