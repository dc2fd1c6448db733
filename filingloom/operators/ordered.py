"""Operators over rows in an explicit order: fills, islands, chunks, trims, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_upto(keys, order)))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], begins: Column, name: str = "island") -> DataFrame:
    """Number of the block that a row is in: a running count of ``begins``."""
    return df.withColumn(name, F.sum(begins.cast("int")).over(_upto(keys, order)))


def categories(grid: DataFrame, keys: Sequence[str], order: str, label: str, cells: Sequence[str]) -> DataFrame:
    """Category rows become a column: a label whose other cells are all empty, or all repeat it, heads the rows below it."""
    filled = F.filter(F.array(*[F.trim(F.col(c).cast("string")) for c in cells]), lambda x: x.isNotNull() & (x != ""))
    head = (F.trim(label) != "") & ((F.size(filled) == 0) | F.forall(filled, lambda x: x == F.trim(label)))
    marked = forward_fill(grid.where(F.trim(label) != ""), keys, [order], F.when(head, F.trim(label)), "Category")
    return marked.where(~head).withColumn("Category", F.coalesce("Category", F.lit("")))


def row_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 10, overlap: int = 3, least: int = 3) -> DataFrame:
    """Rows dealt to overlapping chunks; a rest below ``least`` rows opens none. Adds ``row_no`` (from 1) and ``chunk`` (from 0)."""
    step = size - overlap
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("row_no", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    last = F.when(F.col("_n") <= size, F.lit(0)).otherwise(F.floor((F.col("_n") - least) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("row_no") - size) / step))
    final = F.least(F.floor((F.col("row_no") - 1) / step), last)
    chunks = F.when(first <= final, F.sequence(first.cast("int"), final.cast("int")))
    return numbered.withColumn("chunk", F.explode(chunks)).drop("_n")


def period_change(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``change`` and ``pct_change`` against the row before; null without one or at 0."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("change", F.col(value) - before).withColumn("pct_change", F.try_divide(F.col(value) - before, F.abs(before)) * 100)


def leading_trim(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Column) -> DataFrame:
    """Drops the rows before the first that ``keep`` holds for."""
    return df.withColumn("_on", F.max(keep.cast("int")).over(_upto(keys, order))).where("_on = 1").drop("_on")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """For each left row the ``value`` of the right row with the greatest ``at`` not above its own; one union and one window, no range join."""
    a = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value))
    b = right.select(*keys, at, value).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    filled = both.withColumn(value, F.last(value, ignorenulls=True).over(_upto(keys, [at, "_side"])))
    return filled.where("_side = 1").drop("_side")


def numbered_in_order(df: DataFrame, order: str, name: str) -> DataFrame:
    """``name``: 1, 2, ... over the whole table in the order of a column; ranges are numbered in parallel.

    Rows are dealt to ranges by the column, counted, and numbered within their
    range from the number of rows before it; one count a range is all that meets
    in one place. Rows of equal values are numbered in any order.
    """
    # Ranges are drawn by sampling, so they are fixed by a checkpoint where one is set.
    ranged = df.repartitionByRange(order).withColumn("_range", F.spark_partition_id())
    if df.sparkSession.sparkContext.getCheckpointDir():
        ranged = ranged.checkpoint()
    ends = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = ends.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_within", within).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_within")).cast("int")).drop("_range", "_within", "_before")


def dense_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``id``: n for the first row of the n-th distinct key by order, n_k for its k-th repeat."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    numbered = numbered_in_order(first, "_first", "_n").drop("_first")
    rep = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    joined = df.withColumn("_k", rep).join(numbered, list(keys))
    return joined.withColumn("id", F.when(F.col("_k") == 0, F.col("_n").cast("string")).otherwise(F.concat_ws("_", "_n", "_k"))).drop("_k", "_n")
