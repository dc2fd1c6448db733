"""Merging of long facts over sources, and the catalog of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingloom.operators.ordered import numbered_in_order


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_sources(facts: DataFrame, source: str = "Source") -> DataFrame:
    """One row per distinct fact; ``source`` lists the sorted distinct sources. Nulls in keys count as empty."""
    keys = [c for c in facts.columns if c != source]
    filled = facts.select(source, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in keys])
    named = F.when(F.trim(F.col(source)) != "", F.col(source))
    return filled.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.array_join(F.sort_array(F.collect_set(named)), ", ").alias(source)).select(source, *[F.col(f"`{c}`") for c in keys])


def catalog(facts: DataFrame, keys: Sequence[str], product: str, period: str) -> DataFrame:
    """Per table: ``table_id`` in key order, distinct products, year range, records."""
    years = F.regexp_extract(period, "(20\\d{2})", 1)
    years = F.when(years != "", years)
    g = facts.groupBy(*keys).agg(F.countDistinct(product).alias("products"), F.min(years).alias("lo"), F.max(years).alias("hi"), F.count("*").alias("records"))
    span = F.when(F.col("lo").isNull(), "").when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.concat_ws("-", "lo", "hi"))
    # One row per table meets here, not one per fact.
    g = numbered_in_order(g.withColumn("_key", F.struct(*keys)), "_key", "_n")
    return g.select(F.format_string("TBL_%03d", "_n").alias("table_id"), *keys, "products", span.alias("years"), "records")


def outer_periods(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str], value: str) -> DataFrame:
    """Full outer join of two periods on a row label; missing cells are ``N/A``."""
    a, b = left.select(key, F.col(value).alias(names[0])), right.select(key, F.col(value).alias(names[1]))
    return a.join(b, key, "full").select(key, *[F.coalesce(F.col(n).cast("string"), F.lit("N/A")).alias(n) for n in names])


def top_one(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_provenance(rows: DataFrame, row: str) -> DataFrame:
    """Rows of retrieved tables (``row``, a map from column to cell, so that no union enumerates columns) with where they come from.

    ``_table_id`` is the table's own, else made of its document (or ``unknown``), page (or 0) and rank.
    """
    made = F.concat_ws("_", F.coalesce("source_doc", F.lit("unknown")), F.concat(F.lit("p"), F.coalesce("page_no", F.lit(0)).cast("string")), F.col("rank").cast("string"))
    own = F.nullif(F.col("table_id"), F.lit(""))
    return rows.select(row, F.coalesce(own, made).alias("_table_id"), F.col("source_doc").alias("_source"), F.col("page_no").alias("_page"), F.col("table_title").alias("_table"), F.col("score").alias("_score"), F.col("rank").alias("_rank"))
