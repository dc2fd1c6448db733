"""Index rows of workbooks: new sheet ids, and rows for sheets that were split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_index(index: DataFrame, parts: DataFrame, sheet: str = "Table_ID", title: str = "Table Title", location: str = "Location_ID") -> DataFrame:
    """Index rows after splits: the first row of a sheet with ``n_parts`` of 2 or more becomes that many, its other rows go.

    Part k has the id ``<id>_k``, the same location and `` (Part k)`` after its
    title. ``parts`` has one row (``sheet``, ``n_parts``) per split sheet and
    index rows are ordered by ``row_idx``; ``part`` is 0 for undivided sheets.
    """
    joined = index.join(parts.select(F.col(sheet), F.col("n_parts")), sheet, "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(sheet).orderBy("row_idx"))
    kept = joined.withColumn("_rn", first).where("n_parts < 2 OR _rn = 1")
    dealt = kept.withColumn("part", F.explode(F.when(F.col("n_parts") < 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("n_parts").cast("int")))))
    k = F.col("part").cast("string")
    named = F.when(F.col("part") > 0, F.concat(F.col(f"`{sheet}`"), F.lit("_"), k))
    new = {
        sheet: F.coalesce(named, F.col(f"`{sheet}`")), location: F.coalesce(named, F.col(f"`{location}`")),
        title: F.when(F.col("part") > 0, F.concat(F.col(f"`{title}`"), F.lit(" (Part "), k, F.lit(")"))).otherwise(F.col(f"`{title}`")),
    }
    return dealt.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in index.columns], "part")


def filing_urls(years: DataFrame, base: str, today, extension: str = "pdf") -> DataFrame:
    """Addresses of the quarterly and yearly filings of each ``year`` that are due by ``today``.

    Quarters are due 45 days after their end, the year 60 days after its; the
    first quarter of 2023 is named by month 05.
    """
    y = F.col("year").cast("string")
    short = F.substring(y, 3, 2)
    rows = years.withColumn("month", F.explode(F.array(*map(F.lit, (3, 6, 9, 12)))))
    month = F.when((F.col("year") == 2023) & (F.col("month") == 3), "05").otherwise(F.lpad(F.col("month").cast("string"), 2, "0"))
    due = F.date_add(F.last_day(F.make_date("year", "month", F.lit(1))), F.when(F.col("month") == 12, 60).otherwise(45))
    name = F.when(F.col("month") == 12, F.concat(F.lit("10k"), y, F.lit("/10k12"), short)).otherwise(F.concat(F.lit("10q"), month, short))
    return rows.where(due <= F.lit(today)).select("year", "month", F.concat(F.lit(f"{base}/"), name, F.lit(f".{extension}")).alias("url"))
