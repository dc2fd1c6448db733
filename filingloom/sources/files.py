"""CSV folders, and markdown and HTML tables inside text columns."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Literals that a cell's missing value is written as.
NA_LITERALS = ["N/A", "NA", "nan", "NaN", "null", "NULL", "None", "n/a", "<NA>", "#N/A"]


def csv_folder(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Headed CSV files of differing columns, united by name; missing literals become null.

    The first lines of all files are read in one distributed pass; files of one
    header are one scan with that header as its schema, so that the plan grows
    with the kinds of files and not with their number. All columns are texts.
    """
    heads = spark.read.text(paths, wholetext=False).select(F.input_file_name().alias("path"), "value", F.monotonically_increasing_id().alias("n"))
    first = heads.groupBy("path").agg(F.min_by("value", "n").alias("head"))
    kinds = first.groupBy("head").agg(F.collect_list("path").alias("paths")).orderBy("head").collect()
    frames = []
    for kind in kinds:
        names = next(csv.reader([kind["head"].lstrip("\ufeff")]))
        schema = StructType([StructField(c, StringType()) for c in names])
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv([unquote(p) for p in kind["paths"]])
        frames.append(df.select(*[F.when(~F.col(f"`{c}`").isin(NA_LITERALS), F.col(f"`{c}`")).alias(c) for c in df.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def markdown_cells(text: Column) -> Column:
    """Rows of pipe-separated cells: array of arrays; separator rows and lines without a pipe go."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("|") & ~x.rlike("^[\\s|:-]+$"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), "^\\||\\|$", ""), "\\|"), lambda c: F.trim(c))
    return F.transform(lines, cells)


def html_texts(html: Column, tag: str) -> Column:
    """Inner texts of a tag without nested tags, in order."""
    return F.regexp_extract_all(html, F.lit(f"(?i)<{tag}[^>]*>([^<]*)</{tag}>"), F.lit(1))
