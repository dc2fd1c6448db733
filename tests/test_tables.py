"""Whole-table operators: links of index rows, fresh names, fallbacks of columns; nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from filingloom.functions import claims, headers, label, rows, titles
from filingloom.operators import tables


def test_index_rows_take_tables_by_title_then_in_order(spark):
    index = spark.createDataFrame([("a", 1, "Total loans"), ("a", 2, ""), ("a", 3, None), ("b", 1, "x"), ("c", 1, None), ("c", 2, "Fees"), (None, 1, "lost")], "sheet string, at long, title string")
    found = spark.createDataFrame([("a", 10, "Cash"), ("a", 11, "total LOANS by type"), ("c", 20, "Cash"), ("c", 21, "fees"), ("c", 22, None), ("z", 1, "x")], "sheet string, at long, title string")
    got = {(r.sheet, r.at, r.table_at) for r in tables.enhanced_index(index, found).collect()}
    assert got == {("a", 1, 11), ("a", 2, 10), ("a", 3, None), ("b", 1, None), ("c", 1, 20), ("c", 2, 21), ("c", 2, 22)}


def test_index_of_nothing_is_empty(spark):
    empty = spark.createDataFrame([], "sheet string, at long, title string")
    assert tables.enhanced_index(empty, empty).count() == 0


def test_names_skip_those_that_are_taken(spark):
    names = spark.createDataFrame([("w", 1, "5"), ("w", 2, "5"), ("w", 3, "5_1"), ("w", 4, "5"), ("w", 5, "5_1"), ("v", 1, "5")], "k string, at int, name string")
    got = {(r.k, r.at): r.unique for r in tables.unique_names(names, ["k"]).collect()}
    assert got == {("w", 1): "5", ("w", 2): "5_2", ("w", 3): "5_1", ("w", 4): "5_3", ("w", 5): "5_1_1", ("v", 1): "5"}


def test_columns_by_words_or_the_first_number(spark):
    df = spark.createDataFrame([("x", 1.0)], "Name string, Amount double")
    assert tables.infer_columns(df, {"a": ["price", "amount"], "b": ["none"], "c": ["none"]}, ["b"]) == {"a": "Amount", "b": "Amount", "c": None}
    with pytest.raises(ValueError):
        tables.compare_columns(df, "Name", "Amount", "2024")


def test_nulls_and_blanks(spark):
    one = spark.range(1).select(F.lit(None).cast("string").alias("t"), F.array().cast("array<string>").alias("c"), F.array(F.lit(None).cast("string"), F.lit("5")).alias("n"))
    r = one.select(
        titles.date_suffix(F.col("t")).alias("a"), titles.title_of_sheet(F.col("t")).alias("b"), titles.title_of_cells(F.col("c")).alias("c2"), rows.voted_header(F.col("c")).alias("d"),
        rows.spanning(F.col("c")).alias("e"), rows.embedded_header(F.col("n")).alias("f"), claims.faithfulness(F.col("t"), F.col("t"))["score"].alias("g"),
        headers.with_periods(F.array(F.lit("0 of 0")), F.array(F.lit("Q1-2024"))).alias("h"), F.array_join(rows.repair_cells(F.array(F.lit("0 0"))), "|").alias("i"),
    ).first()
    assert (r.a.title, r.b, r.c2, r.d, r.f, r.g, r.h, r.i) == (None, "", "", False, False, 0.5, ["0 of 0 Q1-2024"], "0 0")


def test_labels_meet_a_vocabulary(spark):
    df = spark.createDataFrame([("Total  Assets",), ("totl assets",), ("Other!",), (None,)], "l string")
    got = [(r.name, round(r.confidence, 2)) for r in label.canonical(df, "l", {"total_assets": ["total assets"]}).collect()]
    assert sorted(got, key=str) == sorted([("total_assets", 1.0), ("total_assets", 0.96), ("other", 0.0), (None, 0.0)], key=str)
