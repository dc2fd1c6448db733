"""Header stacks of the reference fixtures and of every kind of span."""

import pytest
from pyspark.sql import functions as F

from filingloom.operators import header_stack

SCHEMA = "n int, rows array<array<string>>, source string"
STACKS = [
    ([["At March 31, 2024", "At June 30, 2024", "At Dec 31, 2023", "As of March 31, 2025"]], "", ["Q1-2024", "Q2-2024", "Q4-2023", "Q1-2025"]),
    ([["Three Months Ended June 30, 2024", "Six Months Ended June 30, 2024", "Nine Months Ended September 30, 2024", "Year Ended December 31, 2023"]], "", ["Q2-QTD-2024", "Q2-YTD-2024", "Q3-YTD-2024", "YTD-2023"]),
    ([["", "Three Months Ended", "", "Six Months Ended", ""], ["", "March 31,", "", "June 30,", ""], ["$ in millions", "2023", "2024", "2023", "2024"]], "",
     ["$ in millions", "Q1-QTD-2023", "Q1-QTD-2024", "Q2-YTD-2023", "Q2-YTD-2024"]),
    ([["4Q 2024", "1Q 2025", "4Q2024"]], "", ["4Q-2024", "1Q-2025", "4Q-2024"]),
    ([["At June 30, 2024 and December 31, 2023"]], "", ["Q2-2024 & Q4-2023"]),
    ([["2024"]], "10k1224.pdf", ["YTD-2024"]),
    ([["% Change", "Total", "Inflows"]], "", ["% change", "total", "inflows"]),
    ([["q1-2024", "Q2-QTD-2023", "YTD-2022"]], "", ["Q1-2024", "Q2-QTD-2023", "YTD-2022"]),
    ([["", "Three Months Ended September 30, 2025", "", "", ""], ["$ in millions", "Trading", "Fees 1", "Level 2", "Total"]], "",
     ["$ in millions", "Q3-QTD-2025 Trading", "Q3-QTD-2025 Fees", "Q3-QTD-2025 Level 2", "Q3-QTD-2025 Total"]),
    ([["", "Average Monthly Balance", ""], ["$ in millions", "2024", "2023"]], "10k1224.pdf", ["$ in millions", "YTD-2024 Average Monthly Balance", "YTD-2023 Average Monthly Balance"]),
    ([["%", "Loans Loans 3", None], ["Change"]], "", ["% change", "Loans", ""]),
    ([], "", []),
    ([[None, "nan"], ["", " "]], "x", ["", ""]),
]


@pytest.mark.parametrize("n", range(len(STACKS)))
def test_codes(spark, n):
    rows, source, wanted = STACKS[n]
    got = header_stack.normalise_headers(spark.createDataFrame([(n, rows, source)], SCHEMA), "rows", "source").first()
    assert got.normalized_headers == wanted


def test_levels(spark):
    rows = [["", "Institutional", ""], ["", "Trading", "Fees"], ["$ in billions", "Six Months Ended June 30,", ""], ["", "2024", "2023"]]
    got = header_stack.normalise_headers(spark.createDataFrame([(1, rows, None)], SCHEMA), "rows", "source").first()
    assert got.l1_headers == ["", "Institutional", ""] and got.l2_headers == ["", "Six Months Ended", "Six Months Ended"] and got.l3_headers == ["$ in billions", "2024", "2023"]
    assert got.normalized_headers == ["$ in billions", "Q2-YTD-2024 Trading", "Q2-YTD-2023 Fees"]


def test_structure(spark):
    stacks = [
        ([["", "Three Months Ended"], ["", "2024"]], "L2_L3::CUMULATIVE"), ([["", "Average Monthly Balance"], ["x", "", "Year Ended December 31"], ["", "2024"]], "L1_L2_L3::ANNUAL"),
        ([["", "At March 31, 2024"], ["a", "5"]], "L3_ONLY::POINT_IN_TIME"), ([["Source(s)", "three months"], ["", "7"]], "L3_ONLY::POINT_IN_TIME"), ([["a", "b"]], "UNKNOWN::UNKNOWN"), (None, "UNKNOWN::UNKNOWN"),
    ]
    df = spark.createDataFrame([(i, r, "") for i, (r, _) in enumerate(stacks)], SCHEMA)
    assert [r.p for r in df.orderBy("n").select(header_stack.structure_pattern(F.col("rows")).alias("p")).collect()] == [w for _, w in stacks]
