import datetime
import os

import pytest
from pyspark.sql import functions as F

from filingloom.operators import grid, resequence
from filingloom.sources import backends, sinks, vectors, workbook

FIRST = ["← Back to Index", "Category (Parent):", "Column Header L1:", "Table Title: A", "Source(s): x.pdf", "", "$ in millions", "Net revenues", "", "$ in millions", "Cost", "Total", "", "", "Table Title: B", "Source: y.pdf", "Fees"]


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [("s", i, a, [a, f"c{i}", None]) for i, a in enumerate(FIRST)]
    return spark.createDataFrame([*rows, ("none", 0, None, None), ("none", 1, "plain", ["plain"])], "sheet string, i int, a string, cells array<string>")


def test_tables(sheet):
    t = grid.table_rows(sheet, ["sheet"], ["i"], "a")
    assert [(r.i, r.table_no) for r in t.orderBy("i").collect()] == [(6, 1), (7, 1), (8, 1), (9, 1), (10, 1), (11, 1), (16, 2)]
    u = grid.sub_tables(t, ["sheet", "table_no"], ["i"], "a")
    assert [(r.i, r.sub_no) for r in u.orderBy("i").collect()] == [(6, 1), (7, 1), (9, 2), (10, 2), (11, 2), (16, 0)]
    heads = grid.header_rows(t, ["sheet", "table_no"], ["i"], "cells").where("is_header").collect()
    assert [r.i for r in heads] == [6]
    assert grid.row_labels(t.where("table_no = 2"), ["table_no"], ["i"], "a").first()["labels"] == ["fees"]


def test_metadata(sheet):
    a, b = grid.metadata(sheet, ["sheet"], ["i"], "a", "cells").orderBy("table_no").collect()
    assert (a.Table_Title_Metadata, a.Sources_Metadata, a.Category_Parent, a.Column_Header) == ("A, c3", "x.pdf, c4", "c1", "c2")
    assert (b.Table_Title_Metadata, b.Category_Parent, b.Column_Header) == ("B, c14", None, "")


def test_empty_grid(sheet):
    none = sheet.where("false")
    for f in (grid.table_rows, grid.until_blanks):
        assert f(none, ["sheet"], ["i"], "a").count() == 0
    assert grid.metadata(none, ["sheet"], ["i"], "a", "cells").count() == 0
    assert grid.table_rows(sheet.where("sheet = 'none'"), ["sheet"], ["i"], "a").count() == 0


def test_blanks_and_parts(spark, sheet):
    assert [r.i for r in grid.until_blanks(sheet.where("sheet = 's'"), ["sheet"], ["i"], "a").orderBy("i").collect()] == list(range(12))
    rows = spark.createDataFrame([(0, ["Fees", "1"]), (1, [None, "At March 31, 2024"]), (2, ["Cost", "2"]), (3, ["", "x"])], "i int, cells array<string>")
    assert [r.part_no for r in grid.split_on_headers(rows.withColumn("s", F.lit(1)), ["s"], ["i"], "cells").orderBy("i").collect()] == [0, 1, 1, 1]


def test_flattened_headers(spark):
    top, low = F.array(F.lit(""), F.lit("Three Months Ended"), F.lit(None)), F.array(F.lit(""), F.lit("2024"), F.lit("2023"))
    assert spark.range(1).select(grid.flatten_headers([top, low])).first()[0] == ["", "Three Months Ended 2024", "Three Months Ended 2023"]


def test_workbooks(spark, tmp_path):
    cells = [["x & <y>", 1, 2.5, None, True], [], ["z"]]
    (tmp_path / "q_tables.xlsx").write_bytes(workbook.workbook_bytes({"Index": [["Source", "T"], ["a", "b"]], "1": cells, "TOC": [["t"]], "empty": []}))
    (tmp_path / "bad_tables.xlsx").write_bytes(b"no workbook")
    (tmp_path / "other.xlsx").write_bytes(b"")
    got = workbook.scan(spark, str(tmp_path))
    rows = workbook.tables_only(got).orderBy("row_idx").collect()
    assert [(r.workbook, r.sheet, r.row_idx, r.cells) for r in rows] == [("q", "1", 0, ["x & <y>", "1", "2.5", None, "True"]), ("q", "1", 2, ["z"])]
    assert {r.workbook: r.status for r in workbook.export_status(got).collect()} == {"q": "SUCCESS", "bad": "FAILED"}
    assert workbook.index(got).first()["entry"] == {"Source": "a", "T": "b"}


def test_index_rows(spark):
    index = spark.createDataFrame([(0, "5", "5", "Rev"), (1, "5", "5", "Other"), (2, "6", "6", None)], "row_idx int, Table_ID string, Location_ID string, `Table Title` string")
    got = resequence.split_index(index, spark.createDataFrame([("5", 2)], "Table_ID string, n_parts int")).orderBy("row_idx", "part").collect()
    assert [(r.Table_ID, r.Location_ID, r["Table Title"]) for r in got] == [("5_1", "5_1", "Rev (Part 1)"), ("5_2", "5_2", "Rev (Part 2)"), ("6", "6", None)]
    years = spark.createDataFrame([(2023,), (2025,)], "year int")
    urls = [r.url for r in resequence.filing_urls(years, "b", datetime.date(2025, 8, 20)).orderBy("year", "month").collect()]
    assert urls == ["b/10q0523.pdf", "b/10q0623.pdf", "b/10q0923.pdf", "b/10k2023/10k1223.pdf", "b/10q0325.pdf", "b/10q0625.pdf"]


def test_vector_tables(spark, tmp_path):
    v = spark.createDataFrame([(1, [3.0, 4.0], "t", "d1", 2024), (2, [0.0, 0.0], "u", None, 2023), (3, None, None, "d1", None)], "id int, v array<double>, t string, source_doc string, year int")
    rows = vectors.rows(v, "id", "v", "t", ["source_doc", "year"])
    assert [r.embedding for r in rows.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert [r.id for r in vectors.without_source(rows, "d1").collect()] == [2]
    vectors.append(rows, f"{tmp_path}/a")
    assert vectors.migrate(spark, f"{tmp_path}/a", f"{tmp_path}/b") == (3, 2)
    assert tuple(vectors.stats(rows).first()) == (3, 1, "2023,2024", 2)


def test_sinks(spark, tmp_path):
    page = "<table><tr><th>A</th><th>B|</th></tr><tr><td><b>1</b></td><td> 2 </td></tr></table>"
    p = spark.createDataFrame([(page,), ("x",), (None,)], "h string").select(sinks.markdown(sinks.html_rows(F.col("h"))))
    assert [r[0] for r in p.collect()] == ["| A | B\\| |\n| --- | --- |\n| 1 | 2 |", "", ""]
    c = spark.createDataFrame([("5.0",), ("a\n b  c",), ("NaN",), (None,)], "h string").select(sinks.clean_cell(F.col("h")))
    assert [r[0] for r in c.collect()] == ["5", "a; b c", "", ""]
    sinks.write_views(spark.createDataFrame([("T1", "a"), ("T2", None)], "Table_ID string, v string"), f"{tmp_path}/views")
    assert {"Table_ID=T1", "Table_ID=T2"} <= set(os.listdir(tmp_path / "views"))
    s = spark.createDataFrame([("2024-01-01", "1", None), ("x", "1", "2"), ("2024-01-02", None, "z")], "d string, a string, b string")
    assert sinks.series_source(s, "d", ("a", "b")).count() == 1
    with pytest.raises(ValueError):
        sinks.series_source(s, "d", ("a", "nope"))


def test_back_ends(spark, tmp_path):
    def broken(data):
        raise KeyError("no library")

    def lines(data):
        if data == b"bad":
            raise ValueError("not a document")
        for k, page in enumerate(data.decode().split("\f"), 1):
            if page:
                yield k, f"page {k}", [line.split("|") for line in page.split("\n")]

    for name, data in {"a": b"x|1\ny|\fz|2", "b": b"bad", "c": b""}.items():
        (tmp_path / f"{name}.pdf").write_bytes(data)
    with pytest.raises(ValueError):
        backends.scan(spark, str(tmp_path))
    backends.register("lines", lines)
    backends.register("broken", broken, 1)
    try:
        assert backends.names() == ["broken", "lines"]
        got = backends.scan(spark, str(tmp_path)).orderBy("source_doc", "table_no").collect()
        assert [(r.source_doc, r.backend, r.table_no, r.page_no, r.rows) for r in got] == [("a.pdf", "lines", 1, 1, [["x", "1"], ["y", ""]]), ("a.pdf", "lines", 2, 2, [["z", "2"]]), ("b.pdf", None, None, None, None)]
        assert got[2].error == "broken: KeyError: 'no library'; lines: ValueError: not a document"
        q = backends.quality(backends.scan(spark, str(tmp_path), use=["lines"])).collect()
        assert [tuple(r) for r in q] == [("a.pdf", "lines", 2, 3, 5 / 6)]
        with pytest.raises(ValueError):
            backends.scan(spark, str(tmp_path), use=["nope"])
    finally:
        backends.unregister("lines")
        backends.unregister("broken")
