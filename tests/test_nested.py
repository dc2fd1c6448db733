"""Nested tables there and back, cells of rows of equal names, reranking of odd lists, formats of single cells."""

import pandas as pd
from pyspark.sql import functions as F

from filingloom.functions import asks, currency
from filingloom.operators import nested, search


def test_there_and_back(spark):
    tables = spark.createDataFrame([(1, "A"), (2, "empty")], "t int, title string")
    rows = spark.createDataFrame([(1, 1, "Revenues", "rev", None, 0), (1, 2, "Fees", None, "Revenues", 1), (1, 3, "Fees", None, None, 1)], "t int, row_index int, text string, canonical_label string, parent_row string, indent_level int")
    columns = spark.createDataFrame([(1, 1, "Q1 2025"), (1, 2, "Note")], "t int, column_index int, header string")
    cells = spark.createDataFrame([(1, 1, 1, "$ 17,739"), (1, 2, 1, "(5)%"), (1, 3, 2, "n/a"), (1, 9, 9, None)], "t int, row int, column int, raw_text string")
    notes = spark.createDataFrame([(1, "1", "One.", 1, 1), (1, "1", "One.", 2, 1), (1, "*", "None.", None, None)], "t int, marker string, text string, row int, column int")
    n = nested.nest(tables, rows, columns, cells, notes, ["t"])
    full = n.where("t = 1").first()
    assert [tuple(r) for r in full.footnotes[1].cell_references] == [(1, 1), (2, 1)] and n.where("t = 2").first().data_cells == []
    assert [(c.row, c.column, c.row_header, c.column_header, c.parsed_value, c.data_type, c.footnote_refs) for c in full.data_cells] == [
        (1, 1, "Revenues", "Q1 2025", 17739.0, "currency", ["1"]), (2, 1, "Fees", "Q1 2025", -5.0, "percentage", ["1"]), (3, 2, "Fees", "Note", None, "text", []), (9, 9, None, None, None, "text", [])
    ]
    same = lambda a, b, c: sorted(map(str, a.select(*c).collect())) == sorted(map(str, b.select(*c).collect()))
    assert same(nested.rows_of(n, ["t"]), rows, rows.columns) and same(nested.columns_of(n, ["t"]), columns, columns.columns)
    assert same(nested.cells_of(n, ["t"]), cells, cells.columns) and same(nested.notes_of(n, ["t"]), notes, notes.columns)
    again = nested.nest(tables, nested.rows_of(n, ["t"]), nested.columns_of(n, ["t"]), nested.cells_of(n, ["t"]).select(*cells.columns), nested.notes_of(n, ["t"]), ["t"])
    assert same(again, n, n.columns)
    met = nested.cells_by_row_name(n, ["t"]).where("text = 'Fees'")
    assert sorted((r.row_index, r.row) for r in met.collect()) == [(2, 2), (2, 3), (3, 2), (3, 3)]
    texts = {r.row_index: r.text for r in nested.row_texts(n, ["t"], F.lit("d.pdf"), F.col("title"), F.lit(None).cast("string")).collect()}
    assert texts[1] == "Document: d.pdf\nTable: A\nRow: Revenues\nCanonical Label: rev\nValues: Q1 2025: $ 17,739\nData Type: currency"


def test_rerank(spark):
    rows = [(q, i, i, "word", t) for q in (1, 2) for i, t in enumerate(["word", None, "x" * 5000, "", "word word"], 1)] + [(2, 6, 6, "word", "word"), (3, 1, 1, None, None)]
    lists = spark.createDataFrame(rows, "query_id int, id int, rank int, query string, text string").repartition(3)
    seen = search.rerank(lists, lambda: lambda q, t: pd.Series([float(len(x)) if a in x else 0.0 for a, x in zip(q, t)]), 2, among=5, batch=2)
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in seen.collect()) == [(1, 1, 5, 9.0), (1, 2, 1, 4.0), (2, 1, 5, 9.0), (2, 2, 1, 4.0), (3, 1, 1, 0.0)]
    assert search.rerank(lists.where("false"), lambda: None, 2).count() == 0


def test_single_cells(spark):
    cells = {"17.4 %": "17.4%", "(5)%": "-5.0%", "1 % to 4% (3%)": "1% to 4% (3%)", "18224": "$18,224", "$ (717)": "($717)", "N/M": "N/M", "—": "-", None: "", "-": "-", "0.5%": "0.5%"}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r.c: r.f for r in df.select("c", currency.cell_format(F.col("c")).alias("f")).collect()} == cells
    one = spark.createDataFrame([("2024 and 20245, 2023", ["in 2023", None])], "a string, c array<string>")
    assert one.select(asks.stale_years(F.col("a"), F.col("c")).alias("y")).first().y == ["2024"]
