"""Lines that tie in the stated order: their rows, cells and texts come from one and the same line, however the lines are dealt."""

from filingloom.plans import nested


def test_tied_lines(spark, tmp_path):
    rows = [(o, 1, 7, 45.0, f, s) for o in range(40) for f, s in (("R", "F"), ("A", "O"), ("N", "F"), ("A", "F"))]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(o, "1-URGENT", "O") for o in range(40)], "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    found = []
    for n, dealt in enumerate((rows, rows[::-1])):
        d = tmp_path / str(n)
        spark.createDataFrame(dealt, schema).repartition(3).write.parquet(f"{d}/lineitem.parquet")
        (d / "orders.parquet").symlink_to(tmp_path / "orders.parquet")
        cells = nested.nested_cells(spark, str(d)).collect()
        kept = {(r.t, r.row): r.raw_text for r in cells if r.column == 2}
        lines = sorted((r.t, r.row_header[-1], kept[r.t, r.row]) for r in cells if r.column == 1)
        assert lines == sorted((o, f, s) for o, _, _, _, f, s in rows)
        first = {r.t: r.row_header for r in cells if (r.row, r.column) == (1, 1)}
        texts = {r.t: r.text for r in nested.nested_table_texts(spark, str(d)).collect()}
        assert all(f"Key Items: {first[t]}\n" in text for t, text in texts.items())
        found.append((sorted(map(str, cells)), texts))
    assert found[0] == found[1]
