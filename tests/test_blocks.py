"""Whole blocks: shared sequences without pairs, fingerprints that are confirmed, tables of very many labels."""

from pyspark.sql import functions as F

from filingloom.operators import blocks


def test_a_sequence_that_many_blocks_share(spark):
    n = 20_000
    rows = spark.range(n * 3).select(F.lit("s").alias("sheet"), (F.col("id") % n).alias("block"), F.floor(F.col("id") / n).alias("at"), F.concat(F.lit("  Label "), F.floor(F.col("id") / n).cast("string")).alias("label"))
    other = spark.createDataFrame([("s", 10**6, 0, "label 1"), ("s", 10**6, 1, "label 0"), ("s", 10**6, 2, "label 2"), ("s", 10**6 + 1, 5, None), ("s", 10**6 + 2, 7, "")], "sheet string, block long, at long, label string")
    got = {r.block: (r.group, r.blocks) for r in blocks.sequence_groups(rows.unionByName(other), ["sheet"], "block", "at", "label").collect()}
    assert len(got) == n + 2 and got[17] == (0, n) and 10**6 not in got and got[10**6 + 2] == (10**6 + 1, 2)
    assert blocks.sequence_groups(rows.where("false"), ["sheet"], "block", "at", "label").count() == 0


def test_equal_fingerprints_of_other_sequences(spark, monkeypatch):
    # With fingerprints that only count rows, the comparison of the labels has to tell sequences apart.
    monkeypatch.setattr(blocks, "_fingerprint", lambda at, value: [F.count("*").alias("n"), F.lit(0).alias("f1"), F.lit(0).alias("f2")])
    rows = spark.createDataFrame([("s", b, i, x) for b, w in enumerate(["ab", "ab", "ba", "abc", "ba", "zz"]) for i, x in enumerate(w)], "sheet string, block long, at long, label string")
    got = {r.block: r.group for r in blocks.sequence_groups(rows, ["sheet"], "block", "at", "label").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 4: 2}


def test_merge_beside(spark):
    grids = {1: [["", "2023"], ["Revenue", "1000"], ["Profit", "100"]], 2: [["", "2024", "2023"], ["revenue", "1200", "1000"], ["PROFIT", "120", "100"]], 3: [["", "x"], ["other", "1"]]}
    cells = [("s", b, r, c + 1, v) for b, g in grids.items() for r, line in enumerate(g) for c, v in enumerate(line)]
    df = spark.createDataFrame(cells, "sheet string, block int, row int, col int, v string")
    groups = blocks.sequence_groups(df.where("col = 1"), ["sheet"], "block", "row", "v")
    done = blocks.merge_beside(df, groups, ["sheet"], "block", "row", "col", "v").orderBy("row", "col").collect()
    assert [(r.block, r.row, r.col, r.v) for r in done] == [
        (1, 0, 1, ""), (1, 0, 2, "2023"), (1, 0, 3, "2024"), (1, 1, 1, "Revenue"), (1, 1, 2, "1000"), (1, 1, 3, "1200"), (1, 2, 1, "Profit"), (1, 2, 2, "100"), (1, 2, 3, "120")
    ]


def test_twelve_thousand_labels_on_their_side(spark):
    wide = spark.range(12_000).select(
        F.lit(1).alias("t"), F.col("id").alias("r"), F.lit(None).cast("string").alias("s"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("l"),
        F.col("id").cast("string").alias("Q1-2024"), F.when(F.col("id") % 2 == 0, "x").alias("Q2-2024 IS"),
    )
    rows, columns = blocks.on_side(wide, ["t"], "r", "l", "s", ["Q1-2024", "Q2-2024 IS"])
    assert sorted((r.Dates, r.Header, len(r.cells)) for r in rows.collect()) == [("Q1-2024", "", 12_000), ("Q2-2024", "IS", 6_000)]
    assert columns.count() == 12_000 and columns.where("column = 12").first().label == "Row 11"
    back = {(r.label, r.Dates): r.value for r in blocks.cells_of(rows, columns, ["t"]).collect()}
    assert back == {(f"Row {i}", "Q1-2024"): str(i) for i in range(12_000)} | {(f"Row {i}", "Q2-2024"): "x" for i in range(0, 12_000, 2)}
    none, _ = blocks.on_side(wide.where("false"), ["t"], "r", "l", "s", ["Q1-2024"])
    assert none.count() == 0
