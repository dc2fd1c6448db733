"""Blocked products give the rows of the row-by-row search: ties of many copies, odd vectors, small blocks."""

import numpy as np

from filingloom.operators import products, search


def test_blocks_and_rows_agree(spark, monkeypatch):
    monkeypatch.setattr(products, "ROWS", 64)
    monkeypatch.setattr(products, "QUERIES", 7)
    rng = np.random.default_rng(3)
    vectors = [v.tolist() for v in rng.normal(size=(150, 8))] + [[1.0] * 8] * 150
    vectors += [None, [], [None] * 8, [1.0] * 7 + [None], [float("nan")] + [0.0] * 7, [float("inf")] * 8, [5.0] * 3]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<double>").repartition(3)
    asked = df.where("id % 11 = 0 OR id > 299").selectExpr("id AS query_id", "embedding AS query")
    for k in (1, 5, 400):
        rows = lambda found: sorted((r.query_id, r["rank"], r.id, str(r.score)) for r in found.collect())  # noqa: B023, E731
        assert rows(search.knn_blocks(df, asked, k, "id")) == rows(search.knn(df, asked, k, "id", at_most=50))
    assert search.knn_blocks(df.where("false"), asked, 3, "id").count() == 0 and search.knn_blocks(df, asked.where("false"), 3, "id").count() == 0


def test_no_expression_for_each_pair(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    plan = search.knn_blocks(df, df.selectExpr("id AS query_id", "embedding AS query"), 3, "id")._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "CartesianProduct" in plan
