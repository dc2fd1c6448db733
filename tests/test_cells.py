"""The inverted-file index: recall by cells read, exact with all of them, odd vectors."""

import numpy as np
import pytest

from filingloom.operators import cells, search
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "index")
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    cells.store(vectors, path, n=20, id_col="vec_id")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return path, vectors, asked


def test_recall_by_cells_read(spark, stored):
    path, vectors, asked = stored
    exact = {(r.query_id, r.rank, r.id) for r in search.knn(vectors, asked, 10).collect()}
    found = {p: {(r.query_id, r.rank, r.id) for r in cells.search(spark, path, asked, 10, p, id_col="vec_id").collect()} for p in (4, 14, 20)}
    recall = {p: len({x[::2] for x in f} & {x[::2] for x in exact}) / len(exact) for p, f in found.items()}
    print("recall by cells of 20:", recall)
    assert found[20] == exact and recall[4] <= recall[14] and recall[14] >= 0.9
    assert spark.read.parquet(f"{path}/rows").count() == vectors.where("embedding IS NOT NULL").count()


def test_vectors_with_clusters_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 16))
    x = middles[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    cells.store(df, str(tmp_path / "i"), n=12)
    asked = df.where("id % 60 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    got = cells.search(spark, str(tmp_path / "i"), asked, 5, 2)
    want = {(q, i) for q in range(0, 3000, 60) for i in np.argsort(-(x @ x[q]), kind="stable")[:5].tolist()}
    assert len(want & {(r.query_id, r.id) for r in got.collect()}) >= 0.95 * len(want)


def test_only_asked_cells_are_read(spark, stored):
    path, vectors, asked = stored
    one = cells.search(spark, path, asked.limit(1), 3, 1, id_col="vec_id")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and " IN (" not in plan.split("PartitionFilters")[1].split("]")[0] and one.count() <= 3


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, []), (5, [0.5, 0.5]), (6, [1.0, 2.0, 3.0]), (7, [None, 1.0])]
    df = spark.createDataFrame([r for r in rows if r[0] != 6], "id long, embedding array<double>")
    cells.store(df, str(tmp_path / "a"), n=2)
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0])], "query_id long, query array<double>")
    assert [(r.query_id, r.id) for r in cells.search(spark, str(tmp_path / "a"), asked, 5, 9).orderBy("rank").collect()] == [(0, 1), (0, 5)]
    cells.store(df.where("false"), str(tmp_path / "b"))
    assert cells.search(spark, str(tmp_path / "b"), asked, 5, 1).count() == 0


def test_no_expression_for_each_pair(spark, stored):
    path, _, asked = stored
    plan = cells.search(spark, path, asked, 3, 20, id_col="vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "SortMergeJoin" in plan
