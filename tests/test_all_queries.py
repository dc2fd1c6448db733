"""Every row whose id is divisible by 50 is searched for, and no query is broadcast."""

import pytest

from filingloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["knn_topk_all", "rrf_fusion_all", "weighted_fusion_all", "mrr_precision_all"])
def test_every_query(spark, name):
    want = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    assert len(want) > 4 and {r.query_id for r in registry.QUERIES[name](spark, DATA).select("query_id").distinct().collect()} == want


def test_no_broadcast(spark):
    plan = registry.knn_topk_all(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
