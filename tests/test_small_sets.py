"""Tables of few labels make pairs as all others do."""

from filingloom.plans import registry, texts


def test_small_sets_make_pairs(spark, tmp_path):
    """Orders of one to three brands were left out."""
    lines = [(1, 3), (2, 3), (2, 43), (3, 1), (3, 2), (3, 5), (4, 1), (4, 2), (4, 5), (4, 6), (5, 1), (5, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in texts.mergeable_tables(spark, str(tmp_path)).collect())
    assert got == [(1, 2, 1.0), (3, 4, 0.75)]
    assert "> 3" not in registry.SQL["mergeable_tables"]
