"""Documents as bags of terms: the counts of plain Python, without a shuffle, and what a task keeps between blocks."""

from collections import Counter

from pyspark.sql import functions as F

from filingloom.operators import products, search

TEXTS = {1: "b a  B\ta c", 2: None, 3: " ", 4: "a", 5: "Z z\nZ y " * 3000, 6: "ä Ä a"}


def test_bags_and_terms(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    bags = search.term_bags(docs)
    want = {i: Counter(t.lower().split()) for i, t in TEXTS.items() if t and t.split()}
    assert {r.id: dict(zip(r.terms, r.tfs, strict=True)) for r in bags.collect()} == want
    assert all(r.len == want[r.id].total() for r in bags.collect())
    terms = search.corpus_terms(docs).collect()
    assert {r.term: r.df for r in terms} == {t: sum(t in c for c in want.values()) for c in want.values() for t in c}
    assert sum(r.tokens for r in terms) == sum(c.total() for c in want.values())
    assert "Exchange" not in bags._jdf.queryExecution().executedPlan().toString()


def test_a_task_gives_the_best_of_all_its_blocks(spark):
    """Each pair of blocks gave its own best, so that what was sorted and spilled grew with documents times queries."""
    rows = [(list(range(8 * i, 8 * i + 8)), [["a", "b"]] * 8, [[float(j % 37), j / 1000] for j in range(8 * i, 8 * i + 8)]) for i in range(100)]
    left = spark.createDataFrame(rows, "ids array<long>, terms array<array<string>>, parts array<array<double>>").coalesce(1)
    right = spark.createDataFrame([([1, 2], [["a"], ["a", "b"]], [[1.0], [0.0, 2.0]]), ([3], [["z"]], [[1.0]])], "query_ids array<long>, query_terms array<array<string>>, weights array<array<double>>").coalesce(1)
    got = products.weighed(left.join(right.hint("shuffle_replicate_nl"), F.lit(True), "inner"), 3, 6, "bigint", "bigint").collect()
    best = lambda q: sorted(((-round(r.score, 6), r.id) for r in got if r.query_id == q))[:3]
    assert best(1) == [(-36.0, 36), (-36.0, 73), (-36.0, 110)] and best(2) == [(-1.598, 799), (-1.596, 798), (-1.594, 797)]
    assert len(got) < 10
