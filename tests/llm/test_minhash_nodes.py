"""Near duplicates of ids with several texts, and of large groups that share boilerplate only."""

import random

from filingloom.llm import minhash


def test_ids_with_several_texts_link_all_of_them(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b = words(60), words(60)
    for b_ in (b, b + " two more"):
        docs = [(5, a), (5, b_), (7, a + " z"), (9, b_ + " z"), (11, words(60)), (11, ""), (None, a), (13, None), (13, a)]
        got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got}
        n = len(b_.split()) - 4
        assert len(got) == len(docs) and found[5, 56] == found[5, n] == (5, True)
        assert found[7, 57] == found[9, n + 1] == found[13, 56] == found[13, 0] == (5, False)
        assert found[11, 56] == found[11, 0] == (11, True) and found[None, 56] == (None, False)


def boilerplate(n, shared, own, seed=4):
    """Documents that share their first words, links among neighbours in the list by construction."""
    rng = random.Random(seed)
    hot = [f"h{i}" for i in range(shared)]
    docs = []
    for g in range(n):
        tail = [f"g{g}x{i}" for i in range(own)]
        docs.append((2 * g, " ".join(hot + tail)))
        if g % 3 == 0:  # a near copy, one word changed
            tail = list(tail)
            tail[rng.randrange(own)] = "changed"
            docs.append((2 * g + 1, " ".join(hot + tail)))
    return docs


def expected(docs, shared, own):
    """Similarities by construction: two of a pair share all but five shingles, others the hot ones only."""
    n = shared + own - 4
    assert 100 * (shared - 4) < 75 * (2 * n - (shared - 4)) and 100 * (n - 5) >= 75 * (n + 5)
    return {d: d - d % 2 for d, _ in docs}


def test_boilerplate_of_half_and_of_most(spark):
    for shared, own in ((60, 60), (104, 30)):
        docs = boilerplate(1200, shared, own)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == expected(docs, shared, own)


def test_split_buckets_give_the_same(spark, monkeypatch):
    docs = boilerplate(150, 104, 30)
    monkeypatch.setattr(minhash, "SPLIT", 4)
    monkeypatch.setattr(minhash, "PAIRS_A_MEMBER", 1)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == expected(docs, 104, 30)
