"""Rules and classifier: verdicts against a recomputation, long junk, few bad rows, clean documents of later stages."""

import collections
import math
import random
import re

from filingloom.llm import quality_model, quality_rules, weak_labels

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rules_verdict_from_votes(spark):
    """base_failed and kept of every row from its own counts, with EM run over the rows one by one."""
    rows = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    votes = [[r[n] for n in quality_rules.RULES] for r in rows]
    model = weak_labels.fit_patterns(quality_rules.RULES, [(v, 1) for v in votes], found=quality_rules.FOUND)
    for r, v in zip(rows, votes, strict=True):
        odds = math.log(model.prior_good / (1 - model.prior_good))
        for x, g, b in zip(v, model.bad_if_good, model.bad_if_bad, strict=True):
            odds += 0 if x is None else math.log((1 - g) / (1 - b)) if x else math.log(g / b)
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == base and abs(r.posterior - 1 / (1 + math.exp(-odds))) < 1e-6
        assert r.kept == (not base and odds >= 0)


def junk(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice([f"word{k}" for k in range(40)]) for _ in range(n))


def test_variety_of_long_junk(spark):
    docs = spark.createDataFrame([(n, junk(n, n)) for n in (400, 1999, 2000, 20_000)], "doc_id long, text string")
    assert {r.r_variety for r in quality_rules.judge(docs).collect()} == {0}
    at = quality_model.LABELLERS.index("l_variety")
    m, _ = quality_model.measure([junk(n, n) for n in (400, 1999, 2000, 20_000)])
    assert set(quality_model.votes(m)[:, at]) == {0}
    long = " ".join(r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(60).collect())
    assert quality_model.votes(quality_model.measure([long])[0])[0, at] == 1


def test_stage_learns_from_all_documents_and_keeps_clean_ones(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    clean = docs.join(labels.where("quality = 1"), "doc_id")
    found = quality_model.classify(clean.select(*docs.columns), learn_from=docs).collect()
    assert sum(r.kept for r in found) >= 0.98 * len(found) and any(abs(r.score - r.posterior) > 1e-9 for r in found)
    bad = docs.join(labels.where("quality = 0"), "doc_id").select(*docs.columns)
    rejected = quality_model.classify(bad, learn_from=docs).collect()
    assert sum(not r.kept for r in rejected) >= 0.95 * len(rejected)


def test_few_bad_rows_do_not_cost_clean_ones(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    clean = docs.join(labels.where("quality = 1"), "doc_id").select("doc_id", "text")
    for n in (1, 3, 5):
        bad = spark.createDataFrame([(-k, "$$$ ### |||| <<>> " * 30 + junk(60, k)) for k in range(1, n + 1)], "doc_id long, text string")
        found = {r.doc_id: r.kept for r in quality_model.classify(clean.union(bad)).collect()}
        assert sum(found[d] for d in found if d > 0) >= 0.97 * (len(found) - n)
