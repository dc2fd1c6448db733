"""Fuzzy groups against the sequential rule, title pairs against all pairs."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from filingloom.operators import fuzzy


def plain(label):
    t = (label or "").strip().lower()
    for head in ("total ", "net ", "less: ", "add: "):
        t = t.removeprefix(head)
    return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", t)).strip()


def usable(labels):
    return {plain(x) for x in labels} - {"", "nan", "none", "row label"}


def sequential(tables, least=0.8):
    """Tables one after another, each against the first table of every group."""
    leaders, out = [], {}
    for at, key, title, labels in tables:
        best, score = None, 0.0
        t = (title or "").strip().lower()
        for at2, key2, t2, labels2 in leaders:
            if key2 != (key or ""):
                continue
            ratio = SequenceMatcher(None, t, t2).ratio()
            if ratio < least:
                continue
            overlap = 1.0
            if labels and labels2:
                a, b = usable(labels), usable(labels2)
                overlap = len(a & b) / len(a | b) if a and b else 0.0
                if overlap < least:
                    continue
            if (ratio + overlap) / 2 > score:
                best, score = at2, (ratio + overlap) / 2
        if best is None:
            leaders.append((at, key or "", t, labels))
            out[at] = (at, None)
        else:
            out[at] = (best, round(score, 9))
    return out


def made(n, seed, words):
    rng = random.Random(seed)
    vocabulary = ["loans", "deposits", "net revenues", "total assets", "fees", "credit risk", "margin", "equity", "funding", "tax", "bonds", "swaps"]
    rows = []
    for i in range(n):
        title = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, words)))
        title = "".join(c for c in title if rng.random() > 0.04) if rng.random() < 0.5 else title
        labels = rng.choice([["Total Loans", "Fees:", "net  income"], ["loans", "fees", "income", "tax"], ["loans", "fees", "income", "tax", f"row {i % 9}"], [], None, ["nan", ""], [f"l{j}" for j in range(10 + i % 3)]])
        rows.append((i, rng.choice(["a::X", "a::X", "b::Y", None]), rng.choice([title, title, title.upper(), None if i % 50 == 0 else title]), labels))
    return rows


@pytest.mark.parametrize(("n", "first", "words"), [(2000, 256, 4), (300, 8, 2)])
def test_groups_are_those_of_the_sequential_rule(spark, monkeypatch, n, first, words):
    monkeypatch.setattr(fuzzy, "FIRST_ROUND", first)
    rows = made(n, 7, words)
    df = spark.createDataFrame(rows, "at long, key string, title string, labels array<string>").repartition(4)
    got = {r.at: (r.group, None if r.score is None else round(r.score, 9)) for r in fuzzy.fuzzy_groups(df, "at", "key", "title", "labels").collect()}
    want = sequential(rows)
    assert got == want and 1 < len({g for g, _ in want.values()}) < n


def test_families_and_odd_tables(spark):
    family = [(i, "k", f"Consolidated statement of cash flows, part {i}", ["a", "b"]) for i in range(600)]
    df = spark.createDataFrame(family, "at long, key string, title string, labels array<string>")
    done = fuzzy.fuzzy_groups(df, "at", "key", "title", "labels")
    assert {r.group for r in done.collect()} == set(g for g, _ in sequential(family).values())
    assert fuzzy.fuzzy_groups(df.where("false"), "at", "key", "title", "labels").count() == 0


def test_title_pairs(spark):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("abc d") for _ in range(rng.randint(0, 9))) for _ in range(250)} | {"x" * 300, "x" * 310, "é\U0001f600"})
    df = spark.createDataFrame([(1, t) for t in texts], "key int, title string")
    for least in (0.7, 0.8, 0.95):
        got = {(r.title, r.of): r.ratio for r in fuzzy.title_pairs(df, df, least).collect()}
        want = {(a, b): r for a in texts for b in texts if (r := SequenceMatcher(None, a, b).ratio()) >= least}
        assert got == want


def test_merge_scores_and_search(spark):
    df = spark.createDataFrame([
        ("Net Revenues", "net revenues by type", ["a", "b"], ["A", "b"], "p", "p"), ("Net Revenues", "Net Revenue", ["a", "b"], ["A", "total b"], "p", "p"),
        ("Net Revenues", "Net Revenue", ["a", "b"], ["a", "c"], "p", "p"), ("Net Revenues", "Net Revenue", ["a"], ["a"], "p", "q"), ("", "x", ["a"], ["a"], "p", "p"),
    ], "t string, u string, a array<string>, b array<string>, p string, q string")
    got = [tuple(r.m) for r in df.select(fuzzy.merge_scores(*[F.col(c) for c in "tuabpq"]).alias("m")).collect()]
    ratio = SequenceMatcher(None, "net revenues", "net revenue").ratio()
    assert got == [(False, SequenceMatcher(None, "net revenues", "net revenues by type").ratio(), 0.0, False), (True, ratio, 1.0, True), (False, ratio, 1 / 3, False), (False, ratio, 1.0, False), (False, 0.0, 0.0, False)]
    tables = spark.createDataFrame([(1, "Net revenues", 2024, "Q1"), (2, "Net revenue", 2024, "Q1"), (3, "Net Revenues 2", 2023, "q1 10q"), (4, "Loans", 2023, "Q1"), (5, None, 2023, "Q1"), (6, "net revenues", 2020, "Q1")], "id int, title string, year int, quarter string")
    wanted = spark.createDataFrame([("Net Revenues",), ("LOANS",)], "wanted string")
    found = fuzzy.find_tables(tables, wanted, "title", "year", "quarter", "id", years=[2023, 2024], quarters=["Q1"]).orderBy("year", "quarter", "id").collect()
    assert [(r.wanted, r.id) for r in found] == [("LOANS", 4), ("Net Revenues", 3), ("Net Revenues", 1)]
