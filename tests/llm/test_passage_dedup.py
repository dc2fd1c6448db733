"""Repeated runs of lines go, whatever stands around them, and one copy of each line stays."""

import collections
import re

import pytest

from filingloom.llm import line_dedup

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_exact_copy_of_long_and_short_lines(spark):
    text = "\n".join([line("long", 60), "short", line("more", 60), "brief line", line("last", 60)])
    docs = spark.createDataFrame([(1, text), (2, text), (3, "a\nb"), (4, "a\nb")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert (got[1].text, got[1].removed_lines) == (text, 0)
    assert (got[2].text, got[2].removed_lines) == ("", 5)
    assert (got[3].text, got[4].text) == ("a\nb", "")


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_passage_of_short_lines(spark, n):
    passage = [line(f"p{k}x", 60 // n) for k in range(n)]
    around = lambda d: ([f"before {d} {k}" for k in range(5)], [f"after {d} {k}" for k in range(5)])
    docs = [(d, "\n".join(around(d)[0] + passage + around(d)[1])) for d in (1, 2, 3)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1]
    for d in (2, 3):
        assert got[d] == "\n".join(around(d)[0] + around(d)[1])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, " \n\t", "z"), (4, " \n\t", "z"), (5, "one", "u"), (6, "one", "v")], "doc_id long, text string, removed_lines string")
    done = line_dedup.line_dedup(docs)
    assert done.columns == [*docs.columns, "removed_lines_"]
    assert sorted(tuple(r) for r in done.collect()) == sorted((*r, 0) for r in map(tuple, docs.collect()))
    assert line_dedup.line_dedup(docs.where("false")).count() == 0


def test_all_repeats_go(spark):
    """On the smallest tables: no passage of over fifty words stands twice, no line is lost."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: (r.text or "").split("\n") for r in docs.collect()}
    after = {r.doc_id: (r.text or "").split("\n") for r in line_dedup.line_dedup(docs).collect()}
    assert {x for t in before.values() for x in t} | {""} == {x for t in after.values() for x in t} | {""}

    words = lambda t: len(WORD.findall("\n".join(t)))
    first, gone = {}, collections.defaultdict(set)
    for i, t in sorted(before.items()):
        for a in range(len(t)):
            b = next((b for b in range(a, len(t)) if words(t[a : b + 1]) > 50), None)
            if b is None:
                break
            if words(t[a : a + 1]) and first.setdefault(tuple(t[a : b + 1]), (i, a)) != (i, a):
                gone[i].update(range(a, b + 1))
    for i, lines in gone.items():
        stays = collections.Counter(x for k, x in enumerate(before[i]) if k not in lines)
        assert not collections.Counter(after[i]) - stays - collections.Counter([""])


def test_one_passage_in_a_third_of_the_rows(spark):
    """Nothing is broadcast, and each document but the first loses the passage."""
    passage = "\n".join(line(f"hot{k}x", 20) for k in range(4))
    docs = [(d, f"own {d} a\nown {d} b\n" + (passage if d % 3 == 0 else line(f"d{d}x", 60)) + f"\nend {d}") for d in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = line_dedup.line_dedup(df)
        assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
        got = {r.doc_id: r.text for r in done.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {d: f"own {d} a\nown {d} b\nend {d}" if d and d % 3 == 0 else t for d, t in docs}


def test_equal_digests_of_other_texts_are_spared(spark, monkeypatch):
    """With digests that all collide nothing is equal, so nothing goes."""
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: line_dedup.F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a b\nc d"), (2, "a b\nc d"), (3, "e f\ng h")], "doc_id long, text string")
    rows = line_dedup.line_dedup(docs).select("doc_id", "text", "removed_lines").collect()
    assert sorted(map(tuple, rows)) == [(1, "a b\nc d", 0), (2, "a b\nc d", 0), (3, "e f\ng h", 0)]


def test_added_names_are_new(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x")], "doc_id long, text string, Removed_Lines string")
    done = line_dedup.line_dedup(docs)
    assert done.columns == [*docs.columns, "removed_lines_"]
    assert tuple(done.first()) == (1, "a\nb", "x", 0)
