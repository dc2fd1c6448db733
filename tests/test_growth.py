"""Work that grows no faster than its input: what is evaluated once, dealt once, called once for many."""

import datetime as dt
import re
import time

import pandas as pd
from pyspark.sql import functions as F

from filingloom.functions import text, titles
from filingloom.operators import fuzzy, tables
from filingloom.plans import groups, nested, registry
from filingloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(spark, query):
    """Exchanges of a query's plan without broadcasts and adaptive changes."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return len(re.findall(r"(?<!Reused)Exchange hashpartitioning", query(spark, SF)._jdf.queryExecution().executedPlan().toString()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sheets_share_a_python_call(spark):
    index = spark.createDataFrame([(1, 5, "x"), (1, 6, "Net revenues"), (2, 1, ""), (3, 1, "")], "sheet long, at long, title string")
    found = spark.createDataFrame([(1, 1, "net revenues of all"), (2, 7, "b"), (2, 6, "a"), (9, 1, "")], "sheet long, at long, title string")
    done = tables.enhanced_index(index, found)
    assert "CoGroup" not in plan(done)
    assert sorted(((r.sheet, r.at, r.table_at) for r in done.collect()), key=str) == [(1, 5, 1), (1, 6, None), (2, 1, 6), (2, 1, 7), (3, 1, None)]


def test_a_bucket_takes_all_its_contents_in_one_call():
    class Store(list):
        get = lambda self: iter(self)
        appendList = list.extend

    class Handle:
        timers = []

        def getListState(self, name, schema):
            return Store()

        def registerTimer(self, t):
            self.timers.append(t)

    seen = ingest._Seen(dt.timedelta(hours=1))
    seen.init(Handle())
    rows = pd.DataFrame({"hash": ["a", "b", "a"], "file": ["y", "z", "x"], "bytes": [1, 2, 1], "seen": [dt.datetime(2024, 1, 1)] * 3})
    first = pd.concat(seen.handleInputRows(("a",), iter([rows.iloc[:2], rows.iloc[2:]]), None))
    assert list(zip(first["hash"], first["file"], strict=True)) == [("a", "x"), ("b", "z")] and len(Handle.timers) == 1
    assert not list(seen.handleInputRows(("a",), iter([rows]), None))


def test_the_index_is_read_and_no_text_again(spark):
    assert not any("documents" in f for f in registry.bm25_from_index(spark, SF).inputFiles())


def test_long_headers(spark):
    # Words and letters were split anew for each word and letter.
    df = spark.createDataFrame([(("Fees fees of " * 8000).strip(), "1a " + "O'Neil x" * 4000 + "ß éa")], "w string, l string")
    began = time.time()
    row = df.select(text.dedupe_words(F.col("w")).alias("w"), titles.title_letters(F.col("l")).alias("l"), titles.title_letters(F.lit("aB c'd éf 1x\tyZ ǆ")).alias("s")).first()
    assert time.time() - began < 30
    assert row.w == ("Fees of " * 8000).strip() and row.l == "1A " + "O'Neil X" + "o'Neil X" * 3999 + "ß Éa" and row.s == "Ab C'D Éf 1X\tYz Ǆ"


def test_labels_are_made_once(spark):
    a, b = F.split("x", ","), F.split("y", ",")
    df = spark.createDataFrame([("total net loans,Tax", "Loans,tax,nan")], "x string, y string")
    got = df.select(fuzzy.merge_scores(F.lit("A"), F.lit("A"), a, b, F.lit("p"), F.lit("p")).alias("s"))
    assert plan(got).count("(?U)") == 2 and got.first().s.row_overlap == 1.0


def test_wide_lines_are_dealt_once(spark):
    assert exchanges(spark, groups.tables_on_side_whole) <= 2


def test_cells_are_dealt_once(spark):
    assert exchanges(spark, nested.nested_cell_texts) <= 9
    assert exchanges(spark, nested.nested_row_texts) <= 10
