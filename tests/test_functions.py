from pyspark.sql import functions as F

from filingloom.functions import currency, label, period
from filingloom.operators import ordered, reshape
from filingloom.streaming import windows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_header_codes(spark):
    cases = {
        "At March 31, 2024": "Q1-2024", "Three Months Ended June 30, 2024": "Q2-QTD-2024", "Six Months Ended June 30, 2024": "Q2-YTD-2024",
        "Year Ended December 31, 2023": "YTD-2023", "Total": None,
    }
    for text, code in cases.items():
        assert one(spark, text, period.header_code) == code
    assert one(spark, "Q2-QTD-2024", period.display) == "Three Months Ended June 30, 2024"


def test_currency(spark):
    shown = spark.createDataFrame([(18224.0,), (-248.0,), (2.8,), (None,)], "x double").select(currency.currency(F.col("x")))
    assert [r[0] for r in shown.collect()] == ["$18,224", "($248)", "$2.80", None]
    assert [one(spark, v, currency.parse) for v in ("$ (2,173)", "17.4%", "N/M", "x")] == [-2173.0, 17.4, None, None]
    assert one(spark, "$1.5 million", currency.scaled) == 1.5e6


def test_labels(spark):
    assert one(spark, "Total  Net revenues (1)", label.strip_footnote) == "Total  Net revenues"
    assert one(spark, "Total Net Revenues:", label.normalise) == "revenues"


def test_categories(spark):
    rows = [(0, "Consolidated results", None, None), (1, "Net revenues", "18224", "15383"), (2, "Ratios", "Ratios", "Ratios"), (3, "ROE", "-", "0.1"), (4, "", None, None)]
    grid = spark.createDataFrame([("s", *r) for r in rows], "sheet string, i int, c0 string, c1 string, c2 string")
    got = ordered.categories(grid, ["sheet"], "i", "c0", ["c1", "c2"]).orderBy("i").collect()
    assert [(r.c0, r.Category) for r in got] == [("Net revenues", "Consolidated results"), ("ROE", "Ratios")]


def test_unpivot(spark):
    wide = spark.createDataFrame([("a", "$", "1", "2", None)], "Category string, `$ in millions` string, `Q3-2025 IS` string, `YTD-2024` string, Total string")
    got = {(r["Dates"], r["Header"], r["Data Value"]) for r in reshape.to_long(wide).collect()}
    assert got == {("Q3-2025", "IS", "1"), ("YTD-2024", "", "2"), ("Total", "", None)}


def test_stream_gives_the_batch_rows(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{path}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(path)
    run = windows.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(str, spark.table("tumbled").collect())) == sorted(map(str, windows.tumbling(batch).collect()))
