"""No order is dropped from the time-series view over all periods."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from filingloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view", [registry.unpivot_quarters_all, lambda s, d: entry.entry(s).unpivot(["section", "label"], None, "Dates", "Data Value")])
def test_every_order_counts(spark, view):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    got = view(spark, DATA)
    assert got.agg(F.sum("Data Value")).first()[0] == pytest.approx(orders.agg(F.sum("o_totalprice")).first()[0])
    years = {r[0] for r in orders.select(F.year("o_orderdate").cast("string")).distinct().collect()}
    assert {r[0] for r in got.select(F.right("Dates", F.lit(4))).distinct().collect()} == years
