"""The sink of tables: read back equal, nothing of a job that failed, nothing twice."""

import os

import pytest
from pyspark.sql import functions as F

from filingloom.sources import table_sink


def test_read_back(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("A", 'say "x", y', "1"), ("A", "two\nlines", "2"), ("B", "é", "3"), ("C", " blank ", "4")]
    df = spark.createDataFrame(rows, "Table_ID string, text string, n string").repartition(3)
    table_sink.write_tables(df, path)
    table_sink.write_tables(df.where("Table_ID = 'B'").withColumn("n", F.lit("9")), path)
    table_sink.write_tables(df.where("false"), path)
    assert sorted(map(tuple, table_sink.read_tables(spark, path).collect())) == sorted([*rows, ("B", "é", "9")])
    assert not os.path.exists(f"{path}/_started")


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(400).repartition(4).select(F.col("id").alias("Table_ID"), F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="broken"):
        table_sink.write_tables(df, path)
    # A task that outlives the abort may leave its file among the started ones, which no reader reads.
    assert [f for at, _, files in os.walk(path) for f in files if "_started" not in at] == []
    table_sink.write_tables(df.where("Table_ID < 300"), path)
    assert table_sink.read_tables(spark, path).count() == 300
