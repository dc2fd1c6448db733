"""The ingest stream: no file twice, a restart goes on, a table gives the same, contents are forgotten with age."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from filingloom.streaming import ingest

SCHEMA = "name string, content string, at timestamp"


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ingest.configure(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(spark, folder, rows):
    rows = [(n, c, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for n, c, h in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return ingest.hashed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), "content", "name", "at")


def test_restart_replays_no_file_and_equals_batches(spark, tmp_path):
    folder, ledger, mark = (str(tmp_path / n) for n in ("files", "ledger", "mark"))
    worked = []
    run = lambda: ingest.run(stream(spark, folder), ledger, mark, process=lambda b, i: worked.extend(r.file for r in b.collect()))
    put(spark, folder, [("b", "one", 0), ("a", "one", 1), ("c", "two", 0), ("n", None, 0), ("e", "", 0)])
    run()
    put(spark, folder, [("d", "two", 2), ("f", "three", 2)])
    run()
    run()
    got = {(r.file, r.bytes) for r in ingest.ledger_rows(spark, ledger).collect()}
    assert got == {("a", 3), ("c", 3), ("e", 0), ("f", 5)} and sorted(worked) == ["a", "c", "e", "f"]
    other = str(tmp_path / "other")
    files = lambda *names: ingest.hashed(spark.read.parquet(folder).where(F.col("name").isin(*names)), "content", "name", "at")
    for i, names in enumerate((["b", "a", "c", "n", "e"], ["d", "f"], ["d", "f"])):
        ingest.run_once(files(*names), other, i)
    assert {(r.file, r.bytes) for r in ingest.ledger_rows(spark, other).collect()} == got


def test_a_batch_run_again_is_registered_once(spark, tmp_path):
    rows = spark.createDataFrame([("h", "f", 1, dt.datetime(2024, 1, 1))], ingest.LEDGER)
    for _ in range(2):
        ingest.register(rows, 3, str(tmp_path / "l"))
    assert ingest.ledger_rows(spark, str(tmp_path / "l")).count() == 1


def test_contents_are_forgotten_with_age(spark, tmp_path):
    folder, ledger, mark = (str(tmp_path / n) for n in ("files", "ledger", "mark"))
    for rows in ([("a", "one", 0)], [("b", "one", 3)], [("x", "two", 20)], [("y", "three", 21)], [("c", "one", 22)]):
        put(spark, folder, rows)
        ingest.run(stream(spark, folder), ledger, mark, age=dt.timedelta(hours=5))
    assert sorted(r.file for r in ingest.ledger_rows(spark, ledger).collect()) == ["a", "c", "x", "y"]
