"""Ingest of files by content: a stream that keeps what it has seen as keyed state with a timer for its age, and a ledger of what was processed."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A row of the ledger: a content's hash, the file that brought it, its bytes, when it came.
LEDGER = "hash string, file string, bytes long, seen timestamp"


def hashed(files: DataFrame, content: str, file: str, seen: str) -> DataFrame:
    """``hash``, ``file``, ``bytes``, ``seen`` of files with a content; the contents stay behind."""
    raw = F.col(content).cast("binary")
    return files.where(raw.isNotNull()).select(F.sha2(raw, 256).alias("hash"), F.col(file).cast("string").alias("file"), F.octet_length(raw).cast("long").alias("bytes"), F.col(seen).cast("timestamp").alias("seen"))


#: Contents share keyed state by so many leading hexadecimal digits of their hash: a call for each content costs far more than its work.
DIGITS = 3


class _Seen(StatefulProcessor):
    """State of the contents of one bucket: each with when it may be forgotten. The first file that brings a content goes on, with several in one batch the smallest name."""

    def __init__(self, age: timedelta | None):
        self.age = age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("contents", "hash string, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for batch in rows:
            both = batch if best is None else pd.concat([best, batch])
            best = both.sort_values(["hash", "file", "seen"], kind="stable").drop_duplicates("hash")
        if best is None:
            return
        known = {h for h, _ in self.state.get()}
        new = best[~best["hash"].isin(known)]
        if new.empty:
            return
        until = [0] * len(new)
        if self.age is not None:
            until = [int((seen + self.age).timestamp() * 1000) for seen in new["seen"]]
            for t in sorted(set(until)):
                self.handle.registerTimer(t)
        self.state.appendList(list(zip(new["hash"], until, strict=True)))
        yield new[["hash", "file", "bytes", "seen"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = [(h, t) for h, t in self.state.get() if t > expiredTimerInfo.getExpiryTimeInMs()]
        if left:
            self.state.put(left)
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def fresh(files: DataFrame, age: timedelta | None = None, late: str = "1 hour") -> DataFrame:
    """Rows of a stream of ``hashed`` files whose content was not seen before.

    With an ``age`` a content is forgotten once the stream's time has passed it by so much, and
    is new again; ``late`` is how far that time stays behind the newest file.
    State needs the RocksDB provider, see ``configure``.
    """
    marked = files.withWatermark("seen", late) if age is not None else files
    return marked.withColumn("bucket", F.substring("hash", 1, DIGITS)).groupBy("bucket").transformWithStateInPandas(_Seen(age), outputStructType=LEDGER, outputMode="Append", timeMode="none" if age is None else "EventTime")


def configure(spark: SparkSession) -> None:
    """The state store that ``fresh`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def register(batch: DataFrame, batch_id: int, ledger: str) -> None:
    """Write a batch's rows into the ledger; a batch that is run again takes the place of its first try."""
    batch.write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(LEDGER + ", batch long").option("basePath", ledger).parquet(f"{ledger}/batch=*")


def run(files: DataFrame, ledger: str, checkpoint: str, age: timedelta | None = None, late: str = "1 hour", process=None) -> None:
    """Take all files that are there, then stop. ``process(rows, batch_id)`` does a batch's work before it is registered, and must stand being run twice.

    Started again with the same ``checkpoint`` it goes on behind the last finished batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if process is not None:
            process(batch, batch_id)
        register(batch, batch_id, ledger)

    query = fresh(files, age, late).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_once(files: DataFrame, ledger: str, batch_id: int) -> DataFrame:
    """``run`` for a table: registers the smallest file of each content that the ledger doesn't hold, and returns those rows."""
    first = files.groupBy("hash").agg(F.min(F.struct("file", "seen", "bytes")).alias("f")).select("hash", "f.file", "f.bytes", "f.seen")
    try:
        known = ledger_rows(files.sparkSession, ledger).select("hash")
        first = first.join(known, "hash", "left_anti")
    except Exception as e:  # the ledger's first batch has no folder to read
        if "PATH_NOT_FOUND" not in str(e):
            raise
    register(first, batch_id, ledger)
    return files.sparkSession.read.schema(LEDGER).parquet(f"{ledger}/batch={batch_id}")
