"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: U+0020 and U+0009 to U+000D, nothing else.
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).

    Only a local master, where driver and executors are one process, may fall
    back to a temporary folder; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="filingloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/filingloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}/{name}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path.rsplit("/", 1)[0])


def release(spark: SparkSession) -> None:
    """Delete all that this application's operators wrote to the shared folder; results not yet read are lost."""
    _delete(spark, _own_dir(spark))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often that refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with ``_`` at its end until no column of ``taken`` has it, whatever its case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def readable(text: Column) -> Column:
    """``text`` as Python can decode it: bytes that are no UTF-8, which Spark's strings may hold, become U+FFFD."""
    return F.make_valid_utf8(text)


def row_key(id_col: Column, text: Column) -> list[Column]:
    """Identity of a document row: its id and a hash of its text, never null."""
    return [F.coalesce(id_col, F.lit(-(2**63))).alias("_id"), F.xxhash64(id_col, text).alias("_h")]


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in ``rejected`` (columns ``_id`` and ``_h``).

    Both sides are merged by the key at any size, so that nothing that grows
    with the data is broadcast.
    """
    i, h = row_key(F.col(id_col), F.col(text_col))
    names = docs.columns
    keyed = docs.select("*", i.alias("__key_id"), h.alias("__key_h"))
    gone = rejected.select(F.col("_id").alias("__key_id"), F.col("_h").alias("__key_h")).distinct()
    return keyed.join(gone.hint("merge"), ["__key_id", "__key_h"], "left_anti").select(*names)
