"""Vector tables: unit-length embeddings beside their text and metadata, as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(vector: Column) -> Column:
    """The vector at length 1, in double precision; a zero vector stays, null stays null."""
    v = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x))


def plain_metadata(df: DataFrame, columns: list[str]) -> Column:
    """Map of the non-null ``columns`` as texts; nested values as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    entries = F.array(*[F.struct(F.lit(c).alias("key"), (F.to_json(c) if c in nested else F.col(c).cast("string")).alias("value")) for c in columns])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def rows(df: DataFrame, id_col: str, vector: str, text: str, metadata: list[str]) -> DataFrame:
    """(id, text, metadata, embedding) of a vector table."""
    return df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), plain_metadata(df, metadata).alias("metadata"), unit(F.col(vector)).alias("embedding"))


def append(table: DataFrame, path: str) -> None:
    table.write.mode("append").parquet(path)


def without_source(table: DataFrame, source: str) -> DataFrame:
    """All rows but those of one source; rows without a source stay."""
    return table.where(~F.coalesce(F.col("metadata")["source_doc"] == source, F.lit(False)))


def stats(table: DataFrame) -> DataFrame:
    """One row: chunks, distinct sources, sorted years, dimension."""
    m = F.col("metadata")
    return table.agg(F.count("*").alias("total_chunks"), F.countDistinct(m["source_doc"]).alias("sources"), F.array_join(F.sort_array(F.collect_set(m["year"])), ",").alias("years"), F.max(F.size("embedding")).cast("long").alias("dimension"))


def migrate(spark: SparkSession, source: str, target: str) -> tuple[int, int]:
    """Copy the sound rows (an id and an embedding) of one vector table to another; rows read and rows written."""
    table = spark.read.parquet(source)
    sound = table.where(F.col("id").isNotNull() & F.col("embedding").isNotNull())
    sound.write.parquet(target)
    return table.count(), spark.read.parquet(target).count()
