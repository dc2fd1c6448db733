"""An inverted-file vector index: rows written by the cell of their nearest trained centre, searched in the cells nearest to a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.operators import products

#: Cells of an index if nothing else is said; rows from which centres are trained, at most.
CELLS = 100
TRAIN_ROWS = 100_000


def _usable(vector: str) -> str:
    """Vectors with a component, all finite."""
    return f"size({vector}) > 0 AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"


def train(vectors: DataFrame, n: int = CELLS, id_col: str = "id", vector: str = "embedding", rows: int = TRAIN_ROWS) -> list[list[float]]:
    """``n`` centres at most, trained on those ``rows`` vectors whose ids hash lowest: a bounded sample that any reading of the table repeats."""
    usable = vectors.where(_usable(vector))
    sample = usable.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.xxhash64(F.col(id_col)).alias("h")).orderBy("h").limit(rows)
    if sample.isEmpty():
        return []
    return [c.tolist() for c in KMeans(k=n, seed=1, maxIter=10).fit(sample).clusterCenters()] if n > 1 else [[0.0] * len(usable.first()[vector])]


def _nearest(batches: Iterator[pa.RecordBatch], centres: np.ndarray, column: str, probes: int) -> Iterator[pa.RecordBatch]:
    """Batches with ``cell``: the numbers of the nearest centres, nearest first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        d = (centres**2).sum(1) - 2 * x @ centres.T
        near = np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cell"])


def _celled(rows: DataFrame, centres: list[list[float]], column: str, probes: int) -> DataFrame:
    c = np.array(centres)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda b: _nearest(b, c, column, probes), f"{fields}, cell array<int>")


def store(vectors: DataFrame, path: str, n: int = CELLS, id_col: str = "id", vector: str = "embedding", rows_per_file: int = 1_000_000) -> None:
    """Write the index: ``centres``, and ``rows`` in a folder for each cell, with the other columns of ``vectors`` beside them.

    Every usable vector is indexed (finite components, the centres' number of
    them); null and other ones are not. Rows are dealt by ranges of cell and id, so
    a cell with a third of all rows is many tasks' and many files.
    """
    spark = vectors.sparkSession
    centres = train(vectors, n, id_col, vector)
    spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    usable = vectors.where(_usable(vector)).where(F.size(vector) == (len(centres[0]) if centres else -1))
    placed = _celled(usable, centres, vector, 1).withColumn("cell", F.get("cell", F.lit(0))) if centres else usable.withColumn("cell", F.lit(0))
    placed.repartitionByRange("cell", id_col).sortWithinPartitions("cell").write.partitionBy("cell").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, id_col: str = "id", vector: str = "embedding", where: str | None = None) -> DataFrame:
    """The ``k`` rows of largest inner product for each query (``query_id``, ``query``) among those in its ``probes`` nearest cells: ``query_id, id, score, rank``.

    As many probes as cells search all rows and are exact. Only folders of
    cells that some query asks for are read. A cell's rows meet the queries that ask for
    it and no others; each task keeps the best ``k`` of a query before its shuffle.
    ``where`` is a filter on the stored columns that holds before the k best are taken.
    Queries of other lengths find nothing.
    """
    centres = [r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]
    out = "query_id bigint, id bigint, score double, rank int"
    if not centres:
        return spark.createDataFrame([], out)
    fit = queries.where(_usable("query")).where(F.size("query") == len(centres[0])).select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    asked = _celled(fit, centres, "query", probes).select("query_id", "query", F.explode("cell").alias("cell"))
    # As many numbers as there are cells, at most.
    cells = [r.cell for r in asked.select("cell").distinct().collect()]
    rows = spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(cells))
    rows = rows if where is None else rows.where(where)
    left = products.packed(rows.select("cell", F.col(id_col).cast("long").alias("ids"), F.col(vector).alias("rows")), ["ids", "rows"], products.ROWS, "cell")
    # Queries of a cell in blocks that are dealt anew, as each task has a few of every cell's.
    dealt = asked.select("cell", F.col("query_id").alias("query_ids"), F.col("query").alias("queries")).repartition("cell").sortWithinPartitions("cell")
    right = products.packed(dealt, ["query_ids", "queries"], products.QUERIES, "cell")
    scored = products.candidates(left.join(right.hint("merge"), "cell"), k, "bigint", "bigint")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return scored.withColumn("rank", best).where(F.col("rank") <= k)
