"""Clusters around centroids in exact integers, with Hamerly's bounds kept between rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import discard, materialise

#: Integer components lie within so much, so that squared distances and their sums fit 64 bits.
LARGEST = 1 << 27
#: Below so much, products of 64 components are exact in double precision.
EXACT = 1 << 22
#: Bounds are rounded outwards by so much; what lies within is scanned in integers.
SLACK = 1e-6
#: ``sums`` is set in a task's last rows alone: one for each of its clusters, with its rows and componentwise sums.
STATE = "vec_id bigint, v binary, cluster int, upper double, lower double, distance bigint, sums array<bigint>"
_TYPES = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64()), ("sums", pa.list_(pa.int64()))])


def integers(vector: Column, dim: int, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null unless there are ``dim``, all finite and within ``LARGEST``."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * F.lit(float(scale))) > LARGEST))
    return F.when((F.size(vector) == dim) & ~bad, scaled)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows by centroids), exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT and x.shape[1] <= 64:
        xf, cf = x.astype(np.float64), centroids.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


class Assigner:
    """Assigns vectors to the nearest of ``centroids``; with the centroids of the round before it uses the bounds that they left."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids, self.before = centroids, before
        k = len(centroids)
        apart = np.sqrt(distances(centroids, centroids).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2 if k > 1 else np.full(k, np.inf)
        if before is not None:
            self.drift = np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64))
            # The largest drift of any other centroid.
            order = np.argsort(-self.drift, kind="stable")
            self.others = np.full(k, self.drift[order[0]])
            self.others[order[0]] = self.drift[order[1]] if k > 1 else 0.0

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[cluster]) ** 2).sum(1)

    def full(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest (ties: smaller number), bound above its distance, bound below that of the second nearest."""
        d = distances(x, self.centroids)
        rows, near = np.arange(len(d)), d.argmin(1)
        best = d[rows, near]
        d[rows, near] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(d), np.inf)
        return near, np.sqrt(best.astype(np.float64)), second

    def __call__(self, x: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.before is None:
            return self.full(x)
        cluster, upper, lower = cluster.copy(), upper + self.drift[cluster], lower - self.others[cluster]
        floor = np.maximum(self.half[cluster], lower)
        unsure = lambda at: upper[at] * (1 + SLACK) + SLACK >= floor[at]
        at = np.flatnonzero(unsure(slice(None)))
        upper[at] = np.sqrt(self.own(x[at], cluster[at]).astype(np.float64))
        at = at[unsure(at)]
        if len(at):
            cluster[at], upper[at], lower[at] = self.full(x[at])
        return cluster, upper, lower


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    raw = b"".join(column.to_pylist()) if column.offset else memoryview(column.buffers()[2] or b"")[: 4 * dim * len(column)]
    return np.frombuffer(raw, np.int32).reshape(len(column), dim).astype(np.int64)


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Rows and componentwise sums by cluster."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    order = np.argsort(cluster, kind="stable")
    present, starts = np.unique(cluster[order], return_index=True)
    if len(present):
        out[present, 1:] = np.add.reduceat(x[order], starts, axis=0)
        out[present, 0] = np.diff([*starts, len(cluster)])
    return out


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, before: np.ndarray | None, last: bool) -> Iterator[pa.RecordBatch]:
    k, dim = centroids.shape
    assign, sums = Assigner(centroids, before), np.zeros((k, dim + 1 if not last else 2), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        if before is None:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            cluster, upper, lower = assign(x, None, None, None)
        else:
            x = _vectors(batch.column(1), dim)
            cluster, upper, lower = assign(x, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)))
        if last:
            d = assign.own(x, cluster)
            sums += _sums(d[:, None], cluster, k)
            columns = [ids, pa.nulls(len(ids), pa.binary()), pa.array(cluster, pa.int32()), *[pa.nulls(len(ids), pa.float64())] * 2, pa.array(d)]
        else:
            sums += _sums(x, cluster, k)
            packed = x.astype(np.int32).tobytes()
            offsets = np.arange(len(ids) + 1, dtype=np.int32) * (4 * dim)
            v = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
            columns = [ids, v, pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.nulls(len(ids), pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(ids), pa.list_(pa.int64()))], schema=_TYPES)
    at = np.flatnonzero(sums[:, 0])
    if len(at):
        n = len(at)
        columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(at, pa.int32()), *[pa.nulls(n, pa.float64())] * 2, pa.nulls(n, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sums[at].tolist(), pa.list_(pa.int64()))], schema=_TYPES)


def _totals(state: DataFrame) -> dict[int, list[int]]:
    """By cluster, the sums of all tasks: at most clusters times components, whatever the table's size."""
    parts = state.where("sums IS NOT NULL").select("cluster", F.posexplode("sums"))
    out: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect():
        out.setdefault(r.cluster, {})[r.pos] = int(r.total)
    return {c: [s[i] for i in range(len(s))] for c, s in out.items()}


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 256, seed: int = 2
) -> tuple[DataFrame, list[list[int]], dict[int, int]]:
    """Assignments (``vec_id``, ``cluster``, squared ``distance``), the final centroids, and the summed distance by cluster.

    Vectors of ``dim`` finite components become integers ``floor(scale * x)``.
    Centroids start as the ``k`` vectors whose ids hash lowest. A round assigns each
    vector to the nearest (ties: smaller number) and replaces every centroid
    that has vectors by their floored mean; after ``rounds`` of them vectors are assigned once more.

    Each vector keeps a bound above the distance of its centroid and one below that
    of the second nearest. Both are loosened by what the centroids moved; a vector
    that they leave unsure is measured against its own centroid, and if that does
    not settle it against all, in exact integers. A pass reads and writes the state once, in the shared
    folder, without a shuffle; its tasks add their sums, and only those reach the driver.

    Vectors that are null, of another length, hold null or non-finite components or
    components beyond ``LARGEST`` after scaling take no part. Null ids take part and hash as empty ones; rows that
    repeat count each. Fewer vectors than ``k`` are as many centroids; an empty
    table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vec_col), dim, scale).alias("x")).where("x IS NOT NULL")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = [r.x for r in kept.orderBy(order, "x").limit(k).collect()]
    if not start:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), [], {}
    now, before, state = np.array(start, np.int64), None, kept
    for _ in range(rounds):
        new = materialise(state.mapInArrow(lambda b, now=now, before=before: _assign(b, now, before, False), STATE), "cluster_state")
        if before is not None:
            discard(written)
        written, before = new, now
        now = now.copy()
        for c, (n, *sums) in _totals(written).items():
            now[c] = [s // n for s in sums]
        state = written.where("sums IS NULL")
    final = materialise(state.mapInArrow(lambda b: _assign(b, now, before, True), STATE), "clusters")
    if before is not None:
        discard(written)
    inertia = {c: d for c, (_, d) in _totals(final).items()}
    return final.where("sums IS NULL").select("vec_id", "cluster", "distance"), now.tolist(), inertia


def report(vectors: DataFrame, **options) -> DataFrame:
    """``cluster`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` (of its components joined by commas) in each row."""
    assigned, centroids, inertia = cluster(vectors, **options)
    total = sum(inertia.values())
    rows = [(c, d, total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in inertia.items()]
    # A row for each cluster: as many as the parameter says.
    facts = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
