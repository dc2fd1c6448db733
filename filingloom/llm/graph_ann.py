"""Nearest neighbours by robust-pruned directed graphs, one for each shard, and beam search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm.common import discard, materialise

DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 128, 1.2
SHARD_ROWS = 16_384
#: Vectors that the centres are fitted on, and cells of a dimension.
SAMPLE_ROWS, MAX_CELLS = 65_536, 4096
#: A query searches as many cells as hold this share of the true neighbours of so many trial vectors.
COVERAGE, TRIALS = 0.98, 128
#: Nodes that each query expands at once.
WIDTH = 4


def _squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", a, a)


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and squared distances of each query's ``beam`` nearest found, nearest first.

    All queries step together: each expands its WIDTH nearest unexpanded nodes,
    until none has one left in its beam.
    """
    nq, n = len(queries), len(x)
    q_norm = _squares(queries)
    seen = np.zeros((nq, n + 1), bool)
    seen[:, n] = True
    ids = np.full((nq, beam), n, np.int64)
    dist = np.full((nq, beam), np.inf, np.float32)
    done = np.ones((nq, beam), bool)
    start = start[:beam]
    k = len(start)
    ids[:, :k] = start
    dist[:, :k] = np.maximum(norms[start] + q_norm[:, None] - 2 * queries @ x[start].T, 0)
    done[:, :k] = False
    seen[:, start] = True
    live = np.arange(nq)
    while len(live):
        open_dist = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(open_dist, min(WIDTH, beam) - 1, axis=1)[:, :WIDTH]
        has = np.isfinite(np.take_along_axis(open_dist, pick, 1))
        go = has.any(1)
        live, pick, has = live[go], pick[go], has[go]
        if not len(live):
            break
        rows = live[:, None]
        done[rows, pick] |= has
        nodes = np.where(has, ids[rows, pick], n)
        near = graph[nodes].reshape(len(live), -1)
        new = ~seen[rows, near]
        # A node that two expanded nodes share counts once.
        near = np.sort(np.where(new, near, n), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        width = int((near < n).sum(1).max())
        if not width:
            continue
        near = np.sort(near, axis=1)[:, :width]
        seen[rows, near] = True
        seen[live, n] = True
        there = np.minimum(near, n - 1)
        far = norms[there] + q_norm[live, None] - 2 * np.einsum("ijk,ik->ij", x[there], queries[live])
        far = np.where(near < n, np.maximum(far, 0), np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], near], 1)
        all_dist = np.concatenate([dist[live], far], 1)
        all_done = np.concatenate([done[live], near >= n], 1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(all_ids, order, 1)
        dist[live] = np.take_along_axis(all_dist, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point at most ``degree`` of its candidates (len(x): none), nearest first; a kept one drops those it is ``alpha`` times nearer to than the point."""
    n = len(x)
    out = np.full((len(points), degree), n, np.int64)
    for lo in range(0, len(points), 512):
        p, c = points[lo : lo + 512], candidates[lo : lo + 512]
        c = np.sort(np.where(c == p[:, None], n, c), axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = n
        v = x[np.minimum(c, n - 1)]
        d = np.where(c < n, _squares(v - x[p][:, None]), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        v = x[np.minimum(c, n - 1)]
        sq = _squares(v)
        between = sq[:, :, None] + sq[:, None] - 2 * v @ v.transpose(0, 2, 1)
        alive = np.isfinite(d)
        at = np.arange(len(p))
        for k in range(degree):
            first = alive.argmax(1)
            some = alive[at, first]
            if not some.any():
                break
            out[lo : lo + 512][some, k] = c[at, first][some]
            alive &= ~(some[:, None] & (alpha * alpha * between[at, first] <= d))
            alive[at, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Out-neighbours (len(x): none) of each row of ``x``, and the start nodes.

    Rows enter in growing batches: a beam search in the graph so far proposes
    each one's neighbours, pruning keeps diverse ones, and the reverse edges are
    added and pruned too.
    """
    n = len(x)
    graph = np.full((n + 1, degree), n, np.int64)
    if n == 0:
        return graph, np.empty(0, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    middle = int(np.argmin(_squares(x - x.mean(0))))
    order = np.concatenate([[middle], order[order != middle]])
    norms = _squares(x)
    start = np.array([middle])
    at, batch = 1, 32
    while at < n:
        new = order[at : at + batch]
        found, _ = beam_search(x, norms, graph, start, x[new], beam)
        candidates = np.where(found < 0, n, found)
        if at + len(new) <= beam:  # the first rows see each other too
            candidates = np.concatenate([candidates, np.broadcast_to(order[: at + len(new)], (len(new), at + len(new)))], 1)
        graph[new] = robust_prune(x, new, candidates, degree, alpha)
        _add_reverse(x, graph, new, degree, alpha)
        at += len(new)
        batch = min(512, batch * 2)
    return graph, start


def _add_reverse(x: np.ndarray, graph: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    n = len(x)
    source = np.repeat(new, degree)
    target = graph[new].reshape(-1)
    source, target = source[target < n], target[target < n]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    used = (graph[nodes] < n).sum(1)
    fits = used + count <= degree
    for i in np.flatnonzero(fits):
        graph[nodes[i], used[i] : used[i] + count[i]] = source[first[i] : first[i] + count[i]]
    full = np.flatnonzero(~fits)
    for lo in range(0, len(full), 256):
        some = full[lo : lo + 256]
        wide = np.full((len(some), degree + int(count[some].max())), n, np.int64)
        wide[:, :degree] = graph[nodes[some]]
        for r, i in enumerate(some):
            wide[r, degree : degree + count[i]] = source[first[i] : first[i] + count[i]]
        graph[nodes[some]] = robust_prune(x, nodes[some], wide, degree, alpha)


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return rows.where(v.isNotNull() & finite & F.exists(v, lambda e: e != 0) & F.col("vec_id").isNotNull())


INDEX = "cell int, shard int, node int, vec_id array<bigint>, v array<double>, near array<int>, start int"


def _centres(sample: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """``n`` centres of the sample rows by Lloyd's method from spread starts."""
    rng = np.random.default_rng(11)
    x = sample.astype(np.float32)
    centres = x[rng.permutation(len(x))[:n]]
    for _ in range(rounds):
        cell = _nearest_cells(x, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        count = np.bincount(cell, minlength=n)[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres).astype(np.float32)
    return centres


def _nearest_cells(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of each row, nearest first."""
    out = []
    for lo in range(0, len(x), 4096):
        d = _squares(centres) - 2 * x[lo : lo + 4096].astype(np.float32) @ centres.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k])
    return np.concatenate(out) if out else np.empty((0, k), np.int64)


@dataclass(frozen=True)
class Index:
    """Graphs by cell and shard, the centres of each dimension's cells, the shards of each cell, the cells that a query needs, and how many ids of equal vectors are kept."""

    graphs: DataFrame
    centres: dict[int, np.ndarray]
    shards: dict[tuple[int, int], int]
    probes: dict[int, int]
    keep_ids: int


def _needed_cells(placed: DataFrame, dim: int, centres: np.ndarray, trials: np.ndarray, k: int = 10) -> int:
    """The cells, nearest first, that hold COVERAGE of the ``k`` true neighbours of the trial vectors: one exact pass over all rows."""

    def nearest(parts):
        for part in parts:
            x = np.stack(part["v"].to_numpy())
            d = _squares(x) - 2 * trials @ x.T
            best = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
            yield pd.DataFrame({
                "trial": np.repeat(np.arange(len(trials)), best.shape[1]), "d": np.take_along_axis(d, best, 1).reshape(-1), "cell": part["cell"].to_numpy()[best].reshape(-1)
            })

    near = placed.where(F.col("dim") == dim).select("v", "cell").mapInPandas(nearest, "trial int, d double, cell int")
    order = Window.partitionBy("trial").orderBy("d", "cell")
    # The nearest is the trial vector itself.
    true = near.withColumn("r", F.row_number().over(order)).where(F.col("r").between(2, k + 1)).select("trial", "cell").toPandas()
    places = np.argsort(_nearest_cells(trials, centres, len(centres)), axis=1)
    found = np.sort(places[true["trial"], true["cell"]])
    return int(found[min(len(found) - 1, int(np.ceil(COVERAGE * len(found))))]) + 1 if len(found) else len(centres)


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("first", ignore_index=True)
    x = np.stack(rows["v"].to_numpy())
    shift = x.mean(0)  # centred, single precision loses least
    graph, start = build_graph((x - shift).astype(np.float32))
    n = len(rows)
    return pd.DataFrame({
        "dim": x.shape[1], "cell": key[1], "shard": key[2], "node": np.arange(n, dtype=np.int32), "vec_id": rows["ids"], "v": rows["v"],
        "near": [g[g < n].astype(np.int32) for g in graph[:n]], "start": int(start[0]),
    })


def _with_cells(df: DataFrame, centres: dict[int, np.ndarray], probes: int, column: str) -> DataFrame:
    """``df`` with an array of each row's ``probes`` nearest cells; a table of centres at most MAX_CELLS large goes to the tasks."""

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        out = [np.empty(0, np.int32)] * len(v)
        sizes = v.map(len).to_numpy()
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            known = centres.get(int(dim))
            found = np.zeros((len(at), 1), np.int64) if known is None else _nearest_cells(np.stack(v.to_numpy()[at]), known, probes)
            for i, f in zip(at, found, strict=True):
                out[i] = f.astype(np.int32)
        return pd.Series(out, dtype=object)

    return df.withColumn(column, cells("v"))


def build_index(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep_ids: int = 11, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS
) -> Index:
    """Graphs over all rows, one for each shard of a cell, as a table of one row per distinct vector.

    A sample of at most ``sample_rows`` vectors, those with the smallest hashes,
    gives the centres of about rows / ``shard_rows`` cells (MAX_CELLS at most);
    every vector goes to the cell of its nearest centre, and cells of more than
    ``2 * shard_rows`` vectors are dealt to several shards by a hash. Equal
    vectors are one node with the ``keep_ids`` smallest of their ids, which is
    all that a search for ``keep_ids - 1`` others can return; each task takes the
    limit before the shuffle, so that a vector with a third of all rows stays
    small. TRIALS of the sample are held against all rows, to learn how many cells
    a query needs. Vectors null, zero or with null or non-finite components aren't
    indexed; those of another length have cells of their own. A repeated id with
    other vectors is a node for each.
    """
    rows = _valid(df, id_col, vector_col)
    rank = Window.partitionBy("v").orderBy("vec_id")
    once = rows.distinct().withColumn("r", F.row_number().over(rank)).where(F.col("r") <= keep_ids)
    nodes = once.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = materialise(nodes.select("v", "ids", F.get("ids", F.lit(0)).alias("first"), F.size("v").alias("dim")), "vectors")
    centres, trials = {}, {}
    for r in nodes.groupBy("dim").count().where(F.col("count") > 2 * shard_rows).collect():
        n = min(-(-r["count"] // shard_rows), MAX_CELLS, sample_rows // 8)
        sample = nodes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("v"), "first").limit(sample_rows).select("v").toPandas()["v"]
        trials[r["dim"]] = np.stack(sample.to_numpy()[:TRIALS])
        centres[r["dim"]] = _centres(np.stack(sample.to_numpy()), n)
    placed = materialise(_with_cells(nodes, centres, 1, "cells").withColumn("cell", F.get("cells", F.lit(0))).drop("cells"), "placed_vectors")
    # One count for each cell: at most MAX_CELLS a dimension.
    counts = {(r["dim"], r["cell"]): r["count"] for r in placed.groupBy("dim", "cell").count().collect()}
    shards = {c: -(-n // (2 * shard_rows)) for c, n in counts.items()}
    several = F.create_map(*[x for (d, c), n in sorted(shards.items()) if n > 1 for x in (F.lit(f"{d}/{c}"), F.lit(n))]) if any(n > 1 for n in shards.values()) else None
    parts = F.lit(1) if several is None else F.coalesce(F.try_element_at(several, F.concat_ws("/", "dim", "cell")), F.lit(1))
    probes = {d: _needed_cells(placed, d, c, trials[d]) for d, c in centres.items()}
    dealt = placed.withColumn("shard", F.pmod(F.xxhash64("v"), parts).cast("int"))
    built = dealt.groupBy("dim", "cell", "shard").applyInPandas(_build_shard, "dim int, " + INDEX)
    graphs = materialise(built, "graphs")
    discard(nodes, placed)
    return Index(graphs, centres, shards, probes, keep_ids)


def _search(k: int, beam: int):
    def run(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        index = index.sort_values("node", ignore_index=True)
        x, n = np.stack(index["v"].to_numpy()), len(index)
        graph = np.full((n + 1, DEGREE), n, np.int64)
        for i, near in enumerate(index["near"]):
            graph[i, : len(near)] = near
        shift = x.mean(0)
        small = (x - shift).astype(np.float32)
        norms = _squares(small)
        q, own_ids = np.stack(asked["v"].to_numpy()), asked["query_id"].to_numpy()
        ids, many = index["vec_id"].to_numpy(), index["vec_id"].map(len).to_numpy()
        only = np.array([i[0] for i in ids], np.int64)
        out = []
        for lo in range(0, len(q), 256):
            found, _ = beam_search(small, norms, graph, np.array([index["start"][0]]), (q[lo : lo + 256] - shift).astype(np.float32), beam)
            for r, own in enumerate(own_ids[lo : lo + 256]):
                nodes = found[r][found[r] >= 0]
                score = np.sqrt(((x[nodes] - q[lo + r]) ** 2).sum(1))
                vec = only[nodes]
                if many[nodes].max(initial=1) > 1:
                    vec, score = np.concatenate([ids[i] for i in nodes]), np.repeat(score, many[nodes])
                vec, score = vec[vec != own], score[vec != own]
                best = np.lexsort((vec, score))[:k]
                out.append((np.full(len(best), own), vec[best], score[best]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("query_id", "vec_id", "score"))})

    return run


def search(
    index: Index, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, beam: int = SEARCH_BEAM, probes: int | None = None
) -> DataFrame:
    """The ``k`` nearest of ``index`` found for each query id, without the rows of that id.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (Euclidean
    distance in double precision on the original vectors); ties go to the
    smaller id. A query goes to the cells with the nearest centres and
    beam-searches every shard of them: to ``probes`` cells, or to as many as the
    index found to hold COVERAGE of true neighbours. Vectors with clusters need
    few, however many rows there are; those without any, like random ones, need
    most, and the search is then one of every shard.

    Invalid vectors ask nothing; an empty table gives no rows. An id that repeats
    with other vectors is one query and one candidate: its distance to another is
    the smallest of its vectors'. ``k`` may be at most ``beam``, and one less than
    the ids of equal vectors that the index keeps.
    """
    if k > min(beam, index.keep_ids - 1):
        raise ValueError(f"k is {min(beam, index.keep_ids - 1)} at most, by the beam and the ids that the index keeps of equal vectors")
    asked = _valid(queries, id_col, vector_col).select(F.col("vec_id").alias("query_id"), "v").distinct()
    most = max([1, *index.probes.values()]) if probes is None else probes
    asked = _with_cells(asked, index.centres, most, "cells").withColumn("dim", F.size("v"))
    asked = asked.select("query_id", "v", "dim", F.explode("cells").alias("cell"))
    # The shards of a cell are those that hold its graphs.
    held = index.graphs.select(*[(F.col(c) + 0).alias(c) for c in ("dim", "cell", "shard")]).distinct()
    asked = asked.join(held, ["dim", "cell"])
    found = index.graphs.groupBy("dim", "cell", "shard").cogroup(asked.groupBy("dim", "cell", "shard")).applyInPandas(_search(k, beam), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
