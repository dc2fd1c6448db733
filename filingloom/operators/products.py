"""Inner products of rows and queries by blocks: a pair of blocks is one matrix product, and gives the rows of each query that can be among its best."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

#: Rows and queries of a block; bounds memory, not results.
ROWS, QUERIES = 4096, 1024
#: Documents and queries of terms of a block.
DOCUMENTS, TERM_QUERIES = 512, 512
#: Queries of terms that travel together, as each row of them meets each block of documents.
QUERY_ROWS = 8192
#: Scores so near to the last of the best are kept, as ranks are by rounded scores.
MARGIN = 1e-8


def packed(rows: DataFrame, names: Sequence[str], size: int, by: str | None = None) -> DataFrame:
    """Arrays of ``names`` over at most ``size`` rows of one task and one ``by``."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join([f"`{n}` array<{kinds[n]}>" for n in names] + ([f"`{by}` {kinds[by]}"] if by else []))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            keys = whole.column(by).unique() if by and whole.num_rows else [None]
            for key in keys:
                mine = whole.filter(pa.compute.equal(whole.column(by), key)) if by and len(keys) > 1 else whole
                for lo in range(0, mine.num_rows, size):
                    part = mine.slice(lo, size)
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(n)])) for n in names]
                    yield pa.RecordBatch.from_arrays([*lists, *([part.column(by).slice(0, 1)] if by else [])], names=[*names, *([by] if by else [])])

    return rows.select(*names, *([by] if by else [])).mapInArrow(pack, out)


def _matrices(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length that have no nulls."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    values = vectors.flatten()
    if values.null_count:
        lengths = np.array([-1 if v is None or None in v else len(v) for v in vectors.to_pylist()])
    out = {}
    for n in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == n)
        own = values if len(at) == len(vectors) else vectors.take(pa.array(at)).flatten()
        out[n] = (at, own.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n))
    return out


def _best(ids: pa.Array, rows: pa.ListArray, queries: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows, scores and which of these are null, of a block's rows that can be among the best ``k`` of a query."""
    order = pa.compute.sort_indices(ids).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    guess = np.full((len(queries), len(rows)), -np.inf)  # null scores are the last
    x, q = _matrices(rows), _matrices(queries)
    with np.errstate(all="ignore"):
        for n in x.keys() & q.keys():
            part = q[n][1] @ x[n][1].T
            guess[np.ix_(q[n][0], x[n][0])] = np.where(np.isnan(part), np.inf, np.maximum(part, -np.finfo(float).max))
        last = np.partition(guess, len(rows) - k, axis=1)[:, len(rows) - k] if k < len(rows) else np.full(len(queries), -np.inf)
        least = np.where(np.isfinite(last), last - MARGIN - 1e-12 * np.abs(last), last)
        at, row = np.nonzero(guess >= least[:, None])
        null = np.isneginf(guess[at, row])
        score = np.zeros(len(at))
        for n in x.keys() & q.keys():
            # Place in the matrix of each vector of this length; sums from left to right, so that equal vectors tie.
            qi, xi = np.full(len(queries), -1), np.full(len(rows), -1)
            qi[q[n][0]], xi[x[n][0]] = np.arange(len(q[n][0])), np.arange(len(x[n][0]))
            here = np.flatnonzero((qi[at] >= 0) & (xi[row] >= 0))
            for lo in range(0, len(here), 1 << 16):
                h = here[lo : lo + (1 << 16)]
                product = q[n][1][qi[at[h]]] * x[n][1][xi[row[h]]]
                score[h] = np.cumsum(product, axis=1)[:, -1] if n else 0.0
        keep = _first_of_ties(at, rank[row], np.where(null, -np.inf, np.round(score, 9)), k)
    return at[keep], row[keep], score[keep], null[keep]


def _first_of_ties(at: np.ndarray, rank: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places without the rows that tie for a query with ``k`` others of smaller rank: those can't be among its best."""
    by = np.lexsort((rank, tie, at))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (at[by][1:] != at[by][:-1]) | ~((tie[by][1:] == tie[by][:-1]) | (np.isnan(tie[by][1:]) & np.isnan(tie[by][:-1])))
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
    return by[np.arange(len(by)) - start < k]


def candidates(pairs: DataFrame, k: int, id_kind: str, query_kind: str) -> DataFrame:
    """``query_id``, ``id``, ``score`` of what a pair of blocks (``ids``, ``rows``, ``query_ids``, ``queries``) adds to the best ``k`` of its queries: largest products, ties by 9 digits to the smaller id.

    A vector that is null, holds a null or has another length than the query scores null, which is last; NaN is first.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows, query_ids, queries = (batch.column(batch.schema.get_field_index(n))[i].values for n in ("ids", "rows", "query_ids", "queries"))
                at, row, score, null = _best(ids, rows, queries, k)
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(at)), ids.take(pa.array(row)), pa.array(score, mask=null)], names=["query_id", "id", "score"])

    return pairs.select("ids", "rows", "query_ids", "queries").mapInArrow(search, f"query_id {query_kind}, id {id_kind}, score double")


def counted(rows: DataFrame, words: str, keep: Sequence[str], block: int | None = None) -> DataFrame:
    """``terms``, the distinct ``words`` (an array) of each row, how often each stands there (``tfs``), and ``len``, beside the columns ``keep``; with ``block`` as ``packed`` over so many rows."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, block or 512):
                part = whole.slice(lo, block or 512)
                lists = part.column(words)
                coded = lists.flatten().dictionary_encode()
                some = max(len(coded.dictionary), 1)
                marks, tfs = np.unique(pa.compute.list_parent_indices(lists).to_numpy() * some + coded.indices.to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(marks, np.arange(part.num_rows + 1) * some).astype(np.int32))
                own = [pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(marks % some))), pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32)))]
                columns = [*[part.column(c) for c in keep], *own, pa.compute.list_value_length(lists)]
                if block:
                    columns = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([c])) for c in columns]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "terms", "tfs", "len"])

    kinds = {c: kinds[c] for c in keep} | {"terms": "array<string>", "tfs": "array<int>", "len": "int"}
    out = ", ".join(f"`{c}` array<{kind}>" if block else f"`{c}` {kind}" for c, kind in kinds.items())
    return rows.select(*keep, words).mapInArrow(count, out)


def _of_best(at: np.ndarray, score: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of scores that are no more than ``margin`` below the ``k``-th of their query, and queries that have as many, as a map to that score."""
    by = np.lexsort((-score, at))
    begins = np.flatnonzero(np.concatenate([[True], at[by][1:] != at[by][:-1]])) if len(by) else np.empty(0, np.int64)
    sizes = np.diff(np.append(begins, len(by)))
    last = np.full(len(begins), -np.inf)
    full = sizes >= k
    last[full] = score[by][begins[full] + k - 1]
    return by[score[by] >= np.repeat(last, sizes) - margin], np.stack([at[by][begins[full]], last[full]])


class _Kept:
    """What can be among the best ``k`` of each query of a block, over all documents seen."""

    def __init__(self, query_ids: pa.Array, codes: np.ndarray, sizes: np.ndarray, weights: np.ndarray, known: int, k: int, digits: int):
        """Of ``known`` terms by number, the queries have those of ``codes``, ``sizes`` of them each."""
        self.query_ids, self.k, self.digits = query_ids, k, digits
        own, numbers = np.unique(codes, return_inverse=True)
        self.place = np.full(known, -1, np.int32)
        self.place[own] = np.arange(len(own))
        self.size = len(own)
        # The j-th term of each query; the last row of the table of documents is that of no term.
        starts, numbers, weight = np.cumsum(sizes) - sizes, np.append(numbers, len(own)), np.append(weights, 0.0)
        places = [np.where(sizes > j, starts + j, len(codes)) for j in range(int(sizes.max(initial=0)))]
        self.terms = [(numbers[p], weight[p][:, None]) for p in places]
        self.least = np.full(len(query_ids), 0.4 * 10.0**-digits)
        self.at, self.score, self.ids = np.empty(0, np.int64), np.empty(0), None

    def add(self, ids: pa.Array, codes: np.ndarray, docs: np.ndarray, parts: np.ndarray) -> None:
        """Documents ``ids`` (by their places ``docs``) with terms of ``codes``."""
        table = np.zeros((self.size + 1, len(ids)))
        own = self.place[codes]
        here = own >= 0
        table[own[here], docs[here]] = parts[here]
        score = np.zeros((len(self.query_ids), len(ids)))
        for own, weight in self.terms:
            score += weight * table[own]
        least = self.least
        if self.ids is None and self.k < len(ids):
            least = np.maximum(least, np.partition(score, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 10.0 ** (1 - self.digits))
        at, row = np.nonzero(score >= least[:, None])
        if not len(at):
            return
        at, found, these = np.append(self.at, at), np.append(self.score, score[at, row]), ids.take(pa.array(row))
        these = these if self.ids is None else pa.concat_arrays([self.ids, these])
        near, full = _of_best(at, found, self.k, 10.0 ** (1 - self.digits))
        at, found, these = at[near], found[near], these.take(pa.array(near))
        rank = np.empty(len(at), np.int64)
        rank[pa.compute.sort_indices(these).to_numpy()] = np.arange(len(at))
        keep = _first_of_ties(at, rank, np.round(found, self.digits), self.k)
        self.at, self.score, self.ids = at[keep], found[keep], these.take(pa.array(keep))
        self.least[full[0].astype(np.int64)] = np.maximum(full[1] - 10.0 ** (1 - self.digits), 0.4 * 10.0**-self.digits)

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.query_ids.take(pa.array(self.at)), self.ids, pa.array(self.score)], names=["query_id", "id", "score"])


def weighed(pairs: DataFrame, k: int, digits: int, id_kind: str, query_kind: str) -> DataFrame:
    """``query_id``, ``id``, ``score`` of what can be among the best ``k`` of each query over a task's pairs of blocks, by sums of ``parts`` times ``weights`` over the terms that both have, above 0, rounded to ``digits``.

    Blocks hold ``ids``, ``terms`` and ``parts`` (arrays) of documents, ``query_ids``, ``query_terms`` and ``weights`` of queries; a
    query stands in one block. A task keeps some ``k`` rows of each query between its pairs and gives them at its end.
    """
    names = ["ids", "terms", "parts", "query_ids", "query_terms", "weights"]

    block = TERM_QUERIES

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[object, tuple[pa.Array, list[_Kept]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, terms, parts, query_ids, query_terms, weights = (batch.column(batch.schema.get_field_index(n))[i].values for n in names)
                first = query_ids[0].as_py()
                if first not in asked:
                    flat = query_terms.flatten()
                    known, sizes, weight = flat.unique(), pa.compute.list_value_length(query_terms).to_numpy(), weights.flatten().to_numpy()
                    codes, upto = pa.compute.index_in(flat, value_set=known).to_numpy(), np.append(0, np.cumsum(sizes))
                    spans = [(lo, min(lo + block, len(query_ids))) for lo in range(0, len(query_ids), block)]
                    asked[first] = known, [_Kept(query_ids.take(pa.array(np.arange(lo, hi))), codes[upto[lo] : upto[hi]], sizes[lo:hi], weight[upto[lo] : upto[hi]].copy(), len(known), k, digits) for lo, hi in spans]
                known, kept = asked[first]
                code = pa.compute.index_in(terms.flatten(), value_set=known)
                here = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                hits = code.take(pa.array(here)).to_numpy(), pa.compute.list_parent_indices(terms).to_numpy()[here], parts.flatten().to_numpy()[here]
                for some in kept:
                    some.add(ids, *hits)
        for _, kept in asked.values():
            for some in kept:
                if len(some.at):
                    yield some.rows()

    return pairs.select(*names).mapInArrow(search, f"query_id {query_kind}, id {id_kind}, score double")
