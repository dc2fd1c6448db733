"""Byte-level BPE over codepoint-class arrays: boundaries by a scan of transition functions, merges cached by slice."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.tokens import SliceCache, gather, rounds, slice_ids

# Symbols that a text becomes: letter, number, other, an apostrophe that a contraction of one or two
# letters follows, a blank before a non-space, a space before a space or the end, any other space
# before a non-space, and the bound between texts.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, SPACE, LAST, END = range(9)
# States: what the open piece is. AFTER: a contraction ended. NEED1, NEED2: it lacks so many letters.
S_NONE, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_NEED1, S_NEED2, S_AFTER = range(9)
N_STATES, N_SYMBOLS = 9, 9


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at the symbol."""
    if symbol == END:
        return S_NONE, True
    if symbol == LETTER:
        if state == S_NEED2:
            return S_NEED1, False
        if state == S_NEED1:
            return S_AFTER, False
        return S_LETTER, state not in (S_LETTER, S_BLANK)
    if symbol == NUMBER:
        return S_NUMBER, state not in (S_NUMBER, S_BLANK)
    if symbol in (OTHER, SHORT, LONG):
        if state in (S_OTHER, S_BLANK):
            return S_OTHER, False
        return {OTHER: S_OTHER, SHORT: S_NEED1, LONG: S_NEED2}[symbol], True
    if symbol == SPACE:
        return S_SPACE, state != S_SPACE
    return (S_BLANK if symbol == BLANK else S_NONE), True


NEXT = np.array([[_step(s, c)[0] for c in range(N_SYMBOLS)] for s in range(N_STATES)], np.uint8)
BEGINS = np.array([[_step(s, c)[1] for c in range(N_SYMBOLS)] for s in range(N_STATES)], bool)


@cache
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The monoid of transition functions: the function of each symbol, the table of compositions, each function's values."""
    number: dict[tuple[int, ...], int] = {tuple(range(N_STATES)): 0}
    todo = [tuple(range(N_STATES))]
    of_symbol = [tuple(int(NEXT[s, c]) for s in range(N_STATES)) for c in range(N_SYMBOLS)]
    while todo:
        f = todo.pop()
        for g in of_symbol:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    every = list(number)
    compose = np.array([[number[tuple(g[s] for s in f)] for g in every] for f in every], np.uint16)
    return np.array([number[g] for g in of_symbol], np.uint16), compose, np.array(every, np.uint8)


def scan_states(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """State before each symbol, from S_NONE: composes functions within rows of ``width``, scans the rows' totals, then runs all rows."""
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.uint8)
    of_symbol, compose, values = _functions()
    rows = -(-n // width)
    grid = np.full(rows * width, END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    total = of_symbol[grid[0]]
    for column in grid[1:]:
        total = compose[total, of_symbol[column]]
    # Composition is associative, so prefixes come by doubling.
    prefix, reach = total, 1
    while reach < rows:
        prefix = np.concatenate([prefix[:reach], compose[prefix[:-reach], prefix[reach:]]])
        reach *= 2
    state = np.full(rows, S_NONE, np.uint8)
    state[1:] = values[prefix[:-1], S_NONE]
    out = np.empty((width, rows), np.uint8)
    for k, column in enumerate(grid):
        out[k] = state
        state = NEXT[state, column]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


#: The code points that the split pattern's white space covers.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


def piece_bounds(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' joined bytes, the byte offsets at which pieces begin (last: the length), and each text's first offset and end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    data = joined.encode()
    n = len(points)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    at_byte = np.arange(n + 1)
    if len(data) != n:
        wide = np.ones(n, np.uint8)
        for least in (0x80, 0x800, 0x10000):
            wide += points >= least
        at_byte[1:] = np.cumsum(wide, dtype=np.int64)
    symbols = _classes()[points]
    ahead = np.full(n + 2, END, np.uint8)
    ahead[:n] = symbols
    letter = np.zeros(n + 2, np.uint32)
    letter[:n] = points
    inner = firsts[(firsts > 0) & (firsts < n)]
    # The next symbol of a text's last character is the end.
    following = ahead[1 : n + 1].copy()
    last = np.zeros(n, bool)
    last[inner - 1] = True
    if n:
        last[n - 1] = True
    following[last] = END
    space = symbols == SPACE
    before_text = space & (following != SPACE) & (following != END)
    quote = np.flatnonzero(points == 39)
    out = symbols.copy()
    out[before_text] = LAST
    out[before_text & (points == 32)] = BLANK
    if len(quote):
        one, two = letter[quote + 1], letter[quote + 2]
        alone = last[quote]
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~alone
        pair = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
        long_ = pair & ~alone & ~last[np.minimum(quote + 1, n - 1)]
        out[quote[short]] = SHORT
        out[quote[long_]] = LONG
    # A text begins in S_NONE: a bound symbol before each text resets the scan.
    place = np.arange(n) + np.repeat(np.arange(len(texts)), sizes)
    with_bounds = np.full(n + len(texts), END, np.uint8)
    with_bounds[place] = out
    state = scan_states(with_bounds)[place]
    begins = np.flatnonzero(BEGINS[state, out])
    return data, np.append(at_byte[begins], len(data)), at_byte[firsts]


class RankFile:
    """The ranks of a tiktoken file and the merges by them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.rank.values()) + 1
        parts: list[bytes] = [b""] * size
        for token, r in self.rank.items():
            parts[r] = token
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.token_length = np.array([len(p) for p in parts], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.cache = SliceCache(self._encode)

    def _merge(self, piece: bytes) -> list[int]:
        rank = self.rank
        if piece in rank:
            return [rank[piece]]
        if len(piece) > 128:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.token_length)
        ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] + parts[at + 1], none)
            if at:
                ranks[at - 1] = rank.get(parts[at - 1] + parts[at], none)
        return [rank[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap and links, n log n for pieces of any length."""
        import heapq

        n, rank = len(piece), self.rank
        end = list(range(1, n + 1))  # end of the part that begins here; 0: none begins here
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not end[i] or end[i] >= n:
                continue
            j = end[i]
            if rank.get(piece[i : end[j]]) != r:
                continue
            end[i], end[j] = end[j], 0
            if end[i] < n:
                before[end[i]] = i
                if (q := rank.get(piece[i : end[end[i]]])) is not None:
                    heapq.heappush(heap, (q, i))
            if (k := before[i]) >= 0 and (q := rank.get(piece[k : end[i]])) is not None:
                heapq.heappush(heap, (q, k))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return out

    def _encode(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done = [self._merge(s) for s in slices]
        return np.array([i for ids in done for i in ids], np.uint32), np.array([len(ids) for ids in done], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for part in rounds(texts, _safe_cut):
            data, bounds, ends = piece_bounds([t for _, t in part])
            ids, lengths = slice_ids(data, bounds, self.cache)
            total = np.concatenate([[0], np.cumsum(lengths)])
            at = total[np.searchsorted(bounds, ends)] if len(data) else np.zeros(len(ends), np.int64)
            for k, (i, _) in enumerate(part):
                found[i].append(ids[at[k] : at[k + 1]])
        return [f[0] if len(f) == 1 else np.concatenate(f) for f in found]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, by the retained offsets of each token's bytes."""
        ids = ids.astype(np.int64)
        return gather(self.token_bytes, self.token_start[ids], self.token_length[ids]).tobytes()


def _safe_cut(text: str, at: int) -> int:
    """A place at or after ``at`` where a piece begins whatever stands around: a space behind a letter or number."""
    classes = _classes()
    for i in range(at, len(text)):
        if classes[ord(text[i])] == SPACE and classes[ord(text[i - 1])] in (LETTER, NUMBER):
            return i
    return len(text)


_RANKS: dict[str, RankFile] = {}


def rank_file(path: str) -> RankFile:
    if path not in _RANKS:
        _RANKS[path] = RankFile(path)
    return _RANKS[path]


def _map_texts(batches: Iterator[pa.RecordBatch], step: int, rows, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows(part), schema, strict=True)], schema=schema)


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every document row, by the tiktoken file at ``ranks``.

    Null and empty texts have no ids, repeated rows stay, an empty table gives
    no rows, other columns are not read. Nothing is shuffled; a worker's memory
    is bounded by a round of text and its cache of slices. Special tokens in
    texts are ordinary text.
    """

    def run(batches):
        def rows(part):
            ids = rank_file(ranks).encode([t or "" for t in part.column(1).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            return [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))]

        return _map_texts(batches, 256, rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``data`` (the bytes that the ids stand for); null ids are none."""

    def run(batches):
        def rows(part):
            return [part.column(0), [rank_file(ranks).decode(np.array(i or [], np.int64)) for i in part.column(1).to_pylist()]]

        return _map_texts(batches, 256, rows, pa.schema([("doc_id", pa.int64()), ("data", pa.binary())]))

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, data binary")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and decoding: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; ids never leave the task.

    Ids are hashed as little-endian unsigned 32-bit integers. Cases as in ``encode``.
    """

    def run(batches):
        def rows(part):
            file = rank_file(ranks)
            ids = file.encode([t or "" for t in part.column(1).to_pylist()])
            return [
                part.column(0),
                [len(i) for i in ids],
                [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids],
                [hashlib.sha256(file.decode(i)).hexdigest() for i in ids],
            ]

        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        return _map_texts(batches, 256, rows, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
