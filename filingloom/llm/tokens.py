"""Token ids of many texts at once: distinct slices are encoded once, ids are gathered by numpy."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa

#: Characters of text that one round of array work takes; bounds memory, not results.
ROUND_CHARS = 1 << 20
#: Distinct slices that a worker keeps with their ids; beyond it the cache starts anew.
CACHE_SLICES = 1_000_000


class SliceCache:
    """Ids of slices, in one growing array; ``encode`` gets the slices not met before and gives their ids, joined, and lengths."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _room(self, name: str, least: int) -> None:
        arr = getattr(self, name)
        if least > len(arr):
            more = np.zeros(max(least, 2 * len(arr)), arr.dtype)
            more[: len(arr)] = arr
            setattr(self, name, more)

    def places(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Start in ``flat`` and length of each slice's ids."""
        if len(self.known) > CACHE_SLICES:
            self.clear()
        at = np.fromiter(map(self.known.get, slices, repeat(-1)), np.int64, len(slices))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = [slices[i] for i in fresh.tolist()]
            ids, lengths = self.encode(new)
            n, first = len(new), len(self.known)
            self._room("flat", self.used + len(ids))
            self._room("start", first + n)
            self._room("length", first + n)
            self.flat[self.used : self.used + len(ids)] = ids
            self.length[first : first + n] = lengths
            self.start[first : first + n] = self.used + np.cumsum(lengths) - lengths
            self.used += len(ids)
            self.known.update(zip(new, range(first, first + n), strict=True))
            at[fresh] = np.arange(first, first + n)
        return self.start[at], self.length[at]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate values[start : start + length] of every slice."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def slice_ids(data: bytes, bounds: np.ndarray, cache: SliceCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all slices of ``data`` between ``bounds`` (first 0, last its length), and each slice's number of ids."""
    n = len(bounds) - 1
    if n <= 0:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    arr = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
    coded = arr.dictionary_encode()
    start, length = cache.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    at = coded.indices.to_numpy(zero_copy_only=False)
    lengths = length[at]
    return gather(cache.flat, start[at], lengths), lengths


def rounds(texts: list[str], cut):
    """Lists of (document, text part) of about ROUND_CHARS characters; ``cut(text, at)`` gives a place at or after ``at`` where a text may be parted."""
    part: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > ROUND_CHARS:
            end = cut(text, at + ROUND_CHARS)
            if end >= len(text):
                break
            if part:
                yield part
                part, size = [], 0
            yield [(i, text[at:end])]
            at = end
        rest = text[at:] if at else text
        if size + len(rest) > ROUND_CHARS and part:
            yield part
            part, size = [], 0
        part.append((i, rest))
        size += len(rest)
    if part:
        yield part
