"""Bounded-space online best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import materialise, readable
from filingloom.llm.tokens import SliceCache, rounds, slice_ids


class BestFit:
    """At most ``open_bins`` open bins of ``size``; bit f of ``free`` is set if an open bin has f free places.

    An item goes to the open bin with the least room that takes it, else to a
    new one; beyond ``open_bins`` the fullest closes first.
    """

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free = 0
        self.at: dict[int, list[int]] = {}
        self.n_open = self.n_bins = 0

    def _push(self, bin_: int, room: int) -> None:
        if room:
            self.at.setdefault(room, []).append(bin_)
            self.free |= 1 << room
            self.n_open += 1
            if self.n_open > self.open_bins:
                self._pop((self.free & -self.free).bit_length() - 1)

    def _pop(self, room: int) -> int:
        stack = self.at[room]
        bin_ = stack.pop()
        if not stack:
            del self.at[room]
            self.free ^= 1 << room
        self.n_open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of the next item; 1 <= length <= size."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            bin_ = self._pop(room)
        else:
            room, bin_ = self.size, self.n_bins
            self.n_bins += 1
        self._push(bin_, room - length)
        return bin_, self.size - room

    def rooms(self) -> dict[int, int]:
        """Free places of each bin still open."""
        return {b: room for room, stack in self.at.items() for b in stack}


def _word_cut(text: str, at: int) -> int:
    end = text.find(" ", at)
    return end if end >= 0 else len(text)


#: Fixed value: how the tokenizer file splits normalised text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Characters that need no library: ASCII, Latin, Greek and Cyrillic letters in use, combining accents, general
#: punctuation, kana, CJK ideographs and Hangul of the first Unicode versions.
PLAIN = "\\x00-\u0377\u037a-\u037f\u0384-\u038a\u038c\u038e-\u03a1\u03a3-\u052f\u2000-\u2064\u20a0-\u20b5\u2190-\u22ff\u3000-\u303f\u3041-\u3096\u3099-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f600-\U0001f640"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordTokens:
    """Ids of the ``tokenizers`` file for whole texts, as the library gives them by default.

    Added tokens are found first, in the text as it is, and what stands between
    them is encoded by itself. The file's rules normalise (NFC, lower case),
    drop white space and split before any merge, so slices that begin at a blank,
    a line feed, or a comma or full stop behind a Latin letter have the ids that
    they have in their text. Each new slice is encoded once: by the library's
    merges alone if all its characters are in PLAIN, where the library's and
    this class's tables of letters agree, else by the library as a whole.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        rules = json.loads(whole.to_str())
        kinds = [n["type"] for n in rules["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != SPLIT:
            raise ValueError(f"{path} has other rules than this class")
        added = {t["content"]: t["id"] for t in rules["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or not t["special"] for t in rules["added_tokens"]):
            raise ValueError(f"{path} has other added tokens than this class knows")
        self.added = added
        longest = sorted(added, key=len, reverse=True)
        self.find_added = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if added else None
        # Slices are lower-cased, so a mark in them was no added token.
        whole.encode_special_tokens = True
        self.whole = whole
        self.merges = Tokenizer(whole.model)
        self.odd = regex.compile(f"[^{PLAIN}]").search
        # Python's \\s has four characters more than the file's.
        self.split = regex.compile(SPLIT.replace("\\s", "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000")).findall
        self.letters = _byte_letters()
        self.cache = SliceCache(self._encode)

    def _encode(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        from unicodedata import normalize

        decoded = [s.decode() for s in slices]
        if any(map(self.odd, decoded)):
            odd = [bool(self.odd(t)) for t in decoded]
            plain = iter(self._plain([s for s, o in zip(slices, odd, strict=True) if not o]))
            found = [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) if o else next(plain) for t, o in zip(decoded, odd, strict=True)]
            return np.concatenate(found), np.array([len(f) for f in found], np.int64)
        # A sigma at a word's end has the same lower case as elsewhere; str.lower would choose another.
        text = [normalize("NFC", t).replace("\u03a3", "\u03c3").lower() for t in decoded]
        pieces = [self.split(t) for t in text]
        flat = [p if p.isascii() and p.isprintable() else "".join(map(self.letters.__getitem__, p.encode())) for ps in pieces for p in ps]
        done = self.merges.encode(flat, is_pretokenized=True, add_special_tokens=False)
        per_piece = np.bincount(np.array(done.word_ids, np.int64), minlength=len(flat)) if flat else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(per_piece)])
        ends = np.cumsum([len(ps) for ps in pieces])
        return np.array(done.ids, np.uint32), np.diff(total[np.concatenate([[0], ends])])

    def _plain(self, slices: list[bytes]) -> list[np.ndarray]:
        if not slices:
            return []
        ids, lengths = self._encode(slices)
        return np.split(ids, np.cumsum(lengths)[:-1])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.find_added is None or not any(mark in t for t in texts for mark in self.added):
            return self._unmarked(texts)
        parts = [self.find_added(t) for t in texts]
        done = iter(self._unmarked([p for ps in parts for p in ps if p not in self.added]))
        return [np.concatenate([np.array([self.added[p]], np.uint32) if p in self.added else next(done) for p in ps]) for ps in parts]

    def _unmarked(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for part in rounds(texts, _word_cut):
            raw = [t.encode() for _, t in part]
            size = np.array([len(r) for r in raw], np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            letter = (data | 32) - 97 < 26
            data = np.where(letter, data | 32, data)  # the file lower-cases anyway
            begins = (data == 32) | (data == 10)
            begins[1:] |= ((data[1:] == 44) | (data[1:] == 46)) & letter[:-1]
            ends = np.cumsum(size)
            starts = ends - size
            begins[starts[size > 0]] = True
            bounds = np.append(np.flatnonzero(begins), len(data))
            ids, lengths = slice_ids(data.tobytes(), bounds, self.cache)
            total = np.concatenate([[0], np.cumsum(lengths)])
            lo, hi = total[np.searchsorted(bounds, starts)], total[np.searchsorted(bounds, ends)]
            for (i, _), a, b in zip(part, lo, hi, strict=True):
                found[i].append(ids[a:b])
        return [f[0] if len(f) == 1 else np.concatenate(f) for f in found]


_TOKENS: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]



def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, size: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    tokens, packer = _tokens(path), BestFit(size, open_bins)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "place"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        ids_of, texts_of = batch.column(0).to_pylist(), batch.column(1)
        step = 256
        for lo in range(0, len(ids_of), step):
            rows: list[tuple] = []
            texts = texts_of.slice(lo, step).to_pylist()
            for doc, ids in zip(ids_of[lo : lo + step], tokens([t or "" for t in texts]), strict=True):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for k in range(0, len(ids), size):
                    cut = ids[k : k + size]
                    bin_, place = packer.place(len(cut))
                    rows.append((doc, k // size, k, len(cut), zlib.crc32(cut.tobytes()), task, bin_, place))
            yield rows_of(rows)
    # The bins still open, as rows of no piece: what they hold.
    left = [(None, -1, 0, size - room, 0, task, bin_, 0) for bin_, room in sorted(packer.rooms().items())]
    if left:
        yield rows_of(left)


def _merge_bins(pieces: pd.DataFrame, size: int, open_bins: int) -> pd.DataFrame:
    """Packs the pieces of the open bins of a block of tasks, largest first; a bin is numbered by the first place in it."""
    pieces = pieces.sort_values(["length", "part", "bin", "place"], ascending=[False, True, True, True], ignore_index=True)
    packer, first, out = BestFit(size, open_bins), {}, []
    for part, bin_, place, length in zip(pieces["part"], pieces["bin"], pieces["place"], pieces["length"], strict=True):
        new, at = packer.place(length)
        first.setdefault(new, (part, bin_, place))
        out.append((part, bin_, place, *first[new], at))
    return pd.DataFrame(out, columns=["part", "bin", "place", "to_part", "to_bin", "to_place", "at"])


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, open_bins: int = 512, merge_tasks: int = 64
) -> DataFrame:
    """Pack every document row's ids (its tokens, then id 0) into sequences of at most ``size``.

    One row per piece: ``doc_id``, ``piece`` (from 0), ``start`` (ids of the
    document before it), ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    Only documents longer than ``size`` are cut, into pieces of ``size`` and a
    rest.

    Each task tokenises its rows and packs their pieces as they come, so no text
    is shuffled and memory is bounded by ``open_bins`` and a round of text. The
    pieces in bins that are open when a task ends (at most ``open_bins``) are
    packed again over blocks of ``merge_tasks`` tasks, largest first, by the same
    packer; only their places move. A sequence's number holds the task and the
    bin that it began with.

    Null and empty texts are one id, 0; repeated rows are packed each on their
    own; bytes that are no UTF-8 count as U+FFFD; an empty table gives no rows;
    other columns are not read.
    """
    def run(batches):
        return _pack_partition(batches, tokenizer, size, open_bins)

    def merge(bins):
        return _merge_bins(bins, size, 8 * open_bins)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), readable(F.col(text_col)).alias("text"))
    placed = materialise(picked.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, bin bigint, place bigint"), "placed")
    open_ = placed.where("piece < 0").select("part", "bin", F.floor(F.col("part") / merge_tasks).alias("block"))
    pieces = placed.where("piece >= 0").select("part", "bin", "place", "length").join(open_, ["part", "bin"])
    moved = pieces.groupBy("block").applyInPandas(merge, "part int, bin bigint, place bigint, to_part int, to_bin bigint, to_place bigint, at bigint")
    out = placed.where("piece >= 0").join(materialise(moved, "moved_pieces"), ["part", "bin", "place"], "left")
    # Merged sequences have odd numbers: task, bin and place that they begin with.
    bits = size.bit_length() + 1
    number = lambda part, bin_, place: F.shiftleft(F.col(part).cast("long"), 40) + F.shiftleft(bin_, bits) + F.shiftleft(place, 1)
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.when(F.col("at").isNull(), number("part", "bin", F.lit(0))).otherwise(number("to_part", "to_bin", "to_place") + 1).alias("sequence_id"),
        F.coalesce("at", "place").alias("offset"),
    )
