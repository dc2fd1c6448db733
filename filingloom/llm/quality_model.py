"""Quality classifier: heuristic labellers, EM over their votes, and a hashed linear scorer trained on the posteriors."""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import materialise, readable, row_key
from filingloom.llm.tokens import rounds
from filingloom.llm.weak_labels import VoteModel, fit

LABELLERS = ("l_length", "l_symbols", "l_case", "l_adjacent", "l_variety", "l_echo", "l_shape", "l_punctuation", "l_plain")
BLOCK = 500
BITS = 16
SLOTS = 1 << BITS
#: Posteriors farther than this from certainty train nothing.
SURE = 0.9
#: Rows of each weak label that train the scorer, those with the smallest hash of their key.
TRAIN_ROWS = 3000
#: Rows of a class at which it has half of its full weight in training.
FEW = 20


def _slot(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) & (SLOTS - 1)


#: What a character is: white space, a letter, none of letters and digits, a symbol, changed by upper(), changed by lower().
BLANK, LETTER, OTHER, ODD, RAISED, LOWERED = (1 << k for k in range(6))
#: Code points whose facts a worker keeps in a table; those beyond are looked at one by one.
PLANE = 1 << 16


def _of_char(c: str) -> tuple[int, int]:
    """Flags of a character, and what stands for it in the shape of a word."""
    flags = BLANK * (c in " \t\n\x0b\x0c\r") | LETTER * c.isalpha() | OTHER * (not c.isalnum()) | ODD * (c in "#*$%&|<>") | RAISED * (c.upper() != c) | LOWERED * (c.lower() != c)
    return flags, ord("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c)


@functools.cache
def _char_table() -> tuple[np.ndarray, np.ndarray]:
    found = np.array([_of_char(chr(k)) for k in range(PLANE)])
    return found[:, 0].astype(np.uint8), found[:, 1].astype(np.uint32)


def _char_facts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flags, shapes = (known[np.minimum(points, PLANE - 1)] for known in _char_table())
    for k in np.unique(points[points >= PLANE]).tolist():
        flags[points == k], shapes[points == k] = _of_char(chr(k))
    return flags, shapes


def _word_facts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Length, symbols, upper case or not, characters that are no letters or digits, plain or not, and the slot of the shape of each word.

    Words are the bytes of ``data`` between ``bounds``; white space after them doesn't count. A shape is
    runs of upper case, lower case, digits and each other character, runs shortened to one or two.
    """
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    # Characters before each byte, of which each has one that doesn't continue another.
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    begins = starts[:-1]
    flags, shapes = _char_facts(points)
    count = lambda f: np.add.reduceat(f, begins, dtype=np.int64)
    word = (flags & BLANK) == 0
    length, letters, odd = count(word), count((flags & LETTER) > 0), count((flags & ODD) > 0)
    others = count(word & ((flags & OTHER) > 0))
    upper = (letters > 1) & (count((flags & RAISED) > 0) == 0) & (count((flags & LOWERED) > 0) > 0)
    kept = word.copy()
    third = np.ones(len(points), bool)
    third[begins] = False
    third[np.minimum(begins + 1, len(points) - 1)] = False
    kept[2:] &= ~(third[2:] & (shapes[2:] == shapes[1:-1]) & (shapes[2:] == shapes[:-2]))
    ends = 4 * np.concatenate([[0], np.cumsum(kept)])[starts]
    coded = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(shapes[kept].tobytes())]).dictionary_encode()
    slots = np.array([_slot("s", x.decode("utf-32-le")) for x in coded.dictionary.to_pylist()], np.int64)
    return np.stack([length, odd, upper, others, (letters > 0) & (others <= 1), slots[coded.indices.to_numpy()]], 1)


#: Columns that ``measure`` gives each text; words are distinct within each BLOCK of words, so that length alone lowers no share.
MEASURES = ("n", "length", "odd", "upper", "others", "plain", "adjacent", "distinct")


def measure(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """MEASURES of each text, and its hashed features (slots and values): shapes of words as shares, and repeats."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    slots: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(texts)
    same, few = _slot("r", "adjacent"), _slot("r", "variety")
    for part in rounds(texts, lambda text, at: len(text)):
        raw = [t.encode() for _, t in part]
        size = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(size)
        buffer = b"".join(raw)
        data = np.frombuffer(buffer, np.uint8)
        word = ~((data == 32) | (data - 9 < 5))
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        first = (ends - size)[size > 0]
        begins[first] = word[first]
        at = np.flatnonzero(begins)
        if not len(at):
            continue
        begins[first] = True
        bounds = np.append(np.flatnonzero(begins), len(data))
        kept = np.searchsorted(bounds, at)
        coded = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(buffer)]).dictionary_encode()
        code = coded.indices.to_numpy()[kept].astype(np.int64)
        _, offsets, distinct_words = coded.dictionary.buffers()
        starts = np.frombuffer(offsets, np.int32, len(coded.dictionary) + 1)
        facts = _word_facts(np.frombuffer(distinct_words, np.uint8, int(starts[-1])), starts)[code]
        upto = np.searchsorted(at, ends)
        n = np.diff(upto, prepend=0)
        # Texts with words, each text's first word, and the text of each word.
        some = np.flatnonzero(n)
        n, low = n[some], (upto - n)[some]
        own = np.repeat(np.arange(len(some)), n)
        adjacent = np.zeros(len(at), np.int64)
        adjacent[1:] = (code[1:] == code[:-1]) & (own[1:] == own[:-1])
        # Blocks are numbered through all texts.
        blocks = (n + BLOCK - 1) // BLOCK
        block = np.repeat(np.cumsum(blocks) - blocks, n) + (np.arange(len(at)) - np.repeat(low, n)) // BLOCK
        marks = np.sort(block * len(starts) + code)
        found = marks[np.concatenate([[True], marks[1:] != marks[:-1]])] // len(starts)
        distinct = np.bincount(np.repeat(np.arange(len(some)), blocks)[found], minlength=len(some))
        adjacent = np.add.reduceat(adjacent, low)
        doc = np.array([i for i, _ in part])[some]
        out[doc] = np.column_stack([n, np.add.reduceat(facts[:, :5], low), adjacent, distinct])
        shapes, counts = np.unique(own * SLOTS + facts[:, 5], return_counts=True)
        shares = np.sqrt(counts / n[shapes // SLOTS])
        repeats = np.stack([np.sqrt(adjacent / n), np.sqrt(1 - distinct / n)], 1)
        hi = np.searchsorted(shapes, (np.arange(len(some)) + 1) * SLOTS).tolist()
        lo = 0
        for k, i in enumerate(doc.tolist()):
            slots[i] = (np.append(shapes[lo : hi[k]] % SLOTS, [same, few]), np.append(shares[lo : hi[k]], repeats[k]))
            lo = hi[k]
    return out, slots


def votes(m: np.ndarray) -> np.ndarray:
    """Votes of LABELLERS on rows of MEASURES: 0 bad, 1 good, -1 abstains."""
    n = np.maximum(m[:, 0], 1)
    length, odd, upper, others, plain, adjacent, distinct = (m[:, k] / n for k in range(1, 8))

    def vote(bad, good):
        return np.where(bad, 0, np.where(good, 1, -1)).astype(np.int8)

    some = m[:, 0] > 0
    out = np.stack([
        vote((length > 20) | (length < 2), (length >= 3) & (length <= 10)),
        vote(odd > 0.15, odd < 0.05),
        vote(upper > 0.4, upper < 0.1),
        vote(adjacent > 0.2, adjacent < 0.02),
        vote((distinct < 0.15) & (m[:, 0] >= 50), (distinct > 0.3) & (m[:, 0] >= 50)),
        vote((adjacent > 0.1) & (distinct < 0.6), adjacent < 0.02),
        vote(others > length * 0.3, others < length * 0.08),
        vote(others > 0.6, others < 0.3),
        vote(plain < 0.7, plain > 0.9),
    ], 1)
    out[~some] = -1
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            m, slots = measure([t or "" for t in part.column(3).to_pylist()])
            v = votes(m)
            columns = [pa.array(c, pa.int8(), mask=c < 0) for c in v.T]
            features = [pa.array([s for s, _ in slots], pa.list_(pa.int64())), pa.array([x for _, x in slots], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(m[:, 0]), *columns, *features], names=["doc_id", "_id", "_h", "n_words", *LABELLERS, "slots", "shares"])


def train(posterior: np.ndarray, slots: list[np.ndarray], shares: list[np.ndarray], rounds_: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer that fits the posteriors; full-batch Adagrad.

    Classes weigh alike if they are large; one of few rows weighs less, as FEW more would halve its weight.
    """
    w, b = np.zeros(SLOTS), 0.0
    if not len(posterior):
        return w, b
    sizes = np.array([len(s) for s in slots])
    row = np.repeat(np.arange(len(slots)), sizes)
    col, val = np.concatenate(slots).astype(np.int64), np.concatenate(shares)
    good = posterior >= 0.5
    weight = np.where(good, 0.5 / (good.sum() + FEW), 0.5 / ((~good).sum() + FEW))
    g2, gb2 = np.full(SLOTS, 1e-8), 1e-8
    for _ in range(rounds_):
        z = np.bincount(row, val * w[col], len(slots)) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - posterior)
        g = np.bincount(col, val * err[row], SLOTS) + decay * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
        gb = err.sum()
        gb2 += gb * gb
        b -= rate * gb / np.sqrt(gb2)
    return w, float(b)


def _train_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("_h", ignore_index=True)
    w, b = train(rows["posterior"].to_numpy(), list(rows["slots"]), list(rows["shares"]))
    used = np.flatnonzero(w)
    return pd.DataFrame({"slot": np.append(used, SLOTS), "weight": np.append(w[used], b)})


def fit_scorer(weak: DataFrame, train_rows: int) -> tuple[np.ndarray, float]:
    """Train on at most ``train_rows`` keys of each sure weak label; the weights (SLOTS at most) come to the driver."""
    picked = [weak.where(c).orderBy("_h", "_id").limit(train_rows) for c in (F.col("posterior") >= SURE, F.col("posterior") <= 1 - SURE)]
    chosen = picked[0].union(picked[1]).select("_id", "_h").dropDuplicates(["_id", "_h"])
    # At most 2 * train_rows keys: a bound that doesn't grow with the data.
    rows = weak.join(F.broadcast(chosen), ["_id", "_h"]).select("posterior", "_h", "slots", "shares")
    found = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_train_group, "slot bigint, weight double").collect()
    w, b = np.zeros(SLOTS), 0.0
    for r in found:
        if r["slot"] == SLOTS:
            b = r["weight"]
        else:
            w[r["slot"]] = r["weight"]
    return w, b


def classify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, train_rows: int = TRAIN_ROWS, model: VoteModel | None = None, learn_from: DataFrame | None = None
) -> DataFrame:
    """Score every document row: ``doc_id``, the key ``_id``/``_h``, ``n_words``, ``posterior`` (of the votes), ``score`` and ``kept``.

    Labellers vote on counts of every text; EM over all vote patterns estimates
    how far each is right; the posteriors of at most ``train_rows`` sure rows
    of each kind train a linear scorer on hashed features, which scores all
    texts. Kept are scores of ``threshold`` or more.

    EM and scorer learn from the rows of ``learn_from`` (all are voted on), or of
    ``docs`` where it isn't given. Where filters have gone before, the table
    before them has the junk to learn from.

    Without sure rows of both kinds there is nothing to tell apart, and the
    posterior is the score. Null and empty texts score 0 and aren't kept;
    repeated rows score alike; bytes that are no UTF-8 count as U+FFFD; an empty
    table gives no rows; other columns are not read.
    """
    keyed = lambda d: d.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(F.col(id_col), F.col(text_col)), readable(F.col(text_col)).alias("text"))
    schema = "doc_id bigint, _id bigint, _h bigint, n_words bigint, " + ", ".join(f"{n} tinyint" for n in LABELLERS) + ", slots array<bigint>, shares array<double>"
    # Votes and features of a text are written together, so that no text is read twice.
    voted = materialise(keyed(docs if learn_from is None else learn_from).mapInArrow(_measured, schema), "votes")
    model = model or fit(voted.where("n_words > 0"), LABELLERS)
    posterior = model.posterior({n: F.col(n) for n in LABELLERS})
    some = voted.withColumn("posterior", posterior).where("n_words > 0")
    counts = some.agg(F.count(F.when(F.col("posterior") >= SURE, 1)), F.count(F.when(F.col("posterior") <= 1 - SURE, 1))).first()
    own = voted if learn_from is None else keyed(docs).mapInArrow(_measured, schema)
    own = own.select("doc_id", "_id", "_h", "n_words", posterior.alias("posterior"), "slots", "shares")
    if not all(counts):
        return own.drop("slots", "shares").withColumn("score", F.when(F.col("n_words") > 0, F.col("posterior")).otherwise(0.0)).withColumn("kept", F.col("score") >= threshold)
    w, b = fit_scorer(some, train_rows)

    def score(batches):
        for batch in batches:
            slots, shares = batch.column("slots"), batch.column("shares")
            s, v = slots.values.to_numpy(), shares.values.to_numpy()
            z = np.array([w[s[lo:hi]] @ v[lo:hi] + b for lo, hi in itertools.pairwise(slots.offsets.to_pylist())])
            s = np.where(batch.column("n_words").to_numpy() > 0, 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(s, pa.float64())], names=["doc_id", "_id", "_h", "n_words", "posterior", "score"])

    scored = own.mapInArrow(score, "doc_id bigint, _id bigint, _h bigint, n_words bigint, posterior double, score double")
    return scored.withColumn("kept", F.col("score") >= threshold)
