"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index over their chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import discard, let, materialise, readable
from filingloom.llm.components import components
from filingloom.llm.tokens import rounds

WORDS = 5
#: A signature: CHUNKS chunks of CHUNK components of 16 bits.
CHUNKS, CHUNK = 16, 4
#: Signatures that differ in at most so many components have at most one error in some chunk.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Longs of a set's parity bits.
PARITY = 8
#: The ids of documents whose sets are fetched are broadcast up to so many (16 MB or so); beyond it the planner joins.
BROADCAST_IDS = 500_000
#: Members of mixed buckets are drawn again while they would make more pairs than this each, so many times at most.
PAIRS_A_MEMBER, MAX_DRAWS = 4096, 8
#: Mixed buckets with more members than this are split by a second key: below it 90 keys a member cost more than the pairs.
SPLIT = 16_384

_SEED = np.random.default_rng(20240229)
_MULTIPLY = _SEED.integers(0, 2**63, CHUNKS * CHUNK, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 2**63, CHUNKS * CHUNK, np.uint64)
_PLACE = _SEED.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _blank_cut(text: str, at: int) -> int:
    return len(text)  # shingles cross any cut: a text stays whole


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four
    words has its whole sequence as its one shingle.
    """
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    for part in rounds(texts, _blank_cut):
        raw = [t.encode().lower() for _, t in part]  # bytes.lower changes A-Z only
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
        # Slices run to the next word or text; white space behind the word is stripped from distinct ones only.
        bounds = np.unique(np.concatenate([at, first, [len(data)]]))
        kept = np.searchsorted(bounds, at)
        n = len(bounds) - 1
        coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(buffer)]).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.rstrip()) for w in distinct), np.uint64, len(distinct))
        words = hashes[coded.indices.to_numpy(zero_copy_only=False)[kept]]
        upto = np.searchsorted(at, ends)
        m = max(len(words) - WORDS + 1, 0)
        rolled = np.zeros(m, np.uint64)
        for k in range(WORDS):
            rolled += _mix(words[k : k + m]) * _PLACE[k]
        rolled = _mix(rolled)
        lo = 0
        for (i, _), hi in zip(part, upto.tolist(), strict=True):
            if hi - lo >= WORDS:
                out[i] = np.unique(rolled[lo : hi - WORDS + 1])
            elif hi > lo:
                few = _mix(words[lo:hi]) * _PLACE[: hi - lo]
                out[i] = _mix(few.sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo))
            lo = hi
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit components of each set's minima under CHUNKS * CHUNK hash functions; zeros for empty sets."""
    out = np.zeros((len(sets), CHUNKS * CHUNK), np.int16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        sizes = np.array([len(sets[i]) for i in full])
        starts = np.cumsum(sizes) - sizes
        for lo in range(0, len(full), 512):
            a = starts[lo]
            rows = full[lo : lo + 512]
            b = starts[lo + len(rows)] if lo + len(rows) < len(full) else len(flat)
            x, at = flat[a:b], starts[lo : lo + len(rows)] - a
            for k in range(CHUNKS * CHUNK):
                low = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], at)
                out[rows, k] = (_mix(low) >> np.uint64(48)).astype(np.uint16).view(np.int16)
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Bit i of a set: whether an odd number of its members falls to i. Sets differ in as many members as bits, at least."""
    bits = PARITY * 64
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (_mix(np.concatenate(sets)) & np.uint64(bits - 1)).astype(np.int64) if sets else row
    odd = np.bincount(row * bits + place, minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), bits), axis=1).view("<i8")


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix of longs as lists."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "n", "set_hash", "sig", "odd"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            sets = shingle_sets([t or "" for t in part.column(2).to_pylist()])
            sig = np.ascontiguousarray(signatures(sets)).view("<i8")  # a chunk is one long
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), digest, _lists(sig), _lists(parities(sets))], names=names)


def _only_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            sets = shingle_sets([t or "" for t in part.column(1).to_pylist()])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "shingles"])


def _chunk_keys(chunk: int) -> list[Column]:
    """Keys of a chunk with each of its components left out: chunks with at most one error share one."""
    lanes = [~(0xFFFF << 16 * out) for out in range(CHUNK)]
    signed = [x & (2**64 - 1) for x in lanes]
    return [F.xxhash64(F.lit(chunk * CHUNK + out), F.get("sig", F.lit(chunk)).bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m))) for out, m in enumerate(signed)]


def _errors(a: Column, b: Column) -> Column:
    """Components that differ in each chunk."""

    def of_chunk(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        lanes = [F.when(d.bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m)) != 0, 1).otherwise(0) for m in (0xFFFF << 16 * k for k in range(CHUNK))]
        return sum(lanes[1:], lanes[0])

    return F.zip_with(a, b, of_chunk)


def _total(errors: Column) -> Column:
    return F.aggregate(errors, F.lit(0), lambda s, x: s + x)


def _near_and_first(slot: Column, a: Column, b: Column) -> Column:
    """Whether signatures are near and the bucket number ``slot`` (chunk * CHUNK + component left out) is the first that they share."""
    chunk = F.floor(slot / CHUNK).cast("int")
    return let(
        _errors(a, b),
        lambda e: (_total(e) <= MAX_DISTANCE)
        & ((slot % CHUNK == 0) | (F.get(e, chunk) > 0))
        & (F.array_position(F.transform(e, lambda v: v <= 1), True) == chunk + 1),
    )


def _few_apart() -> Column:
    """Whether sizes and parity bits of ``_a`` and ``_b`` allow a link; no link is lost by it.

    100 * i >= 75 * u needs the smaller set to hold three quarters of the larger,
    and sets that differ in at most a seventh of their sizes' sum.
    """
    bits = [F.bit_count(F.get("odd_a", F.lit(k)).bitwiseXOR(F.get("odd_b", F.lit(k)))) for k in range(PARITY)]
    return (4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")) & (7 * sum(bits[1:], bits[0]) <= F.col("n_a") + F.col("n_b"))


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures, sizes and parity bits allow a link."""
    side = lambda c: reps.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "sig", "odd")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = _few_apart() & (_total(_errors(F.col("sig_a"), F.col("sig_b"))) <= MAX_DISTANCE)
    return both.where(fits).select("a", "b").distinct()


class _Texts:
    """The documents' texts and the groups of equal sets: fetches the sets of nodes."""

    def __init__(self, texts: DataFrame, groups: DataFrame):
        self.texts, self.groups = texts, groups

    def sets(self, ids: DataFrame) -> DataFrame:
        """``node`` and ``shingles`` of the nodes in ``ids``, read from the row that stands for each."""
        wanted = materialise(self.groups.join(ids, "node", "left_semi").select("node", "doc_id", "text_hash"), "needed")
        small = wanted.count() <= BROADCAST_IDS
        rows = self.texts.join(F.broadcast(wanted) if small else wanted, ["doc_id", "text_hash"]).select("node", "text")
        found = materialise(rows.mapInArrow(_only_sets, "node bigint, shingles array<bigint>"), "sets")
        discard(wanted)
        return found

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full shingle sets have at least three quarters in common."""
        pairs = materialise(pairs, "candidates")
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))
        common = F.size(F.array_intersect("s_a", "s_b"))
        found = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("i", common)
        links = materialise(found.where(100 * F.col("i") >= 75 * (F.size("s_a") + F.size("s_b") - F.col("i"))).select("a", "b"), "confirmed")
        discard(pairs, sets)
        return links


def _twins(full: DataFrame, groups: DataFrame) -> DataFrame | None:
    """Links between the sets of ids that stand on rows with different texts, if there are any."""
    several = full.groupBy("doc_id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo != hi").select("doc_id")
    several = materialise(several, "ids_of_several_texts")
    if several.isEmpty():
        return None
    held = full.join(several, "doc_id").select("doc_id", "set_hash").distinct().join(groups.select("set_hash", "node"), "set_hash")
    least = held.groupBy("doc_id").agg(F.min("node").alias("a"))
    return held.join(least, "doc_id").select("a", F.col("node").alias("b")).where("a != b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if 100 * intersection >= 75 * union of their sets of
    distinct five-word shingles; ``component_id`` is the smallest id reachable.

    1. A pass over the texts gives each its set's size, digest and signature of
       64 16-bit MinHash components. Equal sets become one node with a number.
    2. Signatures within MAX_DISTANCE differ in at most one component of some
       chunk of four (pigeonhole), so each node enters 64 buckets: every chunk
       with every component left out. In each bucket all members are first
       compared with its smallest member only, so a group of near copies gives
       as many pairs as members.
    3. The same again with a member drawn by the bucket's key, for members of
       other components.
    4. Members of one bucket that are in different components still are compared
       with each other, if what they share with any member allows a link; large
       buckets after more draws, and split by the other chunks.
    5. Pairs near enough by signature, size and parity bits are confirmed on full
       sets. Each member that one set alone has turns one of 512 bits at most, so
       bits that differ bound from below what the sets don't share, exactly.

    Nothing is capped or sampled. Empty and null texts have no shingles and are
    linked with nothing. Rows that repeat an id are one document: their sets are
    linked whatever they hold, and all have the id's component. Rows with a null
    id keep a null component and aren't kept. Bytes that are no UTF-8 count as
    U+FFFD. An empty table gives no rows, other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), readable(F.col(text_col)).alias("text"))
    feats = materialise(texts.mapInArrow(_features, "doc_id bigint, text_hash bigint, n bigint, set_hash binary, sig array<bigint>, odd array<bigint>"), "features")
    full = feats.where("n > 0 AND doc_id IS NOT NULL")
    # All rows of a group have its set, so any gives its size, signature and parity bits.
    any_of = [F.any_value(c).alias(c) for c in ("n", "sig", "odd")]
    groups = full.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.count("*").alias("copies"), *any_of)
    # The numbers are fixed by the write.
    groups = materialise(groups.select(F.monotonically_increasing_id().alias("node"), "set_hash", "at.doc_id", "at.text_hash", "copies", "n", "sig", "odd"), "groups")
    reps, fetch = groups.select("node", "n", "sig", "odd"), _Texts(texts, groups)
    keys = reps.select("node", F.posexplode(F.array(*[k for c in range(CHUNKS) for k in _chunk_keys(c)])).alias("slot", "key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    shared = materialise(shared, "shared_keys")
    buckets = materialise(keys.join(shared, "key"), "buckets")
    discard(shared)
    star = buckets.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    found = fetch.confirmed(_near(star, reps))
    twins = _twins(full, groups)
    links = materialise(found if twins is None else found.union(twins), "star_links")
    labels = components(links)
    links = materialise(links.union(fetch.confirmed(_near(_drawn(buckets.where("members > 2"), labels, 0), reps))), "links")
    labels = components(_residual(buckets.where("members > 2"), reps, links, fetch))
    # Only groups with copies or links need a lookup; all other rows are their own component.
    held = groups.select("node", "set_hash", "doc_id", "copies").join(labels, "node", "left").where("copies > 1 OR label IS NOT NULL")
    held = materialise(held.select("set_hash", "doc_id", F.coalesce("label", "node").alias("label")), "labels")
    known = held.join(held.groupBy("label").agg(F.min("doc_id").alias("component")), "label").select("set_hash", "component")
    moved = full.select("doc_id", "set_hash").join(known, "set_hash").where("doc_id != component").select("doc_id", "component").distinct()
    out = feats.select("doc_id", F.col("n").alias("n_shingles")).join(materialise(moved, "moved"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _drawn(members: DataFrame, labels: DataFrame, draw: int) -> DataFrame:
    """Pairs of a member drawn for each bucket and the bucket's members of other components."""
    rows = materialise(members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "labelled_buckets")
    order = F.xxhash64(F.lit(draw), "key", "node")
    pick = rows.groupBy("key").agg(F.min_by(F.struct("node", "label"), order).alias("p"))
    return rows.join(pick, "key").where("label != p.label").select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components still, with ``label`` and the bucket's size ``held``."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("held")).where("lo != hi").select("key", "held")
    return materialise(labelled.join(mixed, "key"), "mixed_buckets")


def _residual(buckets: DataFrame, reps: DataFrame, links: DataFrame, fetch: _Texts) -> DataFrame:
    """``links`` and those between members of one bucket that are in different components and may be linked.

    A link needs three quarters of either set in common, so shingles that no
    member of another component has bound what a node can share: with ``s``
    shared shingles at most ``s`` are common. Members that are boilerplate and
    otherwise their own, or copies changed too much, go before any pair is made.

    While the members left would make more than PAIRS_A_MEMBER pairs each, they
    are compared with drawn members and leave as components grow; buckets of more
    than SPLIT members that remain are split by their members' other chunks.
    """
    labels = components(links)
    members = _mixed(buckets.select("key", "slot", "node", "pivot"), labels)
    nodes = members.select("node", "label").distinct()
    sets = fetch.sets(nodes.select("node"))
    shingles = sets.join(nodes, "node").select("node", "label", F.explode("shingles").alias("shingle"))
    # A shingle that stands under one label only can't join two.
    joint = shingles.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("shingle")
    common = shingles.join(joint, "shingle").groupBy("node").agg(F.count("*").alias("s"))
    able = materialise(reps.join(common, "node").where("4 * s >= 3 * n"), "able_nodes")
    discard(sets)
    members = members.join(able.select("node"), "node", "left_semi").select("key", "slot", "node", "pivot")
    rows = _mixed(members, labels)
    for draw in range(1, MAX_DRAWS):
        load = rows.agg(F.count("*").alias("rows"), F.sum("held").alias("pairs")).first()
        if not load["rows"] or load["pairs"] <= 2 * PAIRS_A_MEMBER * load["rows"]:
            break
        links = materialise(links.union(fetch.confirmed(_near(_drawn(rows, labels, draw), reps))), "links")
        labels = components(links)
        left = _mixed(rows.select("key", "slot", "node", "pivot"), labels)
        if 10 * left.count() > 9 * load["rows"]:
            rows = left
            break
        rows = left
    pairs = _in_buckets(rows.where(F.col("held") <= SPLIT), able, [F.col("key")])
    if not rows.where(F.col("held") > SPLIT).isEmpty():
        pairs = pairs.union(_in_buckets(rows.where(F.col("held") > SPLIT), able, _second_keys()))
    return materialise(links.union(fetch.confirmed(pairs.distinct())), "more_links")


def _second_keys() -> list[Column]:
    """Keys of a member in a bucket: its other chunks with two components left out.

    Signatures within MAX_DISTANCE that share a bucket have at most two errors
    in a chunk besides the bucket's: at most 2 * CHUNKS - 1 over CHUNKS - 1 others.
    """
    out = []
    for chunk in range(CHUNKS):
        for a in range(CHUNK):
            for b in range(a):
                m = (0xFFFF << 16 * a) | (0xFFFF << 16 * b)
                two = F.get("sig", F.lit(chunk)).bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m))
                out.append(F.when(F.floor(F.col("slot") / CHUNK) != chunk, F.xxhash64("key", F.lit(16 * chunk + 4 * a + b), two)))
    return out


def _in_buckets(rows: DataFrame, able: DataFrame, keys: list[Column]) -> DataFrame:
    """Pairs of members of a bucket (and of one of ``keys``) that are in different components and may be linked."""
    full = rows.join(able, "node").withColumn("own", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())))
    side = lambda c: full.select("own", "key", "pivot", "slot", *[F.col(x).alias(f"{x}_{c}") for x in ("node", "label", "n", "sig", "odd", "s")])
    left, right = side("a").withColumnRenamed("own", "own_a").withColumnRenamed("key", "key_a"), side("b").drop("pivot", "slot").withColumnRenamed("own", "own_b").withColumnRenamed("key", "key_b")
    most = F.least("s_a", "s_b")
    may = (F.col("label_a") != F.col("label_b")) & (F.col("node_a") < F.col("node_b")) & (F.col("node_a") != F.col("pivot")) & (4 * most >= 3 * (F.col("n_a") + F.col("n_b") - most))
    # Each pair in the first bucket that it shares only.
    near = _few_apart() & _near_and_first(F.col("slot"), F.col("sig_a"), F.col("sig_b"))
    same = (F.col("own_a") == F.col("own_b")) & (F.col("key_a") == F.col("key_b"))
    return left.join(right, same & may & near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the rows whose id is their component's."""
    found = near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found.hint("merge"), id_col, "left_anti")
