"""Exact duplicates by a tree merge of sorted digest runs: expressions and shuffles only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import discard, materialise

#: Runs that one merge takes in: four binomial rounds at once.
FAN = 16
#: The letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What an entry is sorted by, and what verifies that equal digests are equal texts.
ENTRY = ["segment", "digest", "sha", "bytes"]


def normalised(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; null is empty. ASCII alone takes the faster way to the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _runs(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """Each task's rows as a run that is sorted by digest, with ``carried`` in ``row``."""
    rows = docs.select(
        F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"), F.struct(*[F.col(c) for c in carried] or [F.lit(None)]).alias("row"),
        F.spark_partition_id().alias("node"), F.monotonically_increasing_id().alias("tag"),
    )
    digest = F.xxhash64("text")
    entries = rows.select(
        "node", "tag", "id", F.shiftrightunsigned(digest, 48).cast("int").alias("segment"), digest.alias("digest"),
        F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("bytes"), *(["row"] if carried else []),
    )
    return materialise(entries.sortWithinPartitions(*ENTRY), "sorted_runs")


def _merge(entries: DataFrame, node: Column, best: Column, n: Column) -> DataFrame:
    """Runs of one node become one: equal entries keep the best identifier and the sum of rows."""
    return entries.select(node.cast("int").alias("node"), *ENTRY, best.alias("best"), n.alias("n")).groupBy("node", *ENTRY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def _judged(runs: DataFrame, keep: str) -> DataFrame:
    """``runs`` with ``best`` (see ``exact_duplicates``) and ``n``, null for texts that stand once."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    # The smallest is the largest of what is left when the id's order is turned round; only numbers can be turned.
    id_type = dict(runs.dtypes)["id"]
    if keep == "smallest" and id_type not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("keep='smallest' takes integer ids")
    order = F.col("id") if keep == "largest" else -F.col("id").cast("decimal(20,0)")
    best = F.struct(order.alias("order"), (-F.col("tag")).alias("first"), F.col("id").alias("id"))
    levels = [materialise(_merge(runs, F.col("node"), best, F.lit(1)), "merged_runs")]
    width = (runs.agg(F.max("node")).first()[0] or 0) + 1
    while width > 1:
        levels.append(materialise(_merge(levels[-1], F.floor(F.col("node") / FAN), F.col("best"), F.col("n")), "merged_runs"))
        width = -(-width // FAN)
    # Back down the way that the runs came: an entry meets at most FAN of the level below, so no text is a hot key.
    found = levels[-1].where("n > 1")
    for level in reversed(levels[:-1]):
        below = level.select(F.col("node").alias("child"), F.floor(F.col("node") / FAN).cast("int").alias("node"), *ENTRY)
        found = below.join(found.hint("merge"), ["node", *ENTRY]).select(F.col("child").alias("node"), *ENTRY, "best", "n")
    found = materialise(found, "repeated_entries")
    discard(*levels)
    return runs.join(found.hint("merge"), ["node", *ENTRY], "left")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; of equal ones the row
    with the ``keep`` id stays.

    1. Each task writes its rows as a run sorted by a 64-bit digest.
    2. Runs are merged in rounds, ``FAN`` neighbours into one, until one is left. A
       merge is dealt by segments of the digest too, so that no task holds a whole
       run. At every level entries of equal digest are one only if SHA-256 and
       length in bytes agree as well; the one kept is the best identifier so far.
    3. Repeated entries go back down the same tree to the rows. A text that a third of all rows
       share is one entry in each run, and meets at most ``FAN`` others in a merge.

    Null texts are empty. Null ids lose to others; a group of null ids alone
    keeps one, with a null ``keep_id``. Of rows that repeat the kept id the first
    read stays. An empty table gives no rows; other columns are not read.
    """
    judged = _judged(_runs(docs, id_col, text_col, []), keep)
    size = F.coalesce("n", F.lit(1)).cast("long")
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id"))
    return judged.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), size.alias("group_size"), _kept().alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _kept() -> Column:
    return F.col("n").isNull() | (F.col("best.first") == -F.col("tag"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_duplicates``."""
    judged = _judged(_runs(docs, id_col, text_col, docs.columns), keep)
    return judged.where(_kept()).select("row.*")
