"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import SPACE, let, materialise, row_key, word_array
from filingloom.llm.weak_labels import VoteModel, fit

WINDOW = 8
#: Words over which distinct ones are counted.
BLOCK = 500
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares of the bad rows that a rule may find.
FOUND = (0.05, 0.9)
RULES = ("r_word_length", "r_symbols", "r_dup_lines", "r_repeats", "r_adjacent", "r_upper", "r_marks", "r_punctuation", "r_variety")


def _covered(places: Column) -> Column:
    """Words that windows at the sorted ``places`` cover."""
    steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda a, s: a + s)


def _repeat_places(hashes: Column) -> Column:
    """Sorted places whose window hash occurs elsewhere too."""
    marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def pick(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]),
        )
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    return let(marked, pick)


def repeat_words(words: Column) -> Column:
    """Words in 8-word windows that the text holds twice or more, the first one included.

    Windows are compared by 64-bit hashes. Most texts repeat none: one sort of
    the hashes shows that, and only the others sort (hash, place) pairs.
    """

    def of_windows(hashes: Column) -> Column:
        some = let(F.sort_array(hashes), lambda s: F.exists(F.transform(s, lambda x, k: F.coalesce(x == F.get(s, k + 1), F.lit(False))), lambda b: b))
        return F.when(some, let(_repeat_places(hashes), _covered)).otherwise(F.lit(0))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(F.size(words) > WINDOW, let(windows, of_windows)).otherwise(F.lit(0))


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each document row: ``doc_id``, ``_id`` and ``_h`` (its key), STATS and what rules read.

    Null text counts as empty. Everything is a projection: no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            # Distinct within each block, so that length alone lowers no share.
            F.aggregate(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")), F.lit(0), lambda a, k: a + F.size(F.array_distinct(F.slice(w, k * BLOCK + 1, F.lit(BLOCK))))).cast("long").alias("n_distinct"),
            F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_adjacent"),
        )

    def of_lines(a: Column) -> Column:
        return F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))

    return docs.select(
        F.col(id_col).alias("doc_id"),
        *row_key(F.col(id_col), F.col(text_col)),
        let(word_array(text), of_words).alias("_w"),
        let(lines, of_lines).alias("_l"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D\\p{L}\\p{N}\\p{M}]")).cast("long").alias("n_punct"),
    ).select(
        "doc_id", "_id", "_h", "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_w.n_distinct", "_w.n_adjacent", "_l.n_lines", "n_upper", "n_marks", "n_punct",
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def rule_votes() -> dict[str, Column]:
    """Each rule's vote over the columns of ``stats``: 0 bad, 1 good, null abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    mean_word = chars / words
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    rep = F.col("n_repeat_words") / words
    variety = F.col("n_distinct") / words
    return {
        "r_word_length": _vote((mean_word > 20) | (mean_word < 2), (mean_word >= 3) & (mean_word <= 10)),
        "r_symbols": _vote(F.col("n_symbols") / words > 0.15, F.col("n_symbols") / words < 0.05),
        "r_dup_lines": _vote((dup > 0.3) & (F.col("n_dup_lines") >= 2), (dup < 0.1) & (F.col("n_lines") >= 4)),
        "r_repeats": _vote(rep > 0.2, rep < 0.05),
        "r_adjacent": _vote(F.col("n_adjacent") / words > 0.2, F.col("n_adjacent") / words < 0.02),
        "r_upper": _vote(F.col("n_upper") / chars > 0.4, F.col("n_upper") / chars < 0.15),
        "r_marks": _vote(F.col("n_marks") / words > 0.3, F.col("n_marks") / words < 0.1),
        "r_punctuation": _vote(F.col("n_punct") / words > 0.5, F.col("n_punct") / words < 0.25),
        "r_variety": _vote((variety < 0.15) & (F.col("n_words") >= 50), (variety > 0.3) & (F.col("n_words") >= 50)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, model: VoteModel | None = None) -> DataFrame:
    """Judge every document row.

    Returns ``doc_id``, the key ``_id``/``_h``, STATS, ``base_failed``, the votes,
    ``posterior`` (probability of good quality) and ``kept``: false if the base
    test fails or the posterior is below ``threshold``.

    The votes of all rows fit the model, unless one is given. Null and empty texts have zero counts and fail the base test;
    repeated rows are judged alike, each on its own; an empty table gives no
    rows; other columns of ``docs`` are not read.
    """
    found = materialise(stats(docs, id_col, text_col), "quality_stats").withColumn("base_failed", base_failed())
    voted = found.withColumns(rule_votes())
    if model is None:
        model = fit(voted, RULES, found=FOUND)
    posterior = model.posterior({n: F.col(n) for n in RULES})
    return voted.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def rejected(docs: DataFrame, **kw) -> DataFrame:
    """Row keys of the documents that ``judge`` doesn't keep."""
    return judge(docs, **kw).where(~F.col("kept")).select("_id", "_h")
