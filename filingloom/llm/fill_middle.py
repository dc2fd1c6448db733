"""Fill-in-the-middle texts: units as rows, running sums of their lengths, cuts joined by the unit's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space that goes before a word belongs to it; what is left at the end is a unit of its own.
UNIT = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
#: Marks of prefix, suffix and middle, and the characters that are white space.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACES = " \t\n\x0b\x0c\r"


def _draw(id_col: Column, k: int, seed: int) -> Column:
    """The k-th (from 0) 8-digit group of the SHA-256 of seed and id, as a number; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def unit_count(text: Column) -> Column:
    """How many units a non-null text has: its words, and white space at its end."""
    blank = text
    for space in SPACES[1:]:
        blank = F.replace(blank, F.lit(space), F.lit(" "))
    words = F.size(F.array_remove(F.split(blank, " "), ""))
    return (words + F.when(F.substring(text, -1, 1).isin(*SPACES), 1).otherwise(0)).cast("long")


def _requests(dealt: DataFrame, seed: int, fim_percent: int, spm_percent: int) -> DataFrame:
    """``dealt`` with ``n``, ``form`` and the numbers of the units that end prefix and middle (``first``, ``second``), null if plain."""
    d = lambda k: _draw(F.col("id"), k, seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (d(2) % 100 >= fim_percent) | (F.col("text") == "") | marked
    form = F.when(plain, "plain").when(d(3) % 100 < spm_percent, "spm").otherwise("psm")
    counted = dealt.select("tag", "id", "text", form.alias("form"), unit_count(F.col("text")).alias("n"))
    cut = lambda k: F.when(F.col("form") != "plain", d(k) % (F.col("n") + 1))
    return counted.select("*", F.least(cut(0), cut(1)).alias("first"), F.greatest(cut(0), cut(1)).alias("second"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """One row per document: its id, ``text``, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    Of ``fim_percent`` in 100 documents the text is cut at two units that its id
    draws, and written as ``<P>prefix<S>suffix<M>middle`` (psm) or, for
    ``spm_percent`` in 100 of those, ``<S>suffix<P>prefix<M>middle`` (spm). Others, empty
    texts and texts with one of the marks stay as they are (plain).

    Texts are dealt by row once, and all that follows is in that dealing:
    the units up to a document's last cut become rows (posexplode), a window sums their lengths,
    the requests meet units by number, offsets are reduced to one row per document
    and meet its text. Documents without cuts have no unit rows.

    Null texts are empty, a null id draws as an empty one; rows that repeat are
    rows of their own; an empty table gives no rows; other columns are not read.
    Rows are numbered as they are read, so ``docs`` should come from files or a
    written table if executors may be lost.
    """
    dealt = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tag")).repartition("tag")
    asked = _requests(dealt, seed, fim_percent, spm_percent)
    # No filter here and no inner explode: the planner would move them before the dealing, which then could not be shared.
    matches = F.when(F.col("second") > 0, F.slice(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), F.lit(1), F.col("second").cast("int")))
    units = asked.select("tag", F.posexplode_outer(matches).alias("at", "unit")).where("unit IS NOT NULL")
    so_far = Window.partitionBy("tag").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = units.select("tag", (F.col("at") + 1).alias("ordinal"), F.length("unit").alias("chars")).withColumn("upto", F.sum("chars").over(so_far))
    wanted = asked.select(F.col("tag").alias("of"), "first", "second").hint("merge")
    met = summed.join(wanted, (F.col("tag") == F.col("of")) & ((F.col("ordinal") == F.col("first")) | (F.col("ordinal") == F.col("second"))))
    offsets = met.groupBy("tag").agg(
        F.max(F.when(F.col("ordinal") == F.col("first"), F.col("upto"))).alias("a"), F.max(F.when(F.col("ordinal") == F.col("second"), F.col("upto"))).alias("b")
    )
    done = asked.join(offsets.hint("merge"), "tag", "left").select(
        "id", "text", "n", "form", F.when(F.col("form") != "plain", F.coalesce("a", F.lit(0))).alias("a"), F.when(F.col("form") != "plain", F.coalesce("b", F.lit(0))).alias("b")
    )
    prefix, middle = F.substring("text", F.lit(1), F.col("a").cast("int")), F.substring("text", F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int"))
    suffix = F.substr("text", F.col("b").cast("int") + 1)
    spm, psm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle), F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(F.col("text"))
    return done.select(
        F.col("id").alias(id_col), "text", "n", "form", F.col("a").cast("long").alias("prefix_chars"), (F.col("b") - F.col("a")).cast("long").alias("middle_chars"), output.alias("output")
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` wrote as ``output``."""
    between = lambda a, b: F.substr(output, F.instr(output, a) + 3, F.instr(output, b) - F.instr(output, a) - 3)
    middle = F.substr(output, F.instr(output, MIDDLE) + 3)
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)
