"""Removal of repeated runs of lines: chunks with bounds that the lines themselves choose, whole documents, passages of over fifty words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import discard, fresh, let, materialise, row_key

#: A line of so many characters (some fifty words) is a chunk by itself.
SOLO_CHARS = 240
#: A span is its first line times this and its number of lines.
_SPAN = 1 << 32
#: A run of lines with so many words is removed where it stands elsewhere before.
PASSAGE_WORDS = 51


def _ends(lines: Column) -> Column:
    """Indices of the lines that end a chunk.

    The rolling hash at a line is taken over the hashes of it and the line
    before; a chunk ends where that hash is lower than at both neighbours, so
    bounds depend on nearby lines only and shift with them, but never before the
    last line. Long lines end the chunk before them and their own.
    """
    # md5 gives an order that any engine can recompute.
    line_hash = F.transform(lines, lambda line: F.md5(line))

    def of_hashes(h: Column) -> Column:
        rolling = F.transform(h, lambda x, i: F.md5(F.concat(F.coalesce(F.get(h, i - 1), F.lit("")), x)))

        def pick(r: Column) -> Column:
            solo = lambda i: F.coalesce(F.length(F.get(lines, i)) >= SOLO_CHARS, F.lit(False))
            low = lambda i: F.coalesce((i < F.size(r) - 2) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) < F.get(r, i + 1)), F.lit(False))
            every = F.sequence(F.lit(0), F.size(r) - 1)
            return F.filter(every, lambda i: (i == F.size(r) - 1) | solo(i) | solo(i + 1) | low(i))

        return let(rolling, pick)

    return let(line_hash, of_hashes)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _words(line: Column) -> Column:
    """The words of a line; a literal blank is split on several times faster than a pattern."""
    for space in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(space), F.lit(" "))
    return F.size(F.array_remove(F.split(line, " "), ""))


def _spans(lines: Column) -> Column:
    """Runs of lines (first, n) that are compared.

    The chunks; the whole document; and from and up to each
    line with words the shortest run of ``PASSAGE_WORDS``. A run of so many
    words that stands in two places is the union of such shortest runs, so what
    stands around it does not matter.
    """
    span = lambda first, n: F.struct(first.cast("int").alias("first"), n.cast("int").alias("n"))

    def of_chunks(ends: Column) -> Column:
        def one(e: Column, k: Column) -> Column:
            first = F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
            return span(first, e - first + 1)

        return F.transform(ends, one)

    def of_counts(counts: Column) -> Column:
        # The line of each word, and the words up to the end of each line.
        line_of = F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i, n)))
        upto = _running(counts)

        def runs(x: Column) -> Column:
            at, end = x["line_of"], x["upto"]
            starts = F.filter(F.sequence(F.lit(0), F.size(end) - 1), lambda i: F.get(counts, i) > 0)
            onward = F.transform(starts, lambda i: span(i, F.get(at, F.get(end, i) - F.get(counts, i) + (PASSAGE_WORDS - 1)) - i + 1))
            back = F.transform(starts, lambda i: let(F.get(at, F.get(end, i) - PASSAGE_WORDS), lambda first: span(first, i - first + 1)))
            # Chunks and documents of white space stay, and so does one short line.
            worded = lambda s: F.get(end, s["first"] + s["n"] - 1) > F.get(end, s["first"]) - F.get(counts, s["first"])
            long = lambda s: (s["n"] > 1) | (F.length(F.get(lines, s["first"])) >= SOLO_CHARS)
            others = F.concat(let(_ends(lines), of_chunks), F.array(span(F.lit(0), F.size(lines))))
            return F.concat(F.filter(others, lambda s: long(s) & worded(s)), F.filter(F.concat(onward, back), lambda s: s["first"].isNotNull() & s["n"].isNotNull()))

        return let(F.struct(line_of.alias("line_of"), upto.alias("upto")), runs)

    # One number for each, as an array of structs finds its repeats by comparing all with all.
    return F.array_distinct(F.transform(let(F.transform(lines, _words), of_counts), lambda s: s["first"].cast("long") * _SPAN + s["n"]))


def _running(counts: Column) -> Column:
    """Sums up to each number of an array, by blocks of the root of its length: the work grows with its power of 1.5."""
    add = lambda numbers: F.aggregate(numbers, F.lit(0), lambda s, n: s + n)

    def of_blocks(b: Column) -> Column:
        part = lambda i: F.slice(counts, i * b + 1, b)
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(counts) - 1) / b).cast("int")), lambda i: add(part(i)))
        before = lambda s: F.transform(s, lambda x, i: add(F.slice(s, F.lit(1), i)))
        inner = lambda start, i: let(part(i), lambda p: F.transform(p, lambda x, j: start + add(F.slice(p, F.lit(1), j + 1))))
        return F.flatten(F.transform(let(sums, before), inner))

    return F.when(F.size(counts) == 0, counts).otherwise(let(F.ceil(F.sqrt(F.size(counts))).cast("int"), of_blocks))


def _occurrences(parts: DataFrame) -> DataFrame:
    """Place, lines and digests of each run of ``_lines``."""
    # An inner explode would have the planner filter on the spans, and compute them three times.
    found = parts.select("_id", "_h", "_lines", F.explode_outer(_spans(F.col("_lines"))).alias("s")).where("s IS NOT NULL")
    found = found.select("_id", "_h", "_lines", F.shiftright("s", 32).cast("int").alias("first"), F.col("s").bitwiseAND(_SPAN - 1).cast("int").alias("n"))
    return found.select("_id", "_h", "first", "n", *_digests(F.slice("_lines", F.col("first") + 1, F.col("n"))))


def _digests(run: Column) -> list[Column]:
    return [F.xxhash64(run).alias("d1"), F.xxhash64(F.lit(1), run).alias("d2")]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated runs of lines removed from the text, and ``removed_lines``.

    Runs are content-defined chunks of two lines or more, single lines of
    SOLO_CHARS or more, whole documents of either kind, and for each line the
    shortest runs of over fifty words that begin or end with it, so that a
    passage is found whatever stands around it. A run that stands in several
    places stays at the first (smallest document id, then line) and goes
    elsewhere; so a removed line always equals one that stands earlier. Runs are
    found by two 64-bit digests and removed only if the smallest and the largest
    text under the digests are equal byte by byte.

    1. Digests alone are counted (pre-aggregated), and joined back to give each
       document the list of its repeated runs. A digest with a third of all rows
       is split by the planner, as the next exchange is by document.
    2. Lists and texts meet by document, once, at any size; nothing is broadcast.
    3. The texts of repeated runs are reduced to a smallest and a largest by each
       task before they meet. Digests under which those differ are left alone;
       only if there are any a second pass by document is made.

    Null texts stay null, empty ones empty; one short line is never removed;
    runs of white space stay; rows that repeat an id and text keep the same
    lines; an empty table gives no rows; other columns pass through unchanged.
    A text keeps the line feeds between the lines it keeps. Where a column has the
    name of an added one, that gets ``_`` at its end until it is new.
    """
    key = row_key(F.col(id_col), F.col(text_col))
    place = F.struct("_id", "_h", "first")
    seen = materialise(_occurrences(docs.select(*key, _lines(F.col(text_col)).alias("_lines"))), "run_digests")
    repeated = materialise(seen.groupBy("d1", "d2").agg(F.count("*").alias("times"), F.min(place).alias("earliest")).where("times > 1").select("d1", "d2", "earliest"), "repeated_runs")
    marks = seen.join(repeated.hint("merge"), ["d1", "d2"]).groupBy("_id", "_h").agg(
        F.collect_set(F.struct("first", "n", (place != F.col("earliest")).alias("later"))).alias("_marks")
    )
    marks = materialise(marks, "marks")
    discard(seen, repeated)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *key)
    marked = materialise(rows.join(marks.hint("merge"), ["_id", "_h"], "left"), "marked_rows")
    # Texts are split before their marks are exploded, not once for each mark.
    runs = marked.where("_marks IS NOT NULL").select("_id", "_h", "_marks", _lines(F.col("_row")[text_col]).alias("_lines")).select("_id", "_h", "_lines", F.explode("_marks").alias("m"))
    runs = runs.select("_id", "_h", "m", F.slice("_lines", F.col("m.first") + 1, F.col("m.n")).alias("run")).select("_id", "_h", "m", *_digests(F.col("run")), F.array_join("run", "\n").alias("run"))
    unequal = runs.groupBy("d1", "d2").agg(F.min("run").alias("lo"), F.max("run").alias("hi")).where("lo != hi").select("d1", "d2")
    unequal = materialise(unequal, "unequal_runs")
    if not unequal.isEmpty():
        spared = runs.select("_id", "_h", "m", "d1", "d2").join(unequal, ["d1", "d2"]).groupBy("_id", "_h").agg(F.collect_set("m").alias("_spared"))
        marked = marked.join(spared.hint("merge"), ["_id", "_h"], "left").withColumn("_marks", F.when(F.col("_spared").isNull(), F.col("_marks")).otherwise(F.array_except("_marks", "_spared")))
    gone = F.filter("_marks", lambda m: m["later"])
    out = F.array_distinct(F.flatten(F.transform(gone, lambda m: F.sequence(m["first"], m["first"] + m["n"] - 1))))
    cut = marked.select("_row", F.when(F.exists("_marks", lambda m: m["later"]), out).alias("_out"), _lines(F.col("_row")[text_col]).alias("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_out"))
    text = F.when(F.col("_out").isNull(), F.col("_row")[text_col]).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    return cut.select(
        *[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns],
        F.when(F.col("_out").isNull(), 0).otherwise(F.size("_out")).alias(fresh("removed_lines", [c for c in docs.columns if c != text_col])),
    )
