"""Titles and headers: dates off, words mended, cases set; columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingloom.functions.period import MONTHS, quarter_of_month
from filingloom.functions.text import dedupe_words

#: Words that scans break, and their mended form.
BROKEN = [
    ("Manageme nt", "Management"), ("manageme nt", "management"), ("Institutio nal", "Institutional"), ("institutio nal", "institutional"),
    ("Investme nt", "Investment"), ("investme nt", "investment"), ("Securitie s", "Securities"), ("securitie s", "securities"),
    ("Advisor-led", "Advisor-Led"), ("Self-directed", "Self-Directed"),
]
#: Heads of a title's date, and the part of the period code they stand for, first fit wins.
DATE_HEADS = [
    ("\\s*(?:for\\s+the\\s+)?three\\s+months?\\s+ended", "QTD"),
    ("\\s*(?:for\\s+the\\s+)?six\\s+months?\\s+ended", "YTD"),
    ("\\s*(?:for\\s+the\\s+)?nine\\s+months?\\s+ended", "YTD"),
    ("\\s*(?:for\\s+the\\s+)?year\\s+ended", "ANNUAL"),
    ("\\s+(?:at|as\\s+of)", "POINT"),
]
#: What a header loses so that its date remains, in this order.
DATE_PREFIXES = [
    "three\\s+months?\\s+ended\\s*", "six\\s+months?\\s+ended\\s*", "nine\\s+months?\\s+ended\\s*", "twelve\\s+months?\\s+ended\\s*",
    "year\\s+ended\\s*", "quarter\\s+ended\\s*", "period\\s+ended\\s*", "ended\\s+", "^at\\s+", "^as\\s+of\\s+",
]
#: What a lower-case title loses before tables are grouped by it, in this order.
TITLE_NOISE = [
    ("\\s*\\(rows?\\s*\\d+[-–]\\d+\\)\\s*$", ""), ("\\s*\\(part\\s*\\d+\\)\\s*", " "), ("_?\\s*\\$\\s*in\\s*(billions?|millions?)\\s*$", ""),
    ("_?\\s*\\(\\s*\\$\\s*in\\s*(billions?|millions?)\\s*\\)\\s*$", ""), ("^\\d+[.:\\s]+\\s*", ""), ("^note\\s+\\d+\\.?\\s*[-–:]?\\s*", ""), ("^table\\s+\\d+\\.?\\s*[-–:]?\\s*", ""),
]
#: Where the period of a compound header begins, first fit wins.
PERIOD_STARTS = [
    "three months ended", "six months ended", "nine months ended", "year ended", "fiscal year ended",
    "at march", "at june", "at september", "at december", "at january", "at february", "at april", "at may", "at july", "at august", "at october", "at november",
    "as of march", "as of june", "as of september", "as of december",
]
#: Words that stay upper case, and words that stay lower case behind the first.
ACRONYMS = ["ROE", "ROTCE", "GAAP", "DCP", "HQLA", "CRE", "LTV", "FICO", "US", "UK"]
SMALL_WORDS = ["and", "or", "the", "of", "to", "in", "for", "on", "at", "by", "with"]


def title_letters(text: Column) -> Column:
    """Every letter behind no other letter in upper case, all others in lower case."""
    # Pieces end behind each character that is no letter, so only their first one is upper case.
    pieces = F.split(F.lower(text), "(?<=\\P{L})")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def _once(value: Column, f) -> Column:
    """f(value), with the value evaluated once however often f names it."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def mend_words(text: Column) -> Column:
    for broken, whole in BROKEN:
        text = F.replace(text, F.lit(broken), F.lit(whole))
    return text


def date_suffix(title: Column) -> Column:
    """(title, suffix, code): ``Borrowings at March 31, 2025`` is ``Borrowings``, `` at March 31, 2025`` and ``Q1-2025``.

    What follows an underscore behind the date stays with the title; without a date the suffix and code are empty.
    """
    tail = f"\\s+({'|'.join(MONTHS)})\\s+\\d{{1,2}},?\\s+(20\\d{{2}})(?:\\s*\\(part\\s*\\d+\\))?(?:_|$)"

    def parts(whole: Column, found: Column, pattern: str, kind: str) -> Column:
        quarter = F.concat(F.lit("Q"), quarter_of_month(found).cast("string"))
        year = F.regexp_extract(found, pattern, 2)
        code = {"ANNUAL": F.concat_ws("-", F.lit("YTD"), year), "POINT": F.concat_ws("-", quarter, year)}.get(kind, F.concat_ws("-", quarter, F.lit(kind), year))
        at = F.regexp_instr(whole, F.lit(pattern))
        rest = F.when(found.endswith("_"), F.substr(whole, at + F.length(found) - 1)).otherwise("")
        name = F.concat(F.trim(F.substr(whole, F.lit(1), at - 1)), rest)
        return F.struct(name.alias("title"), F.regexp_replace(found, "_$", "").alias("suffix"), code.alias("code"))

    def first_fit(whole: Column) -> Column:
        out = F.struct(whole.alias("title"), F.lit("").alias("suffix"), F.lit("").alias("code"))
        for head, kind in reversed(DATE_HEADS):
            pattern = f"(?i){head}{tail}"
            one = _once(F.regexp_extract(whole, pattern, 0), lambda m, p=pattern, k=kind: parts(whole, m, p, k))
            out = F.when(whole.rlike(pattern), one).otherwise(out)
        return out

    return _once(F.trim(title), first_fit)


def date_of_header(header: Column) -> Column:
    """A header without its period phrase; itself if nothing is left."""
    bare = header
    for p in DATE_PREFIXES:
        bare = F.regexp_replace(bare, "(?i)" + p, "")
    bare = F.regexp_replace(F.trim(F.regexp_replace(bare, "\\s+", " ")), "^,\\s*", "")
    return F.when(bare == "", header).otherwise(bare)


def grouping_title(title: Column) -> Column:
    """The lower-case title by which tables of several filings meet: no date, rows, part, unit, number; ``untitled`` if nothing is left, empty without a title."""
    plain = F.lower(F.trim(date_suffix(mend_words(title))["title"]))
    for p, by in TITLE_NOISE:
        plain = F.regexp_replace(plain, p, by)
    plain = F.trim(F.regexp_replace(plain, "\\s+", " "))
    return F.when(F.coalesce(title, F.lit("")) == "", "").otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.lit("untitled")))


def header_key(header: Column) -> Column:
    """A header by which duplicates are found: no punctuation at the end, months in full, ``2024.0`` as ``2024``, title case."""
    key = F.lower(F.regexp_replace(F.trim(header), "[.,;:]+$", ""))
    for month in MONTHS:
        key = F.regexp_replace(key, f"\\b{month[:3]}\\b", month)
    return F.coalesce(title_letters(F.regexp_replace(key, "(\\d{4})\\.0\\b", "$1")), F.lit(""))


def title_case(text: Column) -> Column:
    """Words capitalised but for acronyms and, behind the first word, small words."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    one = lambda w, i: F.when(F.upper(w).isin(ACRONYMS), F.upper(w)).when((i > 0) & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(F.initcap(w))
    return F.array_join(F.transform(words, one), " ")


def clean_header(header: Column) -> Column:
    """Without words that repeat the one before and without a footnote's number at the end; ``Level 1``, ``Tier 1`` and ``Type 1`` keep it."""
    once = dedupe_words(F.coalesce(header, F.lit("")))
    return F.when(once.rlike("(?i)\\b(level|tier|type)\\s+\\d+$"), once).otherwise(F.regexp_replace(once, "\\s+\\d+$", ""))


def compound_header(header: Column) -> Column:
    """(l1, l2): a header parted where its period begins; all of it is ``l2`` if none does behind the first character."""
    text = F.coalesce(header, F.lit(""))
    at = F.coalesce(*[F.when(F.instr(F.lower(text), p) > 1, F.instr(F.lower(text), p)) for p in PERIOD_STARTS])
    tail = F.trim(F.substr(text, at))
    l2 = F.concat(F.upper(F.substring(tail, 1, 1)), F.substr(tail, F.lit(2)))
    return F.struct(F.coalesce(F.trim(F.substr(text, F.lit(1), at - 1)), F.lit("")).alias("l1"), F.coalesce(l2, text).alias("l2"))


def title_of_sheet(name: Column) -> Column:
    """``51_table_3`` is ``Table 3``; empty without an underscore or for a bare ``Table``."""
    title = title_letters(F.replace(F.regexp_extract(name, "^[^_]*_(.*)$", 1), F.lit("_"), F.lit(" ")))
    return F.when(F.coalesce(title, F.lit("")) == "Table", "").otherwise(F.coalesce(title, F.lit("")))


def title_of_cells(cells: Column) -> Column:
    """The first of the first three cells with 11 to 99 characters and no digit among its first five; empty without one."""
    fits = lambda c: F.length(c).between(11, 99) & ~F.substring(c, 1, 5).rlike("\\d")
    return F.coalesce(F.get(F.filter(F.slice(cells, 1, 3), fits), F.lit(0)), F.lit(""))


def placeholder(sheet: Column, number: Column) -> Column:
    """(section, title, source) of a table that has none of its own."""
    named = F.coalesce(sheet, F.lit("")) != ""
    title = F.when(named, F.concat(F.lit("Table from "), sheet)).otherwise(F.concat(F.lit("Table "), number.cast("string")))
    source = F.when(named, F.concat(F.lit("Sheet "), sheet)).otherwise("Unknown")
    return F.struct(F.lit("[MISSING]").alias("section"), F.concat(F.lit("[AUTO] "), title).alias("title"), F.concat(F.lit("[AUTO] "), source).alias("source"))


def spanning_row(header: Column, width: Column) -> Column:
    """The cells of a first row for a header over all columns but the first."""
    return F.concat(F.array(F.lit("")), F.array_repeat(header, F.greatest(width - 1, F.lit(0)).cast("int")))
