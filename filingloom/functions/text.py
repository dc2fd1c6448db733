"""Cleaning and classing of cell texts, titles and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of each table type, first fit wins.
TABLE_TYPES = [
    ("balance_sheet", ["balance sheet", "statement of financial position", "assets", "liabilities", "equity"]),
    ("income_statement", ["income statement", "statement of operations", "statement of earnings", "revenues", "expenses"]),
    ("cash_flow", ["cash flow", "statement of cash flows", "operating activities", "investing activities", "financing activities"]),
    ("equity", ["stockholders equity", "shareholders equity", "statement of equity", "changes in equity"]),
    ("notes", ["note", "footnote", "disclosure"]),
]
#: Words of each question type, first fit wins.
QUESTIONS = [
    ("quantitative", ["how much", "what was", "what is", "total"]),
    ("explanatory", ["why", "explain", "reason"]),
    ("comparative", ["compare", "difference", "versus", "vs"]),
    ("enumerative", ["list", "what are", "show all"]),
    ("trend", ["trend", "change", "growth", "over time"]),
]
#: Currencies by symbol and code, first fit wins.
CURRENCIES = [("USD", "$", "usd"), ("EUR", "€", "eur"), ("GBP", "£", "gbp")]


def _first_fit(text: Column, classes: list[tuple[str, list[str]]], default: str) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(default)
    for name, words in reversed(classes):
        fits = F.lit(False)
        for w in words:
            fits = fits | low.contains(w)
        out = F.when(fits, name).otherwise(out)
    return out


def table_type(title: Column) -> Column:
    return _first_fit(title, TABLE_TYPES, "other")


def question_type(text: Column) -> Column:
    return _first_fit(text, QUESTIONS, "general")


def currency_of(text: Column) -> Column:
    """(code, found) by symbol or code; (USD, false) without one."""
    t = F.coalesce(text, F.lit(""))
    code = F.lit(None).cast("string")
    for name, symbol, word in reversed(CURRENCIES):
        code = F.when(t.contains(symbol) | F.lower(t).contains(word), name).otherwise(code)
    return F.struct(F.coalesce(code, F.lit("USD")).alias("code"), code.isNotNull().alias("found"))


def footnotes(text: Column) -> Column:
    """(clean, refs): text without ``(1)`` marks and superscript digits, and the marks in order, each once."""
    digits = F.translate(text, "¹²³⁴⁵⁶⁷⁸⁹", "123456789")
    marks = F.regexp_extract_all(F.regexp_replace(text, "([¹²³⁴⁵⁶⁷⁸⁹])", "($1)"), F.lit("\\((\\d{1,2}|[¹²³⁴⁵⁶⁷⁸⁹])\\)"), F.lit(1))
    clean = F.regexp_replace(F.regexp_replace(text, "\\s*\\(\\d{1,2}\\)", ""), "[¹²³⁴⁵⁶⁷⁸⁹]", "")
    refs = F.array_distinct(F.transform(marks, lambda m: F.translate(m, "¹²³⁴⁵⁶⁷⁸⁹", "123456789")))
    return F.struct(F.trim(F.regexp_replace(clean, "\\s+", " ")).alias("clean"), F.when(digits.isNotNull(), refs).alias("refs"))


def dedupe_words(text: Column) -> Column:
    """Without words that repeat the one before, whatever their case."""
    words = F.filter(F.split(F.trim(text), "\\s+"), lambda w: w != "")
    # The words are a lambda's argument, else they would be split anew for each word.
    kept = F.transform(F.array(words), lambda all_: F.filter(all_, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(all_, i - 1)))))[0]
    return F.array_join(kept, " ")


def halve(text: Column) -> Column:
    """The first half of a text of ten characters or more whose halves are equal but for white space around them."""
    n = F.length(text)
    mid = F.floor(n / 2).cast("int")
    left, right = F.trim(F.substring(text, F.lit(1), mid)), F.trim(F.substring(text, mid + 1, n))
    return F.when((n >= 10) & (left == right), left).otherwise(text)


def sheet_name(name: Column, most: int = 31) -> Column:
    """Without characters that sheets forbid, cut to ``most`` with dots; ``Sheet`` if nothing is left."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), "[\\[\\]:*?/\\\\]", "")
    cut = F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most - 3), F.lit("..."))).otherwise(plain)
    return F.coalesce(F.nullif(F.trim(cut), F.lit("")), F.lit("Sheet"))


def column_letters(n: Column) -> Column:
    """Spreadsheet letters of a column number from 1 to 18,278."""
    letter = lambda k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.pmod(k, F.lit(26)) + 1).cast("int"), F.lit(1))
    z = n - 1
    two, three = F.floor(z / 26) - 1, F.floor((F.floor(z / 26) - 1) / 26) - 1
    return F.concat(F.when(n > 702, letter(three)).otherwise(""), F.when(n > 26, letter(two)).otherwise(""), letter(z))


def comma_amounts(text: Column) -> Column:
    """``$1234567`` becomes ``$1,234,567``: a comma before each group of three digits of a dollar amount."""
    return F.regexp_replace(text, "(?<=\\$\\d{1,12})(?=(\\d{3})+(?!\\d))", ",")


def cache_key(query: Column, filters: Column, top_k: Column) -> Column:
    """md5 of the trimmed lower-case query, the filters' JSON and the number of results."""
    return F.md5(F.concat_ws("|", F.lower(F.trim(query)), filters, top_k.cast("string")))


def distinct_in_order(items: Column) -> Column:
    """Items whose lower case without outer blanks is new, in order."""
    keys = F.transform(items, lambda x: F.lower(F.trim(x)))
    return F.filter(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def shown(items: Column, most: int = 5) -> Column:
    """The first items joined by commas, and how many more there are."""
    more = F.size(items) - most
    head = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(more > 0, F.concat(head, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(head)


def combine_key(*parts: Column) -> Column:
    """A grouping key that ``split_key`` takes apart again, whatever the parts hold."""
    escaped = [F.replace(F.replace(F.coalesce(p, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")) for p in parts]
    return F.concat_ws("|", *escaped)


def split_key(key: Column) -> Column:
    return F.transform(F.split(key, "\\|", -1), lambda p: F.replace(F.replace(p, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%")))
