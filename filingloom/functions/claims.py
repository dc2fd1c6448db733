"""Claims of an answer, held against its contexts; sums and amounts that it states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingloom.functions.text import question_type

#: Numbers of a claim (with or without units), times, and comparing words.
NUMBERS = ["\\$[\\d,]+(?:\\.\\d+)?(?:\\s*(?:million|billion|thousand))?", "\\d+(?:\\.\\d+)?%", "\\d+(?:,\\d{3})+(?:\\.\\d+)?", "\\d+(?:\\.\\d+)?\\s*(?:million|billion|thousand)"]
CONTEXT_NUMBER = "\\$?[\\d,]+(?:\\.\\d+)?(?:\\s*(?:million|billion|thousand))?"
TIMES = "(?:q[1-4]|first|second|third|fourth)\\s*(?:quarter|qtr)|20\\d{2}|(?:fiscal|calendar)\\s*year"
CLAIM_WORDS = ["increased", "decreased", "grew", "declined", "rose", "fell", "higher", "lower", "more", "less", "up", "down"]
COMPARED = ["increased", "decreased", "grew", "declined", "rose", "fell", "higher", "lower", "growth", "decline"]
RISING = ["increased", "grew", "rose", "higher", "growth", "up"]
FALLING = ["decreased", "declined", "fell", "lower", "decline", "down"]
COMMON = ["this", "that", "with", "from", "have", "been", "were", "will", "would", "could", "should"]
#: Words that are no key terms of a question, and phrases of statements.
STOP = [
    "what", "was", "is", "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "how", "much", "many", "when", "where", "which", "who", "why",
    "can", "could", "would", "should", "tell", "me", "about", "give", "show", "find", "get", "did", "do", "does",
]
PHRASES = [
    "total revenue", "net income", "operating income", "gross profit", "total assets", "total liabilities", "shareholders equity", "cash flow", "earnings per share", "operating expenses",
]
#: How an answer to each type of question reads, its score if it does and if not.
ANSWERS = {
    "quantitative": ("\\d|\\$|million|billion", 1.0, 0.3),
    "explanatory": ("because|due to|since|therefore|as a result", 0.8, 0.5),
    "comparative": ("compared to|higher|lower|increased|decreased|versus|while", 0.9, 0.4),
    "enumerative": ("(?:\\d+\\.|[-•])\\s", 0.9, 0.5),
    "trend": ("increased|decreased|grew|declined|trend|growth|change", 0.8, 0.4),
}


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _any(text: Column, words: list[str]) -> Column:
    return F.greatest(F.lit(False), *[F.contains(text, F.lit(w)) for w in words])


def _every(text: Column, patterns: list[str]) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)) for p in patterns]))


def amount(text: Column) -> Column:
    """The number that a text with ``$``, commas and a unit word states; 0 if it states none."""
    low = F.lower(text)
    unit = F.when(low.contains("billion"), 1e9).when(low.contains("million"), 1e6).when(low.contains("thousand"), 1e3).otherwise(1.0)
    return F.coalesce(F.trim(F.regexp_replace(low, "[,$]|billion|million|thousand", "")).try_cast("double") * unit, F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "(?<=[.!?])\\s+"), lambda x: F.trim(x)), lambda s: s != "")


def claims(answer: Column) -> Column:
    """The claims of an answer, as (kind, text, value): each number, one time and one comparison a sentence; of sentences without, those of six words or more."""
    claim = lambda kind, s, v: F.struct(F.lit(kind).alias("kind"), s.alias("text"), v.cast("string").alias("value"))

    def of(s: Column) -> Column:
        numbers = F.transform(_every(s, NUMBERS), lambda v: claim("numeric", s, v))
        some = F.concat(
            numbers, F.when(F.lower(s).rlike(TIMES), F.array(claim("temporal", s, F.lit(None)))).otherwise(F.slice(numbers, 1, 0)),
            F.when(_any(F.lower(s), CLAIM_WORDS), F.array(claim("comparative", s, F.lit(None)))).otherwise(F.slice(numbers, 1, 0)),
        )
        long = F.size(F.filter(F.split(s, "\\s+"), lambda w: w != "")) > 5
        # Bound in a lambda, the claims found are evaluated once.
        return F.flatten(F.transform(F.array(some), lambda a: F.when((F.size(a) == 0) & long, F.array(claim("general", s, F.lit(None)))).otherwise(a)))

    return F.flatten(F.transform(sentences(answer), of))


def grounded(kind: Column, text: Column, value: Column, context: Column, tolerance: float = 0.05) -> Column:
    """Whether a context bears a claim: its number within the tolerance, its year or quarter, its comparing word or one alike, or half of its longer words."""
    low, there = F.lower(text), _low(context)
    v = amount(value)
    near = lambda x: (x == v) | ((x != 0) & (v != 0) & (F.abs(x - v) / F.greatest(x, v) <= tolerance))
    number = F.exists(F.regexp_extract_all(there, F.lit(CONTEXT_NUMBER), F.lit(0)), lambda c: near(amount(c)))
    year = F.regexp_extract(low, "20\\d{2}", 0)
    quarter = F.regexp_extract(low, "q[1-4]|(?:first|second|third|fourth)\\s*quarter", 0)
    time = ((year != "") & F.contains(there, year)) | ((quarter != "") & F.contains(there, quarter))
    word = F.coalesce(*[F.when(F.contains(low, F.lit(w)), w) for w in COMPARED])
    compared = F.contains(there, word) | (word.isin(RISING) & _any(there, RISING)) | (word.isin(FALLING) & _any(there, FALLING))
    words = F.array_except(F.array_distinct(F.regexp_extract_all(low, F.lit("\\b[a-z]{4,}\\b"), F.lit(0))), F.array(*map(F.lit, COMMON)))
    shared = F.size(F.filter(words, lambda w: F.contains(there, w)))
    found = F.when(kind == "numeric", number).when(kind == "temporal", time).when(kind == "comparative", compared).otherwise((F.size(words) == 0) | (shared / F.size(words) >= 0.5))
    return F.coalesce(found, F.lit(False))


def faithfulness(answer: Column, context: Column, most: float = 0.5) -> Column:
    """(claims, grounded, score, citations, hallucination): the share of claims that the context bears (0.5 without claims), that of numbers (1 without any),
    and whether more than ``most`` of all claims are borne by nothing."""
    every = F.transform(claims(answer), lambda c: F.struct(c["kind"].alias("kind"), grounded(c["kind"], c["text"], c["value"], context).alias("ok")))
    counts = lambda n, good, numbers, cited: F.struct(n.alias("n"), good.alias("good"), numbers.alias("numbers"), cited.alias("cited"))

    def add(a: Column, c: Column) -> Column:
        ok, number = c["ok"].cast("int"), (c["kind"] == "numeric").cast("int")
        return counts(a["n"] + 1, a["good"] + ok, a["numbers"] + number, a["cited"] + ok * number)

    def ratios(a: Column) -> Column:
        score = F.when(a["n"] == 0, 0.5).otherwise(a["good"] / a["n"])
        cited = F.when(a["numbers"] == 0, 1.0).otherwise(a["cited"] / a["numbers"])
        lost = (a["n"] > a["good"]) & (1 - score > most)
        return F.struct(a["n"].alias("claims"), a["good"].alias("grounded"), score.alias("score"), cited.alias("citations"), lost.alias("hallucination"))

    return F.aggregate(every, counts(*[F.lit(0)] * 4), add, ratios)


def wrong_sums(text: Column) -> Column:
    """How many of ``a + b = c``, ``a - b = c`` and ``p% of x is y`` don't hold (within 0.01, within 5%)."""
    number = "(\\$?[\\d,]+(?:\\.\\d+)?)"

    def wrong(sign: str, factor: int) -> Column:
        pattern = f"{number}\\s*{sign}\\s*{number}\\s*=\\s*{number}"
        part = lambda s, i: amount(F.regexp_extract(s, pattern, i))
        return F.size(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.abs(part(s, 1) + factor * part(s, 2) - part(s, 3)) > 0.01))

    share = "(?i)(\\d+(?:\\.\\d+)?)%\\s+of\\s+\\$?([\\d,]+(?:\\.\\d+)?)\\s+(?:is|equals?)\\s+\\$?([\\d,]+(?:\\.\\d+)?)"
    shares = F.regexp_extract_all(text, F.lit(share), F.lit(0))
    of = lambda s, i: amount(F.regexp_extract(s, share, i))
    off = lambda s: F.abs(of(s, 1) / 100 * of(s, 2) - of(s, 3)) / F.greatest(of(s, 1) / 100 * of(s, 2), F.lit(1.0)) > 0.05
    return F.coalesce(wrong("\\+", 1) + wrong("-", -1) + F.size(F.filter(shares, off)), F.lit(0))


def amount_faults(text: Column) -> Column:
    """The faults of the amounts of a text: ``decimals`` of several lengths that aren't two, ``no_symbol`` of a number in the millions."""
    places = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("\\$[\\d,]+\\.(\\d+)"), F.lit(1)), lambda x: F.length(x)))
    mixed = (F.size(places) > 1) & F.exists(places, lambda n: n.isin(1, 3, 4))
    bare = text.rlike("\\b(?<!\\$)\\d{1,3}(?:,\\d{3}){2,}(?:\\.\\d+)?\\b")
    return F.array_compact(F.array(F.when(mixed, "decimals"), F.when(bare, "no_symbol")))


def key_terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(_low(text), F.lit("\\b[a-z]{3,}\\b"), F.lit(0)), lambda w: ~w.isin(STOP))


def type_match(question: Column, answer: Column) -> Column:
    """How well an answer's form suits the question's type."""
    kind, out = question_type(question), F.lit(0.6)
    for name, (pattern, yes, no) in ANSWERS.items():
        out = F.when(kind == name, F.when(_low(answer).rlike(pattern), yes).otherwise(no)).otherwise(out)
    return out


def relevance(question: Column, answer: Column, semantic: Column | None = None) -> Column:
    """0.3 of the share of key terms found, 0.3 of the form's match, 0.4 of the semantic score (0.5 if none is given)."""
    terms, low = key_terms(question), _low(answer)
    found = F.when(F.size(terms) == 0, 0.5).otherwise(F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms))
    return F.least(0.3 * found + 0.3 * type_match(question, answer) + 0.4 * (F.lit(0.5) if semantic is None else semantic), F.lit(1.0))


def completeness(answer: Column, context: Column) -> Column:
    """Half the share of the context's numbers that the answer has (of five at most) and half that of its phrases, 1 at most; without a context the length's share of 200."""
    low, there = _low(answer), _low(context)
    numbers, mine = _every(there, NUMBERS), _every(low, NUMBERS)
    found = F.size(F.filter(numbers, lambda n: F.array_contains(mine, n)))
    share = F.when(F.size(numbers) == 0, 0.5).otherwise(found / F.least(F.size(numbers), F.lit(5)))
    phrases = F.slice(F.filter(F.array(*map(F.lit, PHRASES)), lambda p: F.contains(there, p)), 1, 5)
    kept = F.when(F.size(phrases) == 0, 0.5).otherwise(F.size(F.filter(phrases, lambda p: F.contains(low, p))) / F.size(phrases))
    return F.when(there == "", F.least(F.length(low) / 200, F.lit(1.0))).otherwise(F.least(0.5 * share + 0.5 * kept, F.lit(1.0)))
