"""Query and answer guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Personal data, in this order: social security number, card, e-mail, phone.
PII = ["\\b\\d{3}-\\d{2}-\\d{4}\\b", "\\b\\d{16}\\b", "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b", "\\b\\d{3}[-.]\\d{3}[-.]\\d{4}\\b"]
#: Phrases of prompt injection.
INJECTION = [
    "ignore\\s+(previous|all|above)\\s+instructions?",
    "disregard\\s+.*\\s+instructions?",
    "forget\\s+(everything|all|your)",
    "you\\s+are\\s+now\\s+a",
    "pretend\\s+you\\s+are",
    "act\\s+as\\s+(if|a)",
    "new\\s+instructions?:",
    "system\\s*:\\s*",
    "</?(system|user|assistant)>",
    "\\[INST\\]|\\[/INST\\]",
    "<\\|im_start\\|>|<\\|im_end\\|>",
]
#: Query kinds and their words, first fit wins.
KINDS = [("comparison", "compare|versus| vs "), ("trend", "trend|over time|growth"), ("aggregation", "total|average|sum of"), ("hierarchical", "breakdown|under |within ")]


def redact(text: Column) -> Column:
    for p in PII:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def injected(text: Column) -> Column:
    """Whether any phrase of INJECTION stands in the text, in any case."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in INJECTION))


def query_kind(text: Column) -> Column:
    out = F.lit("specific_value")
    for name, words in reversed(KINDS):
        out = F.when(F.lower(text).rlike(words), name).otherwise(out)
    return out
