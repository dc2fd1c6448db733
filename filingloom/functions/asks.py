"""What a question asks for: filters, topic, intent, kind; what an anomaly's text says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quarters and statements by their phrases, first fit wins.
QUARTERS = [(f"\\bq{i}\\b", f"Q{i}") for i in (1, 2, 3, 4)] + [(f"\\b{w}\\s+quarter\\b", f"Q{i}") for i, w in enumerate(["first", "second", "third", "fourth"], 1)]
STATEMENTS = [("balance\\s+sheet", "Balance Sheet"), ("income\\s+statement", "Income Statement"), ("cash\\s+flow", "Cash Flow Statement"), ("statement\\s+of\\s+operations", "Income Statement")]
#: Words of a financial question, and patterns of one on other things.
FINANCIAL = [
    "revenue", "income", "profit", "loss", "earnings", "eps", "assets", "liabilities", "equity", "debt", "cash", "balance sheet", "income statement", "cash flow",
    "quarter", "q1", "q2", "q3", "q4", "annual", "fiscal", "margin", "growth", "ratio", "return", "yield", "dividend", "stock", "share", "market", "cap",
    "financial", "report", "filing", "sec", "10-k", "10-q",
]
OFF_TOPIC = [
    "write\\s+(me\\s+)?(a\\s+)?(poem|story|song|code|script)", "tell\\s+me\\s+a\\s+joke", "what\\s+is\\s+the\\s+(meaning|purpose)\\s+of\\s+life",
    "(play|sing|dance|draw)", "(recipe|cook|bake)", "(weather|news|sports)\\s+(today|now|in)",
]
#: Operations and table types that a question names.
OPERATIONS = [
    ("compare", ["compare", "comparison", "versus", "vs", "compared to"]), ("trend", ["trend", "progression", "over time", "historical"]), ("average", ["average", "mean", "avg"]),
    ("sum", ["sum", "total", "aggregate"]), ("growth", ["growth", "increase", "change"]), ("all", ["all", "every", "each"]),
    ("consolidate", ["consolidate", "consolidated", "consolidation", "merge", "combine"]), ("export", ["save", "export", "download", "output", "file"]),
    ("transpose", ["transpose", "transposed", "flip", "rotate"]),
]
#: Fixed value: words of a comparison.
COMPARING = "compare|vs\\.?|versus|between|difference"


def _first(low: Column, classes: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(low.rlike(p), value) for p, value in classes])


def filters(query: Column) -> Column:
    """(year, quarter, statement) that a question names; null where it names none."""
    low = F.lower(query)
    year = F.regexp_extract(query, "\\b(20\\d{2})\\b", 1)
    return F.struct(year.try_cast("int").alias("year"), _first(low, QUARTERS).alias("quarter"), _first(low, STATEMENTS).alias("statement"))


def sanitise(query: Column) -> Column:
    """White space single, tags and unprintable characters gone."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(query), "\\s+", " "), "<[^>]+>", ""), "\\p{C}", "")


def topic(query: Column) -> Column:
    """off_topic, financial (two words of FINANCIAL at least) or general."""
    low = F.lower(F.coalesce(query, F.lit("")))
    words = sum((low.contains(w).cast("int") for w in FINANCIAL), F.lit(0))
    return F.when(low.rlike("|".join(OFF_TOPIC)), "off_topic").when(words >= 2, "financial").otherwise("general")


def intent(query: Column, table: Column, year: Column, quarter: Column, metrics: Column) -> Column:
    """What is asked for: a table, a comparison, a time, a metric, or anything; ``metrics`` is an array."""
    return (
        F.when(table.isNotNull(), "table_lookup").when(F.lower(query).rlike(COMPARING), "comparative").when(year.isNotNull() | quarter.isNotNull(), "temporal_query")
        .when(F.size(metrics) > 0, "financial_metric").otherwise("general")
    )


def confidence(table: Column, year: Column, quarter: Column, metrics: Column) -> Column:
    part = lambda there, weight: F.when(there, weight).otherwise(0.0)
    return F.least(F.lit(1.0), 0.3 + part(table.isNotNull(), 0.3) + part(year.isNotNull(), 0.15) + part(quarter.isNotNull(), 0.1) + part(F.size(metrics) > 0, 0.15))


def operations(query: Column) -> Column:
    """The operations that a question names, in the order of OPERATIONS."""
    low = F.lower(query)
    hits = [F.when(F.greatest(F.lit(False), *[low.contains(w) for w in words]), name) for name, words in OPERATIONS]
    return F.array_compact(F.array(*hits))


def anomaly(text: Column) -> Column:
    """(flag, severity) of an anomaly's description."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    severity = (
        F.when(low.contains("not") & low.contains("anomaly"), None).when(low.contains("extreme") | low.contains("level 3"), "Extreme")
        .when(low.contains("level 2"), "Level 2").when(low.contains("level") | low.contains("anomaly"), "Other")
    )
    return F.struct(severity.isNotNull().cast("int").alias("flag"), F.coalesce(severity, F.lit("Not Anomaly")).alias("severity"))


def stale_years(answer: Column, contexts: Column) -> Column:
    """The years (2000 to 2099) that an answer names and none of its contexts, in order."""
    years = lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit("\\b(20\\d{2})\\b"), F.lit(1))
    return F.array_sort(F.array_except(years(answer), F.flatten(F.transform(contexts, years))))
