"""Text functions on stated texts; ``{k}`` stands for a number, so that no text is a literal of the function's own."""

import pytest
from pyspark.sql import functions as F

from filingloom.functions import asks, claims, headers, period, rows, titles
from filingloom.operators import scores

CASES = []


def cases(columns, table):
    def add(f):
        CASES.extend(pytest.param(f, columns, given, wanted, id=f"{f.__name__}-{i}") for i, (given, wanted) in enumerate(table))
        return f

    return add


def _filled(v):
    return [_filled(x) for x in v] if isinstance(v, list) else v.replace("{k}", "7") if isinstance(v, str) else v


def _col(v):
    return F.array(*map(_col, v)) if isinstance(v, list) else F.lit(v)


@cases(["title", "suffix", "code"], [
    (("Loans {k} at March 31, 2025",), ("Loans {k}", " at March 31, 2025", "Q1-2025")),
    (("Cash {k} for the Three Months Ended June 30, 2024",), ("Cash {k}", " for the Three Months Ended June 30, 2024", "Q2-QTD-2024")),
    (("Flows {k} nine months ended September 30 2023 (Part 2)",), ("Flows {k}", " nine months ended September 30 2023 (Part 2)", "Q3-YTD-2023")),
    (("Pay {k} for the Year Ended December 31, 2024",), ("Pay {k}", " for the Year Ended December 31, 2024", "YTD-2024")),
    (("Rating {k} as of December 31, 2024_Agency {k}, Inc.",), ("Rating {k}_Agency {k}, Inc.", " as of December 31, 2024", "Q4-2024")),
    ((" Segment {k} results ",), ("Segment {k} results", "", "")),
])
def title_dates(title):
    parts = titles.date_suffix(title)
    return parts["title"], parts["suffix"], parts["code"]


@cases(["grouped"], [
    (("{k}. Risk Manageme nt at March 31, 2025",), ("risk management",)),
    (("Note 12. - Loans {k}  (Part 2) (Rows 1-10)",), ("loans {k}",)),
    (("Deposits {k}_$ in millions",), ("deposits {k}",)),
    (("Table 4: Capital {k} ($ in billions)",), ("capital {k}",)),
    (("12: ",), ("untitled",)),
    (("",), ("",)),
])
def title_groups(title):
    return (titles.grouping_title(title),)


@cases(["key", "date", "cleaned", "cased"], [
    (("three months ended jun {k},",), ("Three Months Ended June {k}", "jun {k},", "three months ended jun {k},", "Three Months Ended Jun {k},")),
    (("At Dec 31, 2024",), ("At December 31, 2024", "Dec 31, 2024", "At Dec 31,", "At Dec 31, 2024")),
    (("2024.0",), ("2024", "2024.0", "2024.0", "2024.0")),
    (("Level Level 2",), ("Level Level 2", "Level Level 2", "Level 2", "Level Level 2")),
    (("net return of the roe to uk {k}x",), ("Net Return Of The Roe To Uk {k}X", "net return of the roe to uk {k}x", "net return of the roe to uk {k}x", "Net Return of the ROE to UK {k}x")),
    (("Year Ended ",), ("Year Ended", "Year Ended ", "Year Ended", "Year Ended")),
])
def header_texts(header):
    return titles.header_key(header), titles.date_of_header(header), titles.clean_header(header), titles.title_case(header)


@cases(["l1", "l2"], [
    (("Average Balance {k} three months ended March 31,",), ("Average Balance {k}", "Three months ended March 31,")),
    (("Assets {k} As of June 30",), ("Assets {k}", "As of June 30")),
    (("Year Ended {k}",), ("", "Year Ended {k}")),
    (("Fee {k} fiscal year ended 2024",), ("Fee {k} fiscal", "Year ended 2024")),
    ((None,), ("", "")),
])
def compound_headers(header):
    parts = titles.compound_header(header)
    return parts["l1"], parts["l2"]


@cases(["from_name", "from_cells", "section", "title", "source"], [
    (("51_table_{k}", ["2024 net revenues", "Net revenues {k} by type"]), ("Table {k}", "Net revenues {k} by type", "[MISSING]", "[AUTO] Table from 51_table_{k}", "[AUTO] Sheet 51_table_{k}")),
    (("2_business_segment's", ["short", None, "12 months and more"]), ("Business Segment'S", "", "[MISSING]", "[AUTO] Table from 2_business_segment's", "[AUTO] Sheet 2_business_segment's")),
    (("9_table", ["a", "b", "c", "Beyond the third cell"]), ("", "", "[MISSING]", "[AUTO] Table from 9_table", "[AUTO] Sheet 9_table")),
    (("", []), ("", "", "[MISSING]", "[AUTO] Table 7", "[AUTO] Unknown")),
])
def table_fallbacks(name, cells):
    own = titles.placeholder(name, F.lit(7))
    return titles.title_of_sheet(name), titles.title_of_cells(cells.cast("array<string>")), own["section"], own["title"], own["source"]


@cases(["valid"], [
    (("Q2-QTD-2024",), (True,)), (("1-3",), (True,)), (("12.5",), (True,)), (("1,212,447",), (False,)), (("4521.75",), (False,)),
    (("Loans {k}",), (True,)), (("",), (False,)), ((" ",), (True,)), ((None,), (False,)), (("2,024",), (True,)),
])
def header_validity(header):
    return (rows.valid_header(header),)


@cases(["embedded", "fresh", "voted", "spanning"], [
    ((["Three Months Ended June", "", ""],), (True, False, False, True)),
    ((["", "2024", "2023"],), (True, False, True, False)),
    ((["$ in millions", "At March 31, 2025", "At June 30, 2025"],), (True, True, True, False)),
    ((["Loans {k}", "1,200", "3,400"],), (False, False, False, False)),
    ((["Table Title: x {k}", "", "", ""],), (True, False, False, True)),
    ((["", "Q1-QTD-2024", "nan"],), (False, True, True, False)),
    ((["5,000", "a"],), (False, False, False, False)),
    ((["Loans {k}", "as of May", "", "", "6"],), (False, False, True, False)),
])
def row_kinds(cells):
    return rows.embedded_header(cells), rows.new_table(cells), rows.voted_header(cells), rows.spanning(cells)


@cases(["kind", "unit", "exceptions", "by_column", "by_row"], [
    (("$ in millions, except per share data",), ("currency", "millions", True, "default", "currency")),
    (("Dollars in billions {k}",), ("currency", "billions", False, "default", "currency")),
    (("% change {k}",), ("number", None, False, "percentage", "currency")),
    (("ROTCE",), ("number", None, False, "default", "percentage")),
    (("Margin and other lending {k}",), ("number", None, False, "default", "currency")),
    (("Net margin {k}",), ("number", None, False, "default", "percentage")),
    (("Interest rate change {k}",), ("number", None, False, "percentage", "percentage")),
])
def value_formats(text):
    form = rows.table_format(text)
    return form["type"], form["unit"], form["exceptions"], rows.column_format(text), rows.row_format(text)


@cases(["text", "value", "format"], [
    (("Manageme nt fees {k} (1)", True), ("Management fees {k}", None, None)),
    (("15.5%", False), ("15.5%", 0.155, "percent")),
    (("$1,234", False), ("$1,234", 1234.0, "currency")),
    (("(248)", False), ("(248)", -248.0, "negative")),
    (("n/a", False), ("n/a", None, None)),
    (("text {k}", False), ("text {k}", None, None)),
])
def cell_values(cell, first):
    one = rows.cell_value(cell, first)
    return one["text"], one["value"], one["format"]


@cases(["cells", "single"], [
    ((["Loans {k}", "$10,207 $ 2,762", "$ 10"],), ("Loans {k}|$10,207|$2,762|$10", "Loans {k}|$10,207 $ 2,762|$ 10")),
    ((["Loans 5 7", "12,", "At June 30 2024"],), ("Loans|5|7|At June 30 2024", "Loans 5 7|12,|At June 30 2024")),
    ((["March 31, 2024 $5 $6", "March 31, 2024 $5 $6", "x"],), ("March 31, 2024 $5 $6|March 31, 2024 $5 $6|x", "March 31, 2024 $5 $6||x")),
    ((["1,000", "1,000", "$5"],), ("1,000|1,000|$5", "1,000|1,000|$5")),
    ((["Net fees Net fees", "4 $"],), ("Net fees Net fees|4", "Net fees||4 $")),
])
def repaired_rows(cells):
    return F.array_join(rows.repair_cells(cells), "|"), F.array_join(rows.repeated_label(cells), "|")


@cases(["year", "quarter", "statement", "topic", "operations"], [
    (("Compare revenue and income of Q2 2024",), (2024, "Q2", None, "financial", "compare")),
    (("net income in the first quarter of 2023, balance  sheet",), (2023, "Q1", "Balance Sheet", "financial", "")),
    (("tell me a joke {k}",), (None, None, None, "off_topic", "")),
    (("the statement of operations over time",), (None, None, "Income Statement", "general", "trend")),
    (("save the total of all {k}",), (None, None, None, "general", "sum,all,export")),
    ((None,), (None, None, None, "general", "")),
])
def question_filters(q):
    got = asks.filters(q)
    return got["year"], got["quarter"], got["statement"], asks.topic(q), F.array_join(F.coalesce(asks.operations(q), F.array().cast("array<string>")), ",")


@cases(["intent", "confidence"], [
    (("show {k}", "Fair Value", 2024, "Q1", ["income"]), ("table_lookup", 1.0)),
    (("a versus b {k}", None, 2024, None, []), ("comparative", 0.45)),
    (("numbers of {k}", None, None, "Q1", []), ("temporal_query", 0.4)),
    (("numbers of {k}", None, None, None, ["eps"]), ("financial_metric", 0.45)),
    (("numbers of {k}", None, None, None, []), ("general", 0.3)),
])
def question_intents(q, table, year, quarter, metrics):
    return asks.intent(q, table, year, quarter, metrics), F.round(asks.confidence(table, year, quarter, metrics), 6)


@cases(["clean", "flag", "severity"], [
    ((" a  <b>level 2</b>\t{k} ",), ("a level 2 {k}", 1, "Level 2")),
    (("Extreme {k}",), ("Extreme {k}", 1, "Extreme")),
    (("not an anomaly {k}",), ("not an anomaly {k}", 0, "Not Anomaly")),
    (("Anomaly {k}",), ("Anomaly {k}", 1, "Other")),
    ((None,), (None, 0, "Not Anomaly")),
    (("Level 3",), ("Level 3", 1, "Extreme")),
])
def anomaly_texts(text):
    got = asks.anomaly(text)
    return asks.sanitise(text), got["flag"], got["severity"]


@cases(["claims", "grounded", "score", "citations", "hallucination"], [
    (("Revenue rose to $5 million. It was 12%.", "revenue grew by 5,100,000 and 12 points"), (4, 3, 0.75, 0.666667, False)),
    (("Revenue was $7 million in Q1 2024.", "nothing of that kind"), (3, 0, 0.0, 0.0, True)),
    (("Yes {k}.", "no"), (0, 0, 0.5, 1.0, False)),
    (("The company operates several large segments worldwide today.", "company segments operates large things"), (1, 1, 1.0, 1.0, False)),
    (("Costs fell in 2023.", "costs were lower in 2023"), (2, 2, 1.0, 1.0, False)),
])
def answer_claims(answer, context):
    got = claims.faithfulness(answer, context)
    return got["claims"], got["grounded"], F.round(got["score"], 6), F.round(got["citations"], 6), got["hallucination"]


@cases(["wrong", "faults"], [
    (("$5 + $6 = $11 and 10 - 4 = 6",), (0, "")),
    (("5 + 6 = 12, 10 - 4 = 7, 10% of $200 is $20",), (2, "")),
    (("50% of 1,000 equals 400; $1.5 and $2.25 of 12,345,678",), (1, "decimals,no_symbol")),
    (("$12,345,678 {k}",), (0, "")),
])
def stated_sums(text):
    return claims.wrong_sums(text), F.array_join(claims.amount_faults(text), ",")


@cases(["relevance", "completeness", "match"], [
    (("What was the revenue", "Revenue was $5 million", "Total revenue $5 million"), (0.8, 0.5, 1.0)),
    (("Explain the margin", "It grew because of fees", "net income 12% 15%"), (0.44, 0.0, 0.8)),
    (("Hello there", "Hello", ""), (0.53, 0.025, 0.6)),
])
def answer_quality(question, answer, context):
    return F.round(claims.relevance(question, answer), 6), F.round(claims.completeness(answer, context), 6), claims.type_match(question, answer)


@cases(["numbers", "header", "content", "text"], [
    (([["Item", "2024"], ["Loans {k}", "$1,200"], ["Fees", "12.5%"]], "a 5"), (1.0, 0.9, 1.0, 15)),
    (([["", "x", "Name"], ["Loans", "1a2", "(3,000)"]], "?????"), (0.5, 0.8, 1.0, 5)),
    (([["Name"]], "words"), (0.0, 1.0, 0.0, 10)),
    (([["Ab", "Cd"], ["###@@@", "7"]], ""), (1.0, 1.0, 0.75, 0)),
])
def table_quality(cells, content):
    return F.round(scores.numeric_accuracy(cells), 6), F.round(scores.header_score(cells[0]), 6), F.round(scores.content_score(cells), 6), scores.text_quality(content)


@cases(["relation", "window"], [
    ((2024, 2, 2024, 2, "Q1", "2025-05-05"), ("same", True)),
    ((2024, 2, 2024, 3, "Q1", "2025-05-16"), ("sequential", False)),
    ((2023, 4, 2024, 1, "10K", "2025-02-28"), ("sequential", True)),
    ((2023, 4, 2024, 4, "Q2", "2025-05-10"), ("yoy", False)),
    ((2022, 1, 2024, 1, "Q9", "2025-05-10"), ("different", False)),
    ((2023, None, 2024, None, "Q3", "2025-11-15"), ("yoy", True)),
])
def period_relations(y, q, y2, q2, quarter, day):
    return period.relation(y, q, y2, q2), period.in_filing_window(quarter, F.to_date(day))


@cases(["crossed", "dated"], [
    ((["Average {k}"], ["Q4-QTD-2024", "Q3-QTD-2024"], ["Three Months Ended"], ["December 31, 2024", "June 30, 2024"]), ("Average {k} Q4-QTD-2024|Average {k} Q3-QTD-2024", "Q4-QTD-2024|Q2-QTD-2024")),
    ((["At June"], ["Q4-2024"], ["Six Months Ended June 30, 2024"], []), ("Q4-2024", "Q2-YTD-2024")),
    ((["Fees"], ["YTD-2024", "Total", "Total"], ["Amount {k}"], ["2024"]), ("Fees YTD-2024|Total", "Amount {k}")),
])
def crossed_headers(labels, codes, spans, dates):
    return F.array_join(headers.with_periods(labels, codes), "|"), F.array_join(headers.with_dates(spans, dates.cast("array<string>")), "|")


@pytest.mark.parametrize(("f", "columns", "given", "wanted"), CASES)
def test_stated(spark, f, columns, given, wanted):
    # Arguments are columns of a row that is read back, so that nothing is folded when the query is planned.
    row = spark.range(1).select(*[_col(_filled(v)).alias(f"a{i}") for i, v in enumerate(given)])
    out = f(*[F.col(f"a{i}") for i in range(len(given))])
    got = row.select(*[c.alias(n) for c, n in zip(out, columns, strict=True)]).first()
    assert [tuple(got)] == [tuple(_filled(v) for v in wanted)]
