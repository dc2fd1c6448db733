"""Queries over texts, scores and aligned tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from filingloom.functions import headers, text
from filingloom.operators import align, scores
from filingloom.plans.registry import _t, query

_SOURCE = "CASE o_orderkey % 3 WHEN 0 THEN '10k' WHEN 1 THEN '10Q' ELSE 'x8-k' END || strftime(o_orderdate, '%m%y') || '.pdf'"


def _sources(spark, d):
    kind = F.element_at(F.array(F.lit("10k"), F.lit("10Q"), F.lit("x8-k")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return _t(spark, d, "orders").withColumn("source", F.concat(kind, F.date_format("o_orderdate", "MMyy"), F.lit(".pdf")))


@query(f"""SELECT o_orderkey, {_SOURCE} AS source,
CASE o_orderkey % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS kind,
CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE (2000 + year(o_orderdate) % 100 - CASE WHEN o_orderkey % 3 = 1 AND month(o_orderdate) < 3 THEN 1 ELSE 0 END)::VARCHAR END AS year,
CASE WHEN o_orderkey % 3 = 2 THEN '' WHEN o_orderkey % 3 = 0 OR month(o_orderdate) < 3 THEN 'Q4' ELSE 'Q' || quarter(o_orderdate) END AS quarter FROM orders""")
def source_periods(spark, d):
    s = _sources(spark, d).withColumn("p", headers.source_period(F.col("source")))
    return s.select("o_orderkey", "source", headers.report_type(F.col("source")).alias("kind"), "p.year", "p.quarter")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'YTD-2024' WHEN 1 THEN 'Q' || quarter(o_orderdate) || '-2024' ELSE '2024' END AS code
FROM orders WHERE month(o_orderdate) % 3 = 0 UNION ALL SELECT -o_orderkey, '1999' FROM orders""")
def year_codes(spark, d):
    names = F.concat(F.element_at(F.array(F.lit("10k24"), F.lit("10q"), F.lit("8k")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.date_format("o_orderdate", "MM"))
    o = _t(spark, d, "orders")
    some = o.where(F.month("o_orderdate") % 3 == 0).select("o_orderkey", headers.year_to_period(F.lit(" 2024 "), names).alias("code"))
    return some.unionByName(o.select((-F.col("o_orderkey")).alias("o_orderkey"), headers.year_to_period(F.lit("1999"), F.lit("10k1224")).alias("code")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN false ELSE l_linenumber != 2 END AS number, l_linenumber = 2 AND l_quantity <= 35 AS year FROM lineitem")
def cell_kinds(spark, d):
    q = F.col("l_quantity").cast("int")
    cell = (
        F.when(F.col("l_linenumber") == 1, F.concat(q.cast("string"), F.lit(" in millions"))).when(F.col("l_linenumber") == 2, F.concat(F.lit("20"), F.lpad(q.cast("string"), 2, "0")))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("-1,"), q.cast("string"), F.lit(".5%"))).otherwise(q.cast("string"))
    )
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", headers.is_number(cell).alias("number"), headers.is_year(cell).alias("year"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Six Months Ended ' || t WHEN 1 THEN 'year ended ' || t WHEN 2 THEN 'At ' || t END AS period
FROM (SELECT *, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS t FROM orders)""")
def fiscal_periods(spark, d):
    head = F.element_at(F.array(F.lit("Six Months Ended "), F.lit("year ended "), F.lit("At "), F.lit("on ")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    body = F.concat(F.lit("Table: "), head, F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" unaudited"))
    return _t(spark, d, "orders").select("o_orderkey", headers.fiscal_period(body).alias("period"))


@query("""SELECT o_custkey, bool_or(a) AND bool_or(b) AS mixed FROM (SELECT o_custkey, o_orderstatus = 'F' AS a, o_orderstatus = 'O' AS b FROM orders) GROUP BY o_custkey""")
def mixed_periods(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "quarter").when(F.col("o_orderstatus") == "O", "year").otherwise("other")
    return _t(spark, d, "orders").groupBy("o_custkey").agg(headers.mixed(F.collect_set(kind)).alias("mixed"))


@query("""SELECT p_partkey, p_name AS clean, CASE WHEN p_size > 40 THEN '1,2' WHEN p_size > 20 THEN '3' ELSE '' END AS refs,
p_name AS once, CASE WHEN length(p_name) >= 5 THEN p_name ELSE p_name || ' ' || p_name END AS half FROM part""")
def label_marks(spark, d):
    name, size = F.col("p_name"), F.col("p_size")
    marked = F.concat(name, F.when(size > 40, " (1)(2) (1)").when(size > 20, "³").otherwise(""))
    notes = text.footnotes(marked)
    doubled = F.array_join(F.flatten(F.transform(F.split(name, " "), lambda w: F.array(w, F.upper(w)))), " ")
    return _t(spark, d, "part").select("p_partkey", notes["clean"].alias("clean"), F.array_join(notes["refs"], ",").alias("refs"), text.dedupe_words(doubled).alias("once"), text.halve(F.concat(name, F.lit(" "), name)).alias("half"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' WHEN 2 THEN 'cash_flow' WHEN 3 THEN 'balance_sheet' WHEN 4 THEN 'notes' ELSE 'other' END AS kind,
CASE p_size % 6 WHEN 0 THEN 'quantitative' WHEN 1 THEN 'explanatory' WHEN 2 THEN 'comparative' WHEN 3 THEN 'enumerative' WHEN 4 THEN 'trend' ELSE 'general' END AS question,
CASE p_size % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'USD' END AS currency, p_size % 3 != 2 AS found FROM part""")
def text_classes(spark, d):
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_size") % len(words) + 1).cast("int"))
    title = pick("Total Assets", "Statement of Operations", "Cash Flow", "Changes in Equity", "Footnote 3", "Ports")
    asked = pick("How much is it", "Explain it", "compare them", "show all of it", "growth of it", "hello")
    money = text.currency_of(pick("5 €", "gbp 5", "five"))
    return _t(spark, d, "part").select("p_partkey", text.table_type(title).alias("kind"), text.question_type(asked).alias("question"), money["code"].alias("currency"), money["found"].alias("found"))


@query("""SELECT o_orderkey, CASE WHEN length(n) > 31 THEN left(n, 28) || '...' ELSE n END AS sheet, 'due $' || format('{:,}', o_orderkey * 1000 + 7) || ' now' AS amount,
md5('total of ' || o_orderkey || '|{}|5') AS key FROM (SELECT *, replace(o_orderpriority || ' ' || o_clerk || ' ' || o_orderstatus || ' order', '/', '') AS n FROM (SELECT *, 'Clerk ' || o_custkey AS o_clerk FROM orders))""")
def names_and_keys(spark, d):
    o = _t(spark, d, "orders")
    name = F.concat_ws(" ", F.concat(F.lit("[/*"), F.col("o_orderpriority")), F.concat(F.lit("Clerk "), F.col("o_custkey")), F.col("o_orderstatus"), F.lit("order?"))
    amount = F.concat(F.lit("due $"), (F.col("o_orderkey") * 1000 + 7).cast("string"), F.lit(" now"))
    return o.select("o_orderkey", text.sheet_name(name).alias("sheet"), text.comma_amounts(amount).alias("amount"), text.cache_key(F.concat(F.lit("  Total of "), F.col("o_orderkey")), F.lit("{}"), F.lit(5)).alias("key"))


@query("""SELECT n, CASE WHEN n > 702 THEN chr(CAST(64 + (n - 703) // 676 % 26 + 1 AS INT)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 1) // 26 - 1) % 26 AS INT)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INT)) AS letters
FROM (SELECT o_orderkey AS n FROM orders WHERE o_orderkey BETWEEN 1 AND 18278)""")
def column_names(spark, d):
    n = F.col("o_orderkey").alias("n")
    return _t(spark, d, "orders").where("o_orderkey BETWEEN 1 AND 18278").select(n, text.column_letters(F.col("o_orderkey")).alias("letters"))


@query("""WITH l AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey),
f AS (SELECT o_custkey, string_agg(p, ',' ORDER BY k) AS once FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_custkey)
SELECT o_custkey, once, array_to_string(items[1:3], ', ') || CASE WHEN len(items) > 3 THEN ' (+' || (len(items) - 3) || ' more)' ELSE '' END AS shown FROM l JOIN f USING (o_custkey)""")
def listed_items(spark, d):
    items = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    lists = _t(spark, d, "orders").groupBy("o_custkey").agg(items.alias("items"))
    twice = F.concat("items", F.transform("items", lambda x: F.concat(F.lit(" "), F.lower(x))))
    return lists.select("o_custkey", F.array_join(text.distinct_in_order(twice), ",").alias("once"), text.shown(F.col("items"), 3).alias("shown"))


@query("SELECT s_suppkey, s_name AS a, 'x|%7C' AS b FROM supplier")
def grouping_keys(spark, d):
    parts = text.split_key(text.combine_key(F.col("s_name"), F.lit("x|%7C")))
    return _t(spark, d, "supplier").select("s_suppkey", F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.lit(1)).alias("b"))


@query("""WITH w AS (SELECT o_custkey, count(*) AS n, list(o_orderkey % 3 + length(o_orderpriority)) AS widths FROM orders GROUP BY o_custkey),
m AS (SELECT o_custkey, max(c) AS top, count(*) AS kinds FROM (SELECT o_custkey, o_orderkey % 3 + length(o_orderpriority) AS x, count(*) AS c FROM orders GROUP BY ALL) GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n <= 2 THEN 10 WHEN n <= 5 THEN 15 ELSE 20 END AS count_score, round(top / n, 6) AS consistency, 15 + CASE WHEN kinds <= 2 THEN 10 ELSE 0 END AS width_score,
round(1e0 - CASE WHEN n < 2 THEN 3e-1 ELSE 0 END - CASE WHEN o_custkey % 2 = 0 THEN 2e-1 ELSE 0 END, 6) AS structure FROM w JOIN m USING (o_custkey)""")
def table_scores(spark, d):
    width = F.col("o_orderkey") % 3 + F.length("o_orderpriority")
    t = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_list(width).alias("widths"))
    return t.select(
        "o_custkey", scores.table_count(F.col("n")).alias("count_score"), F.round(scores.column_consistency(F.col("widths")), 6).alias("consistency"),
        scores.width_consistency(F.lit(True), F.col("widths")).alias("width_score"), F.round(scores.structure(F.col("n"), F.lit(4), F.col("o_custkey") % 2 == 1), 6).alias("structure"),
    )


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda v: v != '')) AS words FROM t)
SELECT doc_id, round(CASE WHEN length(x) < 20 THEN length(x) / 20 WHEN length(x) > 2000 THEN 1 - least((length(x) - 2000) / 2000, 0.5) ELSE 1 END, 6) AS conciseness,
round(len(list_intersect(words, ['the', 'and', 'licensed', 'stupid'])) / 4, 6) AS overlap,
round((contains(lower(x), 'the')::INT + contains(lower(x), 'license')::INT) / 2, 6) AS coverage FROM w""")
def answer_scores(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select(
        "doc_id", F.round(scores.conciseness(t), 6).alias("conciseness"), F.round(scores.keyword_overlap(F.lit("The and  licensed stupid AND"), t), 6).alias("overlap"),
        F.round(scores.term_coverage(F.array(F.lit("The"), F.lit("LICENSE")), t), 6).alias("coverage"),
    )


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, (event_id % 11) / 10 AS v FROM events),
g AS (SELECT user_id, avg(v) AS mean, count(*) FILTER (v >= 0.7) AS high, sum(v / r) / sum(1 / r) AS weighed FROM s GROUP BY user_id)
SELECT user_id, round(least(mean + least(high * 0.1, 0.3), 1), 6) AS recall, round(least(0.7 * weighed + 0.15, 1), 6) AS relevance FROM g""")
def retrieval_scores(spark, d):
    s = F.transform(F.array_sort(F.collect_list("event_id")), lambda e: (e % 11) / 10)
    lists = _t(spark, d, "events").groupBy("user_id").agg(s.alias("s"))
    return lists.select("user_id", F.round(scores.estimated_recall(F.col("s")), 6).alias("recall"), F.round(scores.context_relevance(F.col("s"), F.lit(0.5)), 6).alias("relevance"))


@query("SELECT conv_id, turn FROM (SELECT *, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, role) AS upto FROM conversations) WHERE upto <= 400")
def context_budget(spark, d):
    return scores.within_budget(_t(spark, d, "conversations"), ["conv_id"], ["turn", "role"], "text", 400).select("conv_id", "turn")


@query("""SELECT event_id, CAST(event_id % 40 + 10 AS DOUBLE) AS amber, CAST(greatest(event_id % 40 + 50, 100) AS DOUBLE) AS red, round(value / (1 - 0.2), 6) AS upper, round(value / 1.2, 6) AS lower, round(value * CASE event_id % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 ELSE 1 END, 6) AS base FROM events""")
def chart_bands(spark, d):
    e, v = F.col("event_id"), F.col("value")
    limit, band = scores.thresholds((e % 40).cast("double")), scores.bands(v, F.lit(20.0))
    unit = F.element_at(F.array(F.lit("Millions"), F.lit(" thousand "), F.lit("each")), (e % 3 + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", F.round(limit["amber"], 6).alias("amber"), limit["red"].alias("red"), F.round(band["upper"], 6).alias("upper"), F.round(band["lower"], 6).alias("lower"), F.round(scores.to_base(v, unit), 6).alias("base"))


def _order_labels(spark, d, status):
    rows = _t(spark, d, "orders").where(F.col("o_orderstatus") == status)
    return rows.select(F.col("o_custkey").alias("t"), F.col("o_orderkey").alias("at"), F.concat(F.lit("Total "), F.col("o_orderpriority")).alias("label"))


@query("""SELECT a.o_custkey AS t, a.o_orderkey AS source_at, max(b.o_orderkey) AS target_at FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority
WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' GROUP BY ALL""")
def aligned_rows(spark, d):
    return align.align_rows(_order_labels(spark, d, "F"), _order_labels(spark, d, "O"), ["t"], "at", "label")


@query("SELECT o_custkey AS t, min(o_orderkey) AS at, 'Total ' || o_orderpriority AS label FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderpriority")
def unique_labels(spark, d):
    return align.all_labels(_order_labels(spark, d, "F"), ["t"], "at", "label")


_LINES = "SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity, max(l_tax) AS l_tax, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _lines(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"), F.max("l_tax").alias("l_tax"), F.min("l_linestatus").alias("l_linestatus"), F.min("l_returnflag").alias("l_returnflag"))


@query(f"""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber <= 2 THEN l_tax END AS l_tax FROM ({_LINES})""")
def tables_beside(spark, d):
    line = _lines(spark, d)
    right = line.where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", "l_tax", (F.col("l_quantity") + 1).alias("l_quantity"))
    return align.beside(line.select("l_orderkey", "l_linenumber", "l_quantity"), right, ["l_orderkey"], "l_linenumber")


_GROUPS = f"""n AS (SELECT l_orderkey, l_linenumber, l_linestatus AS title, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS header FROM ({_LINES})),
f AS (SELECT *, last_value(nullif(header, '') IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS h FROM n),
g AS (SELECT *, CASE WHEN lag(title) OVER w = title AND (header = '' OR h IS NOT DISTINCT FROM lag(h) OVER w) THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
v AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS grp FROM g)"""


@query(f"""WITH {_GROUPS} SELECT l_orderkey, l_linenumber, grp AS "group", CAST(row_number() OVER (PARTITION BY l_orderkey, grp ORDER BY l_linenumber) AS INT) AS row FROM v""")
def tables_below(spark, d):
    part = F.concat("l_linestatus", F.lit(" (Part "), F.col("l_linenumber").cast("string"), F.lit(")"))
    header = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    tables = _lines(spark, d).select("l_orderkey", "l_linenumber", part.alias("title"), header.alias("header"))
    grouped = align.vertical_groups(tables, ["l_orderkey"], "l_linenumber", "header", "title")
    return align.below(grouped, ["l_orderkey", "group"], ["l_linenumber"]).select("l_orderkey", "l_linenumber", "group", "row")


@query("""WITH s AS (SELECT l_orderkey AS t, list_distinct(list('brand ' || l_suppkey % 40)) AS s FROM lineitem GROUP BY l_orderkey)
SELECT a.t AS a, b.t AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 6) AS share FROM s a JOIN s b ON a.t < b.t WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) >= 0.75""")
def mergeable_tables(spark, d):
    # Numbers are gathered and named afterwards, as they are shorter than names.
    line = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("t")).agg(F.collect_set(F.col("l_suppkey") % 40).alias("x"))
    tables = line.select("t", F.transform("x", lambda x: F.concat(F.lit("Brand "), x.cast("string"))).alias("s"))
    return align.mergeable(tables, "t", "s").select("a", "b", F.round("share", 6).alias("share"))


@query("""SELECT o_custkey AS c, 'missing' AS fault FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) GROUP BY 1
UNION ALL SELECT c_custkey, 'orphan' FROM customer WHERE c_custkey % 3 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def link_faults(spark, d):
    there = _t(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("c"))
    return align.link_faults(_t(spark, d, "orders").select(F.col("o_custkey").alias("c")), there, "c")


@query("""SELECT min(doc_id) AS doc_id, hash FROM (SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents)
WHERE hash NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 5 = 0) GROUP BY hash""")
def incremental_ingest(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    history = docs.where("doc_id % 5 = 0").select(F.sha2("text", 256).alias("hash")).distinct()
    return align.to_ingest(docs, history, "text", "doc_id").select("doc_id", "hash")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1997-01-01' - 30")
def expired_entries(spark, d):
    old = align.expired(_t(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp")), "at", F.lit(datetime.datetime(1997, 1, 1)), 30 * 24)
    return old.select("o_orderkey")


@query("SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def least_used_entries(spark, d):
    return align.least_used(_t(spark, d, "events"), ["user_id"], "ts", "event_id")


@query("SELECT o_orderkey, date_diff('day', DATE '1996-06-01', CAST(o_orderdate AS DATE)) AS days_until FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-06-01' AND DATE '1996-06-01' + 90")
def upcoming_filings(spark, d):
    return align.upcoming(_t(spark, d, "orders"), "o_orderdate", F.lit(datetime.date(1996, 6, 1))).select("o_orderkey", F.col("days_until").cast("long").alias("days_until"))
