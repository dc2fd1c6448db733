"""Queries of sheet grids, index rows, vector tables and sinks, beside their SQL.

Events stand for a sheet's rows: a user is a sheet, the type and size of an
event make its first cell.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.operators import grid, resequence
from filingloom.plans.registry import _t, query
from filingloom.sources import sinks, vectors

ORDER = ["ts", "event_id"]
_FIRST = """CASE WHEN event_type = 'purchase' AND value < 60 THEN 'Table Title: ' || event_id WHEN event_type = 'signup' AND value < 60 THEN 'Source: ' || event_id
WHEN event_type = 'error' THEN CASE WHEN value < 10 THEN 'Line Items: x' ELSE '' END WHEN event_type = 'click' AND value < 30 THEN '$ in millions' ELSE 'Row ' || event_type END"""
_GRID = f"""g AS (SELECT user_id, event_id, ts, {_FIRST} AS a FROM events),
m AS (SELECT *, a LIKE 'Table Title:%' AS title, a LIKE 'Source:%' AS source, (a LIKE 'Table Title:%' OR a LIKE 'Source:%' OR a LIKE 'Line Items:%') AS meta FROM g)"""
_TABLES = f"""{_GRID}, n AS (SELECT *, sum(title::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS table_no FROM m),
p AS (SELECT *, row_number() OVER w AS pos, sum(meta::INT) OVER w AS seg FROM n WHERE table_no > 0 WINDOW w AS (PARTITION BY user_id, table_no ORDER BY ts, event_id)),
e AS (SELECT user_id, table_no, coalesce(min(pos) FILTER (source AND pos BETWEEN 2 AND 5), 1) AS fin FROM p GROUP BY ALL),
o AS (SELECT user_id, table_no, fin, min(seg) AS own FROM p JOIN e USING (user_id, table_no) WHERE NOT meta AND a <> '' AND pos > fin GROUP BY ALL),
r AS (SELECT p.* FROM p JOIN o USING (user_id, table_no) WHERE seg = own AND pos > fin),
b AS (SELECT user_id, table_no, min(pos) AS lo, max(pos) AS hi FROM r WHERE NOT meta AND a <> '' GROUP BY ALL),
t AS (SELECT r.user_id, r.event_id, r.ts, r.a, CAST(table_no AS BIGINT) AS table_no FROM r JOIN b USING (user_id, table_no) WHERE pos BETWEEN lo AND hi)"""


def _grid(spark, d) -> DataFrame:
    n = F.col("event_id").cast("string")
    kind, low = F.col("event_type"), F.col("value")
    first = (
        F.when((kind == "purchase") & (low < 60), F.concat(F.lit("Table Title: "), n)).when((kind == "signup") & (low < 60), F.concat(F.lit("Source: "), n))
        .when(kind == "error", F.when(low < 10, "Line Items: x").otherwise("")).when((kind == "click") & (low < 30), "$ in millions").otherwise(F.concat(F.lit("Row "), kind))
    )
    return _t(spark, d, "events").select("user_id", "event_id", "ts", first.alias("a"), F.array(first, n).alias("cells"))


@query(f"WITH {_TABLES} SELECT event_id, table_no FROM t")
def sheet_tables(spark, d):
    return grid.table_rows(_grid(spark, d), ["user_id"], ORDER, "a").select("event_id", "table_no")


@query(f"""WITH {_TABLES}, u AS (SELECT *, sum((a = '$ in millions')::INT) OVER (PARTITION BY user_id, table_no ORDER BY ts, event_id) AS sub FROM t),
v AS (SELECT *, row_number() OVER (PARTITION BY user_id, table_no, sub ORDER BY ts, event_id) AS k FROM u),
w AS (SELECT user_id, table_no, sub, max(k) FILTER (a <> '') AS hi FROM v GROUP BY ALL), x AS (SELECT user_id, table_no, count(*) FILTER (sub > 0 AND hi >= 2) AS parts FROM w GROUP BY ALL)
SELECT event_id, table_no, CAST(CASE WHEN parts < 2 THEN 0 ELSE sub END AS BIGINT) AS sub_no FROM v JOIN w USING (user_id, table_no, sub) JOIN x USING (user_id, table_no) WHERE parts < 2 OR (sub > 0 AND hi >= 2 AND k <= hi)""")
def sheet_sub_tables(spark, d):
    rows = grid.table_rows(_grid(spark, d), ["user_id"], ORDER, "a")
    return grid.sub_tables(rows, ["user_id", "table_no"], ORDER, "a").select("event_id", "table_no", "sub_no")


@query(f"""WITH {_GRID}, c AS (SELECT *, sum(title::INT) OVER w AS tn, sum((NOT meta AND a <> '')::INT) OVER w AS run, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(max(tn) AS BIGINT) AS table_no, arg_max(event_id || ', ' || event_id, rn) FILTER (title) AS title, arg_max(event_id || ', ' || event_id, rn) FILTER (source) AS sources,
arg_max('x, ' || event_id, rn) FILTER (a LIKE 'Line Items:%') AS items FROM c GROUP BY user_id, run HAVING bool_or(title)""")
def sheet_metadata(spark, d):
    m = grid.metadata(_grid(spark, d), ["user_id"], ORDER, "a", "cells")
    return m.select("user_id", "table_no", F.col("Table_Title_Metadata").alias("title"), F.col("Sources_Metadata").alias("sources"), F.col("Line_Items").alias("items"))


@query(f"WITH {_TABLES}, l AS (SELECT * FROM t WHERE a <> '') SELECT user_id, table_no, string_agg(lower(a), '|' ORDER BY ts, event_id) AS labels FROM l GROUP BY ALL")
def sheet_labels(spark, d):
    rows = grid.table_rows(_grid(spark, d), ["user_id"], ORDER, "a")
    return grid.row_labels(rows, ["user_id", "table_no"], ORDER, "a").select("user_id", "table_no", F.array_join("labels", "|").alias("labels"))


def _cells(spark, d, *cells: Column) -> DataFrame:
    return _t(spark, d, "events").select("user_id", "event_id", "ts", F.array(*cells).alias("cells"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, sum(CASE WHEN value < 90 THEN CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END + CASE WHEN value < 20 THEN 0.5 ELSE 0.0 END ELSE 0.0 END) >= 2 AS is_key_value FROM r WHERE k <= 7 GROUP BY user_id""")
def key_value_sheets(spark, d):
    v = F.col("value")
    label = F.when(F.col("event_type") == "purchase", "Record Date").otherwise(F.col("event_type"))
    return grid.key_value_sheets(_cells(spark, d, label, F.when(v < 90, "b"), F.when(v >= 20, "c")), ["user_id"], ORDER, "cells")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, event_type AS key, CAST(event_id AS VARCHAR) AS value FROM r WHERE k <= 20 AND event_type <> 'error'""")
def key_value_pairs(spark, d):
    n = F.col("event_id").cast("string")
    label = F.when(F.col("event_type") != "error", F.col("event_type"))
    return grid.key_value_pairs(_cells(spark, d, label, n), ["user_id"], ORDER, "cells").select(F.col("value").cast("long").alias("event_id"), "key", "value")


_PARTS = "r AS (SELECT *, event_type <> 'error' AS label, value > 60 AS dated FROM events)"


@query(f"""WITH {_PARTS}, s AS (SELECT *, max(label::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM r)
SELECT event_id, CAST(sum((seen = 1 AND NOT label AND dated)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS part_no FROM s""")
def header_parts(spark, d):
    cells = _cells(spark, d, F.when(F.col("event_type") != "error", F.col("event_type")), F.when(F.col("value") > 60, "Year Ended December 31, 2024"))
    return grid.split_on_headers(cells, ["user_id"], ORDER, "cells").select("event_id", "part_no")


@query(f"""WITH {_PARTS}, s AS (SELECT *, max(label::INT) OVER w AS broken, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, k <= 4 AND broken = 0 AND dated AS is_header FROM s""")
def header_rows(spark, d):
    cells = _cells(spark, d, F.when(F.col("event_type") != "error", F.col("event_type")), F.when(F.col("value") > 60, "2024"))
    return grid.header_rows(cells, ["user_id"], ORDER, "cells").select("event_id", "is_header")


@query("""WITH r AS (SELECT *, event_type = 'error' AS blank FROM events), s AS (SELECT *, blank AND coalesce(lead(blank) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS pair FROM r),
o AS (SELECT *, max(pair::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM s) SELECT event_id FROM o WHERE done = 0""")
def rows_until_blanks(spark, d):
    e = _t(spark, d, "events").withColumn("a", F.when(F.col("event_type") != "error", F.col("event_type")))
    return grid.until_blanks(e, ["user_id"], ORDER, "a").select("event_id")


_LEVEL = "CASE event_type WHEN 'purchase' THEN 'section2' WHEN 'signup' THEN 'section1' WHEN 'error' THEN 'section3' WHEN 'view' THEN 'main' ELSE CASE WHEN value > 60 THEN 'toc' ELSE 'section4' END END"


def _last(name: str, closers: str) -> str:
    return f"CASE WHEN max(CASE WHEN level = '{name}' THEN k END) OVER w > coalesce(max(CASE WHEN level IN ({closers}) THEN k END) OVER w, 0) THEN CAST(arg_max(event_id, k) FILTER (level = '{name}') OVER w AS VARCHAR) ELSE '' END AS {name}"


_CLOSERS = {"toc": "''", "main": "'toc'", "section1": "'toc'", "section2": "'toc', 'section1'", "section3": "'toc', 'section1', 'section2'", "section4": "'toc', 'section1', 'section2', 'section3'"}


@query(f"""WITH r AS (SELECT event_id, user_id, {_LEVEL} AS level, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, {", ".join(_last(n, c) for n, c in _CLOSERS.items())} FROM r WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def section_levels(spark, d):
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "section2", "signup", "section1", "error", "section3", "view", "main")])
    level = F.coalesce(F.try_element_at(kind, F.col("event_type")), F.when(F.col("value") > 60, "toc").otherwise("section4"))
    e = _t(spark, d, "events").select("user_id", "event_id", "ts", level.alias("level"), F.col("event_id").cast("string").alias("text"))
    return grid.section_levels(e, ["user_id"], ORDER, "level", "text").select("event_id", *grid.LEVELS)


@query("""WITH i AS (SELECT p_partkey AS row_idx, p_brand || '-' || p_size AS sheet, p_name FROM part), n AS (SELECT sheet, count(*) AS n, min(row_idx) AS row_idx FROM i GROUP BY sheet)
SELECT i.row_idx, CASE WHEN n < 2 THEN i.sheet ELSE i.sheet || '_' || k END AS table_id, CASE WHEN n < 2 THEN i.sheet ELSE i.sheet || '_' || k END AS location, CASE WHEN n < 2 THEN p_name ELSE p_name || ' (Part ' || k || ')' END AS title
FROM i JOIN n USING (sheet, row_idx), LATERAL (SELECT unnest(range(1, n + 1)) AS k)""")
def index_split(spark, d):
    sheet = F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))
    i = _t(spark, d, "part").select(F.col("p_partkey").alias("row_idx"), sheet.alias("table_id"), sheet.alias("location"), F.col("p_name").alias("title"))
    parts = i.groupBy("table_id").agg(F.count("*").alias("n_parts")).where("n_parts > 1")
    return resequence.split_index(i, parts, "table_id", "title", "location").select("row_idx", "table_id", "location", "title")


@query("""SELECT y AS year, CAST(m AS INT) AS month, 'https://example.org/' || CASE WHEN m = 12 THEN '10k' || y || '/10k12' || right(y::VARCHAR, 2) ELSE '10q0' || m || right(y::VARCHAR, 2) END || '.pdf' AS url
FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders), (SELECT unnest([3, 6, 9, 12]) AS m) WHERE last_day(make_date(y, m, 1)) + CASE WHEN m = 12 THEN 60 ELSE 45 END <= DATE '1998-06-01'""")
def filing_urls(spark, d):
    years = _t(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return resequence.filing_urls(years, "https://example.org", datetime.date(1998, 6, 1))


def _vectors(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("source_doc"), (F.col("label") % 3 + 2020).alias("year"))
    return vectors.rows(e, "vec_id", "embedding", "source_doc", ["source_doc", "year"])


@query("SELECT count(*) AS total_chunks, count(DISTINCT label) AS sources, (SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT DISTINCT CAST(label % 3 + 2020 AS VARCHAR) AS y FROM embeddings)) AS years, max(len(embedding)) AS dimension FROM embeddings")
def vector_stats(spark, d):
    return vectors.stats(_vectors(spark, d))


@query("WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id AS id, CAST(label % 3 + 2020 AS BIGINT) AS year, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS x, round(e[2] / sqrt(list_dot_product(e, e)), 6) AS y FROM v WHERE label <> 1")
def vectors_without_source(spark, d):
    v = vectors.without_source(_vectors(spark, d), "1")
    return v.select("id", F.col("metadata")["year"].cast("long").alias("year"), F.round(F.col("embedding")[0], 6).alias("x"), F.round(F.col("embedding")[1], 6).alias("y"))


@query("""SELECT page_id, len(rows) AS n_rows, CASE WHEN len(rows) = 0 THEN '' ELSE '| ' || array_to_string(rows[1], ' | ') || ' |' END AS head FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1),
lambda r: list_transform(regexp_extract_all(r, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1), lambda c: replace(trim(regexp_replace(regexp_replace(c, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '|', '\\|'))) AS rows FROM pages)""")
def html_markdown(spark, d):
    rows = sinks.html_rows(F.col("html"))
    head = F.substring_index(sinks.markdown(F.col("rows")), "\n", 1)
    return _t(spark, d, "pages").select("page_id", rows.alias("rows")).select("page_id", F.size("rows").cast("long").alias("n_rows"), head.alias("head"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS shown FROM lineitem")
def clean_cells(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sinks.clean_cell(F.col("l_quantity")).alias("shown"))


@query("SELECT event_id, CAST(json_object('event_id', event_id, 'user_id', user_id, 'kind', CASE WHEN event_type <> 'error' THEN event_type END) AS VARCHAR) AS record FROM events")
def chart_records(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return sinks.chart_records(e, ["event_id", "user_id", "kind"]).select("event_id", "record")


@query("SELECT c_mktsegment AS source, count(*) AS \"Table Count\" FROM customer GROUP BY ALL")
def source_summary(spark, d):
    return sinks.source_summary(_t(spark, d, "customer").select(F.col("c_mktsegment").alias("source")), "source")
