"""Queries over nested tables and small checks, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from filingloom.functions import asks, currency
from filingloom.operators import blocks, merge, nested, ordered, reshape, search
from filingloom.plans.registry import _t, query

# An order is a table: its lines are rows (named by part status, so that names repeat), two columns of cells.
_ROWS = "r AS (SELECT l_orderkey AS t, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS INT) AS i, 'Item ' || l_returnflag AS text, l_quantity::BIGINT AS q, l_linestatus AS s FROM lineitem)"


def _line_number():
    """The number of an order's line, by all that is read of it: rows, cells and notes number lines each for themselves and must agree."""
    return F.row_number().over(Window.partitionBy("t").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"))


def _nested(spark, d):
    i = _line_number()
    # Named before the window, as Spark else deals the lines again by the new name.
    lines = _t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "t").select("t", i.alias("i"), F.concat(F.lit("Item "), F.col("l_returnflag")).alias("text"), F.col("l_quantity").cast("long").alias("q"), F.col("l_linestatus").alias("s"))
    tables = _t(spark, d, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("kind"))
    rows = lines.select("t", F.col("i").alias("row_index"), "text", F.lit(None).cast("string").alias("canonical_label"), F.when(F.col("i") > 1, "All").alias("parent_row"), F.when(F.col("i") > 1, 1).otherwise(0).alias("indent_level"))
    columns = tables.select("t", F.inline(F.array(*[F.struct(F.lit(n).alias("column_index"), F.lit(h).alias("header")) for n, h in ((1, "Q1-2024"), (2, "Status"))])))
    cells = lines.select("t", F.col("i").alias("row"), F.inline(F.array(F.struct(F.lit(1).alias("column"), F.concat(F.lit("$"), F.col("q").cast("string")).alias("raw_text")), F.struct(F.lit(2).alias("column"), F.col("s").alias("raw_text")))))
    notes = lines.where("q > 40").select("t", F.lit("1").alias("marker"), F.lit("Above forty.").alias("text"), F.col("i").alias("row"), F.lit(1).alias("column"))
    return nested.nest(tables, rows, columns, cells, notes, ["t"])


def _doc():
    return F.lit("a.pdf"), F.col("title"), F.col("kind")


@query(f"""WITH {_ROWS} SELECT t, i AS "row", CAST(c AS INT) AS "column", text AS row_header, ['Q1-2024', 'Status'][c] AS column_header, CASE c WHEN 1 THEN '$' || q ELSE s END AS raw_text, CASE c WHEN 1 THEN q::DOUBLE END AS parsed_value,
CASE c WHEN 1 THEN 'currency' ELSE 'text' END AS data_type, CASE WHEN c = 1 AND q > 40 THEN '1' ELSE '' END AS refs FROM r, range(1, 3) x(c)""")
def nested_cells(spark, d):
    cells = nested.cells_of(_nested(spark, d), ["t"])
    return cells.select("t", "row", "column", "row_header", "column_header", "raw_text", "parsed_value", "data_type", F.array_join("footnote_refs", ",").alias("refs"))


@query(f"""WITH {_ROWS} SELECT t, '1' AS marker, 'Above forty.' AS text, i AS "row", 1 AS "column" FROM r WHERE q > 40""")
def nested_notes(spark, d):
    return nested.notes_of(_nested(spark, d), ["t"])


@query(f"""WITH {_ROWS}, v AS (SELECT t, text, string_agg('Q1-2024: $' || q, ', ' ORDER BY i) AS v FROM r GROUP BY ALL)
SELECT t, i AS row_index, concat_ws(chr(10), 'Document: a.pdf', 'Table: ' || o_orderpriority, 'Table Type: ' || o_orderstatus, 'Row: ' || text, CASE WHEN i > 1 THEN 'Parent: All' END, CASE WHEN i > 1 THEN 'Indent Level: 1' END, 'Values: ' || v, 'Data Type: currency') AS text
FROM r JOIN v USING (t, text) JOIN orders ON o_orderkey = t""")
def nested_row_texts(spark, d):
    return nested.row_texts(_nested(spark, d), ["t"], *_doc())


@query(f"""WITH {_ROWS} SELECT t, i AS "row", 1 AS "column", concat_ws(chr(10), 'Document: a.pdf', 'Table: ' || o_orderpriority, 'Row: ' || text, 'Column: Q1-2024', 'Value: $' || q, 'Base Value: $' || format('{{:,}}', q * 1000), 'Period: 2024', 'Data Type: currency') AS text
FROM r JOIN orders ON o_orderkey = t""")
def nested_cell_texts(spark, d):
    return nested.cell_texts(_nested(spark, d), ["t"], *_doc()[:2], periods=F.array(F.lit("2023"), F.lit("2024")), factor=F.lit(1000.0))


@query(f"""WITH {_ROWS}, f AS (SELECT t, count(*) AS n, any_value(text) FILTER (i = 1) AS first FROM r GROUP BY t)
SELECT o_orderkey AS t, concat_ws(chr(10), 'Document: a.pdf', 'Table Type: ' || o_orderstatus, 'Title: ' || o_orderpriority, 'Periods: 2024', 'Key Items: ' || first, 'Summary: ' || o_orderstatus || ' with ' || coalesce(n, 0) || ' line items across 2 columns') AS text
FROM orders LEFT JOIN f ON t = o_orderkey""")
def nested_table_texts(spark, d):
    return nested.table_texts(_nested(spark, d), ["t"], *_doc(), F.array(F.lit("2024")))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN format('{:.1f}', o_custkey / 10::DOUBLE) || '%' WHEN 2 THEN '$' || format('{:,}', o_custkey) WHEN 3 THEN CASE WHEN o_custkey = 0 THEN '$0' ELSE '($' || format('{:,}', o_custkey) || ')' END WHEN 4 THEN CASE o_custkey % 2 WHEN 0 THEN 'N/M' ELSE o_custkey || '% to 4%' END ELSE 'N/M' END AS cell FROM orders""")
def formatted_cells(spark, d):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    text = F.when(k == 1, F.concat((c / 10).cast("string"), F.lit(" %"))).when(k == 2, F.concat(F.lit(" "), c.cast("string"))).when(k == 3, F.concat(F.lit("$ ("), F.format_number(c, 0), F.lit(")"))).when(k == 4, F.when(c % 2 == 0, "N/M").otherwise(F.concat(c.cast("string"), F.lit(" % to 4%"))))
    return _t(spark, d, "orders").select("o_orderkey", currency.cell_format(text).alias("cell"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN (year(o_orderdate) + 20)::VARCHAR ELSE (year(o_orderdate) + 10)::VARCHAR || ',' || (year(o_orderdate) + 20) END AS stale FROM orders""")
def stale_years(spark, d):
    y = F.year("o_orderdate")
    text = lambda *n: F.concat(*[x for i in n for x in (F.lit(" in "), (y + i).cast("string"), F.lit(", x2020"))])
    k = F.col("o_orderkey") % 3
    contexts = F.when(k == 0, F.array(text(10), text(20))).when(k == 1, F.array(text(10), F.lit(None))).otherwise(F.array(F.lit("x2031 20311")))
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(asks.stale_years(text(20, 10), contexts), ",").alias("stale"))


@query("SELECT 4 AS periods, count(*) AS rows, count(*) * 4 AS wanted, true AS whole FROM part")
def checked_unpivot(spark, d):
    p = _t(spark, d, "part").select(F.col("p_name").alias("Category"), F.col("p_size").cast("string").alias("Q1-2024"), F.col("p_brand").alias("Q2-2024 IS"), F.lit("").alias("$ in millions"), F.lit(None).cast("string").alias("YTD-2023"), F.lit("x").alias("Total"))
    return reshape.check_long(p, reshape.to_long(p)).select("periods", "rows", "wanted", "whole")


@query("""WITH c AS (SELECT l_orderkey AS t, l_linenumber AS n, x.c, CASE x.c WHEN 1 THEN l_returnflag WHEN 2 THEN l_returnflag WHEN 3 THEN l_linestatus ELSE l_quantity::INT::VARCHAR END AS v, l_partkey, l_quantity FROM lineitem, range(1, 5) x(c)),
r AS (SELECT t, row_number() OVER (PARTITION BY t, c ORDER BY n, l_partkey, l_quantity) AS i, c, v FROM c),
s AS (SELECT t, c, string_agg(i || ':' || v, '|' ORDER BY i) AS s FROM r GROUP BY ALL)
SELECT t, min(c)::INT AS c FROM s GROUP BY t, CASE WHEN c < 4 THEN 'Flag' ELSE 'Amount' END, s""")
def distinct_columns(spark, d):
    i = _line_number()
    lines = _t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "t").select("t", i.alias("i"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string").alias("q"))
    cell = lambda c, h, v: F.struct(F.lit(c).alias("c"), F.lit(h).alias("h"), F.col(v).alias("v"))
    cells = lines.select("t", "i", F.inline(F.array(cell(1, "Flag", "l_returnflag"), cell(2, " flag ", "l_returnflag"), cell(3, "FLAG", "l_linestatus"), cell(4, "Amount", "q"))))
    return blocks.distinct_columns(cells, ["t"], "i", "c", "h", "v").select("t", "c")


@query("""WITH t AS (SELECT doc_id, substr(text, 1, 40) AS title, lang, source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM t WHERE doc_id % 2 = 0)
SELECT CASE WHEN doc_id % 3 = 0 THEN source || '_p' || doc_id || '_' || n ELSE 'T' || doc_id END AS _table_id, source AS _source, doc_id AS _page, lang AS _table, round(1 / n::DOUBLE, 9) AS _score, CAST(n AS INT) AS _rank, CASE x.i WHEN 1 THEN 'a' END AS a, CASE x.i WHEN 1 THEN doc_id::VARCHAR END AS b, CASE x.i WHEN 2 THEN n::VARCHAR END AS c FROM r, range(1, 3) x(i)""")
def retrieved_tables(spark, d):
    docs = _t(spark, d, "documents").where("doc_id % 2 = 0")
    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    hits = docs.select(
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("T"), F.col("doc_id").cast("string"))).alias("table_id"), F.col("source").alias("source_doc"), F.col("doc_id").alias("page_no"), F.col("lang").alias("table_title"),
        n.alias("rank"), (F.lit(1.0) / n).alias("score"),
    )
    one = hits.select("*", F.create_map(F.lit("a"), F.lit("a"), F.lit("b"), F.col("page_no").cast("string")).alias("row")).unionByName(hits.select("*", F.create_map(F.lit("c"), F.col("rank").cast("string")).alias("row")))
    done = merge.with_provenance(one, "row")
    return done.select("_table_id", "_source", "_page", "_table", F.round("_score", 9).alias("_score"), "_rank", *[F.try_element_at("row", F.lit(c)).alias(c) for c in "abc"])


@query("""WITH t AS (SELECT doc_id, lang, text, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents),
s AS (SELECT lang, doc_id, round(len(list_filter(list_distinct(w), lambda x: x IN ('the', 'of', 'data'))) / 3::DOUBLE, 6) AS score FROM t WHERE rank <= 50)
SELECT lang AS query_id, doc_id AS id, score, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def reranked(spark, d):
    """The first fifty documents of each language, by the share of three terms that they hold."""
    import re

    import pandas as pd

    first = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    lists = _t(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.lit("the of data").alias("query"), "text", first.alias("rank"))

    def model():
        words = re.compile("[a-z]+")
        share = lambda q, t: len(set(q.split()) & set(words.findall(t.lower()))) / len(q.split())
        return lambda queries, texts: pd.Series([share(q, t) for q, t in zip(queries, texts, strict=True)])

    return search.rerank(lists, model, 5, among=50).withColumn("score", F.round("score", 6))


@query("""SELECT CASE WHEN trim(p_brand) != '' AND p_size > 25 THEN p_brand ELSE '10q0925.pdf_pg7' END AS "Source", 'Results' AS "Section", 'Selected' AS "Table Title", p_name AS "Category", p_size AS "Q1-2025", p_partkey FROM part""")
def injected_metadata(spark, d):
    p = _t(spark, d, "part").select(F.col("p_name").alias("Category"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" ").alias("Source"), F.col("p_size").alias("Q1-2025"), "p_partkey")
    return reshape.inject(p, "10q0925.pdf_pg7", "Results", "Selected")


@query("""SELECT doc_id, n_chars AS score FROM documents WHERE lang IN ('en', 'de') AND contains(lower(source), 'a') AND n_chars >= 500""")
def filtered_results(spark, d):
    kept = search.matching(_t(spark, d, "documents"), {"lang": ["en", "de"], "source": "A"})
    return search.above(kept.select("doc_id", F.col("n_chars").alias("score")), 500)


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
h AS (SELECT *, max(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS head FROM o)
SELECT o_custkey, o_orderkey, coalesce('Head ' || head, '') AS "Category" FROM h WHERE o_orderkey % 4 != 0 AND o_orderkey % 7 != 0""")
def category_rows(spark, d):
    """Every fourth order is a category row, by blanks or by its label in all cells; sevenths among the others have no label and go."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Head "), k.cast("string"))
    cell = F.when(k % 8 == 0, name).when(k % 4 == 0, " ").otherwise("5")
    label = F.when(k % 4 == 0, name).when(k % 7 == 0, " ").otherwise("Row")
    g = _t(spark, d, "orders").select("o_custkey", k, label.alias("label"), cell.alias("a"), cell.alias("b"))
    return ordered.categories(g, ["o_custkey"], "o_orderkey", F.col("label"), ["a", "b"]).select("o_custkey", "o_orderkey", "Category")
