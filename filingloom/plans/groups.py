"""Queries over groups of tables and whole blocks, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingloom.operators import blocks, fuzzy
from filingloom.operators.shared import cut
from filingloom.plans.registry import _t, query

_TITLES = ["Consolidated balance sheets of part {} unaudited", "Income by region and product, part {}", "Quarterly cash flow summary {} restated", "Average loans and deposits held {}", "Shareholders equity roll forward {}"]
_TITLE_LIST = ", ".join(f"'{t}'" for t in _TITLES)


def _title_sql(n: str) -> str:
    return f"replace([{_TITLE_LIST}][CAST(o_orderpriority[1] AS INT)], '{{}}', ({n})::VARCHAR)"


def _title(n):
    which = F.substring("o_orderpriority", 1, 1).cast("int")
    return F.replace(F.element_at(F.array(*map(F.lit, _TITLES)), which), F.lit("{}"), n.cast("string"))


def _tables(spark, d):
    """Each order as a table: a title of its priority with a digit of its customer, rows of one of two kinds."""
    labels = F.when(F.col("o_custkey") % 2 == 0, F.array(*map(F.lit, ["Loans", "Total fees", "Tax", "Margin", "Net income"]))).otherwise(F.array(F.lit("Bonds"), F.lit("Swaps")))
    return _t(spark, d, "orders").select("*", _title(F.col("o_custkey") % 3).alias("title"), labels.alias("labels"))


@query(f"""WITH t AS (SELECT *, {_title_sql('o_custkey % 3')} AS title FROM orders),
g AS (SELECT *, min(o_orderkey) OVER w AS "group", first_value(title) OVER (PARTITION BY o_orderstatus, o_orderpriority, o_custkey % 2 ORDER BY o_orderkey) AS lead FROM t WINDOW w AS (PARTITION BY o_orderstatus, o_orderpriority, o_custkey % 2))
SELECT o_orderkey, "group", CASE WHEN o_orderkey != "group" THEN round((1 + CASE WHEN title = lead THEN 1 ELSE 1 - 1 / length(title)::DOUBLE END) / 2, 6) END AS score FROM g""")
def fuzzy_table_groups(spark, d):
    done = fuzzy.fuzzy_groups(_tables(spark, d), "o_orderkey", "o_orderstatus", "title", "labels")
    return done.select("o_orderkey", "group", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT *, {_title_sql('o_custkey % 3')} AS title, {_title_sql('1')} AS wanted, year(o_orderdate) AS year, 'Q' || quarter(o_orderdate) AS quarter FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY wanted, year, quarter ORDER BY CASE WHEN title = wanted THEN 0 ELSE 1 END, o_orderkey) AS n FROM t WHERE quarter IN ('Q1', 'Q3'))
SELECT wanted, year, quarter, o_orderkey, round(CASE WHEN title = wanted THEN 1 ELSE 1 - 1 / length(title)::DOUBLE END, 6) AS ratio FROM r WHERE n = 1""")
def tables_by_title(spark, d):
    t = _tables(spark, d).withColumn("year", F.year("o_orderdate")).withColumn("quarter", F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    wanted = t.select(_title(F.lit(1)).alias("wanted")).distinct()
    found = fuzzy.find_tables(t, wanted, "title", "year", "quarter", "o_orderkey", quarters=["q1", "q3 10-q"])
    return found.select("wanted", "year", "quarter", "o_orderkey", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH t AS (SELECT *, {_title_sql('o_custkey % 3')} AS a, {_title_sql('o_orderkey % 3')} AS b, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS overlap FROM orders)
SELECT o_orderkey, overlap >= 0.8 AND o_custkey % 5 > 0 AS merge, round(CASE WHEN a = b THEN 1 ELSE 1 - 1 / length(a)::DOUBLE END, 6) AS title_similarity, overlap AS row_overlap, overlap >= 0.8 AND o_custkey % 5 > 0 AS pattern_match FROM t""")
def merge_predicate(spark, d):
    k = F.col("o_orderkey") % 4
    words = lambda *w: F.array(*map(F.lit, w))
    mine = words("Total Loans", "net  fees", "Less: tax", "Margin.")
    theirs = F.when(k == 0, words("loans", "Fees", "tax", "margin", "nan", "")).when(k == 1, words("loans", "fees", "tax", "margin", "other")).when(k == 2, words("loans", "fees")).otherwise(words("nan"))
    pattern = F.when(F.col("o_custkey") % 5 > 0, "L2_L3::ANNUAL").otherwise("L3_ONLY::POINT_IN_TIME")
    s = fuzzy.merge_scores(_title(F.col("o_custkey") % 3), _title(F.col("o_orderkey") % 3), mine, theirs, F.lit("L2_L3::ANNUAL"), pattern)
    t = _t(spark, d, "orders").select("o_orderkey", s.alias("s"))
    return t.select("o_orderkey", "s.merge", F.round("s.title_similarity", 6).alias("title_similarity"), "s.row_overlap", "s.pattern_match")


# Lines of an order by ship date are a block; a customer's orders are a sheet.
_LINES = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS r, l_returnflag AS l, l_quantity::INT AS q, (l_discount * 100)::INT % 2 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_SEQUENCES = f"WITH x AS ({_LINES}), s AS (SELECT o_custkey, o_orderkey, string_agg(lower(l), '|' ORDER BY r) AS s FROM x GROUP BY ALL), g AS (SELECT *, min(o_orderkey) OVER w AS \"group\", count(*) OVER w AS blocks FROM s WINDOW w AS (PARTITION BY o_custkey, s))"


def _lines(spark, d):
    from pyspark.sql import Window

    x = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))
    return x.select("o_custkey", "o_orderkey", r.alias("r"), F.col("l_returnflag").alias("l"), F.col("l_quantity").cast("int").alias("q"))


@query(f'{_SEQUENCES} SELECT o_custkey, o_orderkey, "group", blocks FROM g WHERE blocks > 1')
def sequence_groups(spark, d):
    return blocks.sequence_groups(_lines(spark, d), ["o_custkey"], "o_orderkey", "r", "l")


@query(f"""{_SEQUENCES}, c AS (SELECT o_custkey, o_orderkey, r, 1 AS c, l AS v FROM x UNION ALL SELECT o_custkey, o_orderkey, r, 2, (q % 3)::VARCHAR FROM x UNION ALL SELECT o_custkey, o_orderkey, r, 3, (q > 25)::VARCHAR FROM x),
k AS (SELECT c.*, g."group" FROM c JOIN g USING (o_custkey, o_orderkey) WHERE blocks > 1 AND (c > 1 OR o_orderkey = g."group")),
signed AS (SELECT o_custkey, "group", o_orderkey, c, string_agg(r || ':' || v, '|' ORDER BY r) AS s FROM k GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, "group", c = 1, s ORDER BY o_orderkey, c) AS n FROM signed),
p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, "group" ORDER BY c > 1, o_orderkey, c) AS too FROM f WHERE n = 1)
SELECT o_custkey, p."group" AS o_orderkey, r, too AS c, v FROM k JOIN p USING (o_custkey, "group", o_orderkey, c)""")
def merged_beside(spark, d):
    lines = _lines(spark, d)
    groups = cut(blocks.sequence_groups(lines, ["o_custkey"], "o_orderkey", "r", "l"))
    # Lines of other orders go before each of them becomes three cells.
    lines = lines.join(groups.select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "left_semi")
    cell = lambda c, v: F.struct(F.lit(c).alias("c"), v.cast("string").alias("v"))
    cells = lines.select("o_custkey", "o_orderkey", "r", F.inline(F.array(cell(1, F.col("l")), cell(2, F.col("q") % 3), cell(3, F.col("q") > 25))))
    return blocks.merge_beside(cells, groups, ["o_custkey"], "o_orderkey", "r", "c", "v")


@query("""WITH t AS (SELECT *, lag(o_orderpriority) OVER w AS pt, lag(o_orderstatus) OVER w AS ps, lag(o_orderkey) OVER w AS pk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
n AS (SELECT *, CASE WHEN pt = o_orderpriority AND ps = o_orderstatus AND (o_orderkey % 3 = 0 OR o_orderkey % 2 = pk % 2 AND pk % 3 != 0) AND o_orderkey % 7 != 0 AND pk % 7 != 0 THEN 0 ELSE 1 END AS new FROM t)
SELECT o_orderkey, CAST(sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS "group" FROM n""")
def stacked_tables(spark, d):
    k = F.col("o_orderkey")
    t = _t(spark, d, "orders").select(
        "o_custkey", k, F.when(k % 3 == 0, None).otherwise(F.concat(F.lit("Amount "), (k % 2).cast("string"))).alias("header"), F.col("o_orderstatus").alias("section"),
        F.concat("o_orderpriority", F.lit(" (Part "), (k % 4).cast("string"), F.lit(")")).alias("title"),
        # Sevenths have metadata that look like no other's, their own kind's included.
        F.when(k % 7 == 0, F.sha2(k.cast("string"), 256)).otherwise(F.concat(F.lit("Source: quarterly report of the company, page "), (k % 10).cast("string"))).alias("meta"),
    )
    return blocks.stacked_groups(t, ["o_custkey"], "o_orderkey", "header", "section", "title", "meta").select("o_orderkey", "group")


@query("""WITH x AS (SELECT l_orderkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r, l_returnflag || ' section' AS s, 'part ' || l_partkey AS l, l_quantity AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END AS b FROM lineitem),
v AS (SELECT t, r, s, l, 'Q1-2024' AS "Dates", 'IS' AS "Header", a AS value FROM x UNION ALL SELECT t, r, s, l, 'Q2-QTD-2024', '', b FROM x),
f AS (SELECT t, s, l, "Dates", "Header", arg_min(value, r) AS value FROM v WHERE value IS NOT NULL GROUP BY ALL)
SELECT t, upper(s[1]) || substr(s, 2, 1) || 'S' || substr(s, 4) AS section, 'Part' || substr(l, 5) AS label, "Dates", "Header", value FROM f""")
def tables_on_side_whole(spark, d):
    from pyspark.sql import Window

    # Named before the window, as Spark else deals the lines again by the new name.
    lines = _t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "t")
    r = F.row_number().over(Window.partitionBy("t").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    wide = lines.select(
        "t", r.alias("r"), F.concat("l_returnflag", F.lit(" section")).alias("s"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("l"),
        F.col("l_quantity").alias("Q1-2024 IS"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("Q2-QTD-2024"),
    )
    rows, columns = blocks.on_side(wide, ["t"], "r", "l", "s", ["Q1-2024 IS", "Q2-QTD-2024"])
    return blocks.cells_of(rows, columns, ["t"])


@query("""WITH p AS (SELECT o_custkey, o_orderkey AS page, o_orderpriority AS title, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
h AS (SELECT o_custkey, arg_min(title, page) AS title, string_agg('doc_pg' || page, '; ' ORDER BY page) AS s FROM p GROUP BY o_custkey),
top AS (SELECT o_custkey, NULL AS page, i, CASE i WHEN 9 THEN '' WHEN 7 THEN 'Table Title:|' || title WHEN 8 THEN 'Source(s):|' || s ELSE ['Category (Parent)', 'Line Items', 'Product/Entity', 'Column Header (Level 1)', 'Column Header (Level 2)', 'Column Header (Level 3)', 'Year/Quarter'][i + 1] || ':|' END AS cells FROM h, range(10) x(i)),
body AS (SELECT o_custkey, page, i, CASE i WHEN 0 THEN '' WHEN 1 THEN 'a|' || page ELSE 'b' END AS cells FROM p, range(3) x(i) WHERE i > 0 OR n > 1)
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY page NULLS FIRST, i) AS line, cells FROM (SELECT * FROM top UNION ALL SELECT * FROM body)""")
def serialised_tables(spark, d):
    k = F.col("o_orderkey").cast("string")
    t = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.array(F.array(F.lit("a"), k), F.array(F.lit("b"))).alias("rows"))
    done = blocks.serialise(t, ["o_custkey"], "o_orderkey", {"Table Title": F.col("o_orderpriority"), "Source(s)": F.concat(F.lit("doc_pg"), k)}, "rows")
    return done.select("o_custkey", "line", F.array_join("cells", "|").alias("cells"))
