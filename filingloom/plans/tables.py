"""Queries over tables as wholes, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from filingloom.functions import label, rows, titles
from filingloom.operators import ordered, scores, tables
from filingloom.plans.registry import _t, query

# Lines of an order as cells of a table: three columns, empty ones null. Keys repeat, so rows are made one for each line number.
_CELLS = """c AS (SELECT l_orderkey AS t, 0 AS col, CASE WHEN l_orderkey % 5 < 4 THEN 'label' END AS v FROM lineitem WHERE l_orderkey % 6 > 0
UNION ALL SELECT l_orderkey, 1, CASE WHEN l_orderkey % 5 < 3 THEN l_quantity::VARCHAR WHEN l_orderkey % 5 = 4 THEN 'x' END FROM lineitem WHERE l_orderkey % 6 > 0)"""


@query(f"""WITH {_CELLS}, f AS (SELECT t, count(*) FILTER (col = 0) AS rows, count(*) AS n, count(try_cast(v AS DOUBLE)) AS numbers, count(v) FILTER (col = 0) AS labels, count(v) FILTER (col = 1) AS others FROM c GROUP BY t),
p AS (SELECT l_orderkey AS t, count(*) AS processed FROM lineitem WHERE l_orderkey % 6 > 0 AND l_orderkey % 4 = 0 GROUP BY 1)
SELECT o_orderkey AS t, coalesce(rows, 0) AS rows, coalesce(processed, 0) AS processed, CASE WHEN processed > 0 THEN NULL WHEN n IS NULL THEN 'empty_input' WHEN numbers < 0.05 * n THEN 'metadata_only' WHEN labels > 0 AND others < 0.1 * labels THEN 'all_headers' ELSE 'filtered_out' END AS reason
FROM orders LEFT JOIN f ON f.t = o_orderkey LEFT JOIN p ON p.t = o_orderkey""")
def empty_tables(spark, d):
    line = _t(spark, d, "lineitem").where("l_orderkey % 6 > 0").withColumnRenamed("l_orderkey", "t")
    kind = F.col("t") % 5
    value = F.when(kind < 3, F.col("l_quantity").cast("string")).when(kind == 4, "x")
    pair = F.array(F.struct(F.lit(0).alias("col"), F.when(kind < 4, "label").alias("v")), F.struct(F.lit(1).alias("col"), value.alias("v")))
    cells = line.select("t", F.inline(pair))
    return tables.diagnose(_t(spark, d, "orders").select(F.col("o_orderkey").alias("t")), cells, line.where("t % 4 = 0").select("t"), ["t"], "col", "v")


@query("SELECT o_custkey, count(*) FILTER (o_orderkey % 3 = 0) AS rows FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 3 = 0) < 3")
def near_empty_sheets(spark, d):
    k = F.col("o_orderkey") % 3
    cells = F.when(k == 0, F.array(F.lit("Loans"), F.lit("5"))).when(k == 1, F.array(F.lit("Table Title: x"), F.lit("5"))).otherwise(F.array(F.lit(" "), F.lit(None)))
    return tables.near_empty(_t(spark, d, "orders").select("o_custkey", cells.alias("cells")), ["o_custkey"], "cells")


@query("""WITH i AS (SELECT o_custkey AS sheet, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders),
x AS (SELECT sheet, k, row_number() OVER (PARTITION BY sheet ORDER BY k) AS n FROM i WHERE NOT (sheet % 3 = 1 AND n = 1))
SELECT i.sheet, i.k AS "at", CASE i.sheet % 3 WHEN 0 THEN i.k WHEN 1 THEN x.k ELSE -y.k END AS table_at FROM i LEFT JOIN x ON x.sheet = i.sheet AND x.n = i.n LEFT JOIN i AS y ON y.sheet = i.sheet AND y.n = i.c + 1 - i.n
UNION ALL SELECT sheet, max(k), 0 FROM i WHERE sheet % 3 = 2 GROUP BY sheet""")
def enhanced_index(spark, d):
    """Sheets of three kinds: as many tables as rows, one table too few (by order), one too many (by title, in the other direction)."""
    w = Window.partitionBy("sheet").orderBy("at")
    name = F.concat(F.lit("Table #"), F.col("at").cast("string"), F.lit("#"))
    index = _t(spark, d, "orders").select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("at")).withColumn("title", F.when(F.col("sheet") % 3 == 2, name).otherwise(""))
    kind = F.col("sheet") % 3
    same = index.where(kind == 0)
    few = index.where(kind == 1).withColumn("n", F.row_number().over(w)).where("n > 1").drop("n")
    back = F.concat(F.lit("Table #"), F.element_at(F.col("ats"), F.col("n")).cast("string"), F.lit("# of all"))
    lists = index.where(kind == 2).groupBy("sheet").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    many = lists.select("sheet", "ats", F.posexplode(F.reverse("ats"))).withColumn("n", F.col("pos") + 1)
    many = many.select("sheet", (-F.element_at("ats", F.size("ats") + 1 - F.col("n"))).alias("at"), back.alias("title"))
    extra = lists.select("sheet", F.lit(0).cast("long").alias("at"), F.lit("Rest").alias("title"))
    return tables.enhanced_index(index, same.unionByName(few).unionByName(many).unionByName(extra))


@query("""SELECT p_partkey, p_retailprice::DOUBLE AS "2024", CASE WHEN p_size > 5 THEN -CAST(p_size AS DOUBLE) END AS "2023", round(p_retailprice::DOUBLE + CASE WHEN p_size > 5 THEN p_size END, 6) AS "Change", round((p_retailprice::DOUBLE + CASE WHEN p_size > 5 THEN p_size END) / p_size * 100, 6) AS pct FROM part""")
def compared_periods(spark, d):
    p = _t(spark, d, "part")
    wide = p.select("p_partkey", F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("Q4 2024"), F.when(F.col("p_size") > 5, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).otherwise("N/A").alias("Q4 2023"))
    got = tables.compare_columns(wide, "p_partkey", "2024", "2023")
    return got.select("p_partkey", "2024", "2023", F.round("Change", 6).alias("Change"), F.round("Change %", 6).alias("pct"))


@query("""WITH p AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS parent FROM orders GROUP BY o_custkey)
SELECT o_orderkey FROM orders JOIN p USING (o_custkey) WHERE o_orderpriority = parent""")
def child_rows(spark, d):
    o = _t(spark, d, "orders")
    first = o.groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("label"))
    return tables.children(first, o.withColumnRenamed("o_orderpriority", "parent"), "label", "parent", ["o_custkey"]).select("o_orderkey")


@query("""WITH k AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS k FROM orders), p AS (SELECT o_custkey, list(DISTINCT CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END) FILTER (k < 3) AS parts FROM k GROUP BY o_custkey)
SELECT o_orderkey, CASE WHEN coalesce(len(parts), 0) < 2 THEN NULL ELSE k + 1 END AS part FROM k JOIN p USING (o_custkey) WHERE k < 3 OR coalesce(len(parts), 0) < 2
UNION ALL SELECT o_orderkey, unnest(parts) FROM k JOIN p USING (o_custkey) WHERE k = 3 AND len(parts) >= 2""")
def period_parts(spark, d):
    heads = F.array(F.lit("Q4-2024"), F.lit("Q3-YTD-2024"), F.lit("YTD-2024"), F.lit("Row Label"))
    o = _t(spark, d, "orders").withColumn("header", F.element_at(heads, (F.col("o_orderkey") % 4 + 1).cast("int")))
    return tables.period_parts(o, ["o_custkey"], "header").select("o_orderkey", "part")


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT year(o_orderdate))), ',') AS falling, array_to_string(list_sort(list_distinct(flatten(list([o_orderstatus, o_orderpriority])))), ',') AS sources FROM (SELECT * REPLACE (o_orderdate::DATE AS o_orderdate) FROM orders) GROUP BY o_custkey""")
def merged_sets(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", F.array(F.year("o_orderdate")).alias("years"), F.array("o_orderstatus", "o_orderpriority").alias("sources"))
    got = tables.merge_sets(o, ["o_custkey"], ["years", "sources"], ["years"])
    return got.select("o_custkey", F.array_join(F.reverse("years"), ",").alias("falling"), F.array_join("sources", ",").alias("sources"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 3")
def repeating_headers(spark, d):
    return tables.repeating(_t(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("SELECT o_orderkey, CASE WHEN n = 1 THEN o_orderpriority ELSE o_orderpriority || '_' || (n - 1) END AS \"unique\" FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)")
def unique_names(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("name"))
    return tables.unique_names(o, ["o_custkey"]).select("o_orderkey", "unique")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END AS d FROM orders), l AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) + INTERVAL 3 MONTH AS n FROM o)
SELECT o_orderkey, CASE WHEN d IS NOT NULL THEN d::VARCHAR WHEN n IS NULL THEN 'Future' ELSE 'Future - Q' || quarter(n) || ',' || year(n) END AS label FROM l""")
def future_labels(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("date")).alias("day"), F.lit(None).cast("double").alias("actual"), F.lit(1.0).alias("predicted"))
    return tables.future_labels(o, ["o_custkey"], "o_orderkey", "day", "actual", "predicted").select("o_orderkey", "label")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '' END AS a, CASE WHEN o_orderkey % 4 < 2 THEN o_orderstatus ELSE '' END AS b FROM orders),
w AS (SELECT *, last_value(nullif(a, '') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS category FROM c),
f AS (SELECT *, (a != '' AND a IS DISTINCT FROM lag(category) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) OR (a = '' AND b != '') AS fresh FROM w),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT o_orderkey, category, CASE WHEN a != '' THEN 0 WHEN b != '' THEN 1 ELSE 2 END AS level, CASE WHEN g > 0 THEN nullif(first_value(b) OVER (PARTITION BY o_custkey, g ORDER BY o_orderkey), '') END AS subcategory FROM g""")
def row_hierarchy(spark, d):
    k = F.col("o_orderkey") % 4
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(k == 0, F.col("o_orderpriority")).otherwise("").alias("a"), F.when(k < 2, F.col("o_orderstatus")).otherwise("").alias("b"))
    return tables.hierarchy(o, ["o_custkey"], "o_orderkey", "a", "b").select("o_orderkey", "category", "level", "subcategory")


@query("""SELECT event_id, round(avg(value) OVER w, 4) AS mean, round(avg(value) OVER w - 2 * stddev_pop(value) OVER w, 4) AS lower_2, round(avg(value) OVER w + 3 * stddev_pop(value) OVER w, 4) AS upper_3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def rolling_bands(spark, d):
    got = tables.rolling_bands(_t(spark, d, "events"), ["user_id"], ["event_id"], "value")
    return got.select("event_id", *[F.round(c, 4).alias(c) for c in ("mean", "lower_2", "upper_3")])


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 20 END NULLS LAST, lower(o_orderpriority), o_orderkey::VARCHAR) AS INT) AS n FROM orders""")
def contents_order(spark, d):
    page = F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 20).cast("string")).otherwise("iv")
    order = tables.contents_order(page, F.upper("o_orderpriority"), F.col("o_orderkey").cast("string"))
    return _t(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).alias("n"))


@query("SELECT o_custkey, coalesce(min(o_orderkey) FILTER (o_orderkey % 3 = 0), min(o_orderkey)) AS page FROM orders GROUP BY o_custkey")
def sheet_pages(spark, d):
    source = F.when(F.col("o_orderkey") % 3 == 0, "10Q0624.pdf").otherwise("10k1224.pdf")
    return tables.sheet_pages(_t(spark, d, "orders").withColumn("source", source), ["o_custkey"], "source", "o_orderkey")


_HEADS = """h AS (SELECT o_custkey, o_orderkey, o_orderpriority AS label, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS v FROM orders),
s AS (SELECT *, CASE WHEN v IS NULL THEN '' ELSE coalesce(last_value(CASE WHEN v IS NULL THEN label END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), '') END AS section FROM h)"""


def _sections(spark, d):
    value = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice"))
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("label"), value.alias("Q4-2024"), (value * 2).alias("Q3-2024 rest"))
    return tables.sections_of_labels(o, ["o_custkey"], "o_orderkey", "label", ["Q4-2024", "Q3-2024 rest"])


@query(f"WITH {_HEADS} SELECT o_orderkey, section FROM s")
def label_sections(spark, d):
    return _sections(spark, d).select("o_orderkey", "section")


_NAMES = ["1-Urgent", "2-High", "3-Medium", "4-Not Specified", "5-Low"]


@query(f"""WITH {_HEADS}, l AS (SELECT o_custkey, label, v * m AS v, dates, header FROM s, (VALUES (1, 'Q4-2024', ''), (2, 'Q3-2024', 'rest')) AS p(m, dates, header) WHERE section = '')
SELECT o_custkey, dates AS "Dates", header AS "Header", {', '.join(f"min(v) FILTER (lower(label) = '{n.lower()}') AS c{n[0]}" for n in _NAMES)} FROM l GROUP BY ALL""")
def tables_on_side(spark, d):
    """Only rows without a section, so that the columns are the five priorities."""
    wide = _sections(spark, d).where("section = ''")
    got = tables.on_side(wide, ["o_custkey"], "label", "section", ["Q4-2024", "Q3-2024 rest"])
    return got.select("o_custkey", "Dates", "Header", *[F.col(f"`{n}`").alias(f"c{n[0]}") for n in _NAMES])


@query("SELECT event_id FROM events WHERE (event_id % 3 = 0 OR event_id % 4 = 0) AND month(ts) BETWEEN 1 AND 6 AND year(ts) IN (2023, 2024)")
def chart_rows(spark, d):
    e = _t(spark, d, "events").withColumn("p", F.when(F.col("event_id") % 3 == 0, 1.0)).withColumn("m", F.when(F.col("event_id") % 4 == 0, 1.0))
    return tables.in_periods(tables.rows_with_expected(e, "p", "m"), "ts", [2023, 2024], [1, 2]).select("event_id")


@query("SELECT o_custkey, o_totalprice AS actual, o_orderdate AS date FROM orders")
def inferred_columns(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    found = tables.infer_columns(o, {"actual": ["actual", "price"], "date": ["date", "period"], "none": ["lstm"]})
    return o.select("o_custkey", F.col(found["actual"]).alias("actual"), F.col(found["date"]).alias("date"))


@query("SELECT o_custkey, o_orderpriority, round(avg(o_orderkey % 101), 6) AS mean FROM orders GROUP BY GROUPING SETS ((o_custkey, o_orderpriority), (o_custkey))")
def category_scores(spark, d):
    scored = _t(spark, d, "orders").withColumn("score", F.col("o_orderkey") % 101)
    return tables.category_scores(scored, ["o_custkey"], "o_orderpriority", "score").select("o_custkey", "o_orderpriority", F.round("mean", 6).alias("mean"))


@query("""SELECT l_orderkey, round(100 * (0.2 * 1 + 0.15 * s + 0.1 * 1 + 0.2 * 0.5 + 0.1 * 1 + 0.15 * s + 0.1 * 2e0 / 3), 6) AS score, round(least(0.2 * 20 + 0.3 * 30 + 0.25 * 25 + 0.15 * 15 * s + 0.1 * 10, 100e0), 6) AS quality
FROM (SELECT l_orderkey, avg((l_linenumber % 2)::DOUBLE) AS s FROM lineitem GROUP BY l_orderkey)""")
def whole_scores(spark, d):
    t = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg((F.col("l_linenumber") % 2).cast("double")).alias("s"))
    s, one = F.col("s"), F.lit(1.0)
    meta = scores.filled_share(F.col("l_orderkey"), s, F.lit(None))
    score = scores.table_score(structure=one, completeness=s, consistency=one, numbers=F.lit(0.5), header=one, content=s, metadata=meta)
    quality = scores.extraction_quality(tables=F.lit(20.0), cells=F.lit(30.0), structure=F.lit(25.0), text=15 * s, backend=F.lit(10.0))
    return t.select("l_orderkey", F.round(score, 6).alias("score"), F.round(quality, 6).alias("quality"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS shares, o_orderkey % 4 = 0 AS data, '|' || repeat('Three Months Ended' || '|', (o_orderkey % 5)::INT) AS spanned FROM orders")
def filled_columns(spark, d):
    k = F.col("o_orderkey")
    shares = F.when(k % 3 == 0, F.array(F.lit(0.5), F.lit(None), F.lit(-1.0))).when(k % 3 == 1, F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.1), F.lit(3.0)))
    values = F.array(F.lit("2024"), F.lit("$ in millions"), F.lit("Head"), F.lit(" "), F.when(k % 4 == 0, F.concat(F.lit("$"), k.cast("string"))))
    cells = titles.spanning_row(F.lit("Three Months Ended"), k % 5 + 1)
    return _t(spark, d, "orders").select(k, rows.percent_row(shares).alias("shares"), rows.has_data(F.lit("Head"), values).alias("data"), F.concat(F.array_join(cells, "|"), F.lit("|")).alias("spanned"))


@query("""WITH l AS (SELECT o_orderkey, o_orderpriority AS p, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k < 2 THEN 'total_assets' WHEN k = 2 THEN 'net_revenues' ELSE 'zz_' || o_orderkey END AS name, CASE k WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.956522::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM l""")
def canonical_labels(spark, d):
    k = F.col("o_orderkey")
    text = F.element_at(F.array(F.lit("Assets, total"), F.lit("totl assets"), F.lit(" NET  Revenues"), F.concat(F.lit("Zz "), k.cast("string"))), (k % 4 + 1).cast("int"))
    names = {"total_assets": ["total assets", "assets, total"], "net_revenues": ["net revenues", "revenues, net"]}
    got = label.canonical(_t(spark, d, "orders").select(k, text.alias("label")), "label", names)
    return got.select("o_orderkey", "name", F.round("confidence", 6).alias("confidence"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderpriority AS title, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS f FROM orders)
SELECT o_orderkey, dense_rank() OVER (ORDER BY f) || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END AS id FROM c""")
def index_ids(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return ordered.dense_ids(o, ["o_custkey", "o_orderpriority"], ["o_orderkey"]).select("o_orderkey", "id")
