"""Each query beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions import currency, guard, label, period
from filingloom.operators import merge, ordered, reshape, search, series
from filingloom.operators.shared import stored
from filingloom.sources import files
from filingloom.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _quarterly(spark: SparkSession, d: str) -> DataFrame:
    """Order totals by priority (label), status (section) and quarter."""
    o = _t(spark, d, "orders")
    code = period.code_of_date(F.col("o_orderdate"))
    return o.groupBy(F.col("o_orderstatus").alias("section"), F.col("o_orderpriority").alias("label"), code.alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


_QUARTERLY = "SELECT o_orderstatus AS section, o_orderpriority AS label, 'Q' || quarter(o_orderdate) || '-' || year(o_orderdate) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL"
PERIODS = [f"Q{q}-{y}" for y in range(1992, 2003) for q in (1, 2, 3, 4)]
_WIDE = "SELECT section, label, " + ", ".join(f"max(value) FILTER (period = '{p}') AS \"{p}\"" for p in PERIODS) + f" FROM ({_QUARTERLY}) GROUP BY section, label"


@query(_WIDE)
def timeseries_view(spark, d):
    return reshape.to_wide(_quarterly(spark, d), ["section", "label"], "period", "value", "period", PERIODS)


_LONG = " UNION ALL ".join(f"SELECT section, label, '{p}' AS \"Dates\", '' AS \"Header\", \"{p}\" AS \"Data Value\" FROM w" for p in PERIODS)


@query(f"WITH w AS ({_WIDE}) {_LONG}")
def unpivot_quarters(spark, d):
    return reshape.to_long(timeseries_view(spark, d), ["section", "label"])


@query("""SELECT o_orderstatus AS section, o_orderpriority AS label, """ + ", ".join(f"round(sum(o_totalprice) FILTER (year(o_orderdate) = {y} AND quarter(o_orderdate) = {q}), 2) AS \"Q{q}-{y}\"" for y in range(1995, 2002) for q in (1, 2, 3, 4) if (y, q) < (2001, 4)) + " FROM orders GROUP BY ALL")
def timeseries_view_all(spark, d):
    """The view over every quarter of the table."""
    return reshape.to_wide(_quarterly(spark, d), ["section", "label"], "period", "value", "period")


@query(f"WITH q AS ({_QUARTERLY}), k AS (SELECT DISTINCT section, label FROM q), p AS (SELECT DISTINCT period FROM q) SELECT section, label, period AS \"Dates\", '' AS \"Header\", value AS \"Data Value\" FROM k CROSS JOIN p LEFT JOIN q USING (section, label, period)")
def unpivot_quarters_all(spark, d):
    return reshape.to_long(timeseries_view_all(spark, d), ["section", "label"])


@query("SELECT o_orderkey, 'Q' || quarter(o_orderdate) || '-' || year(o_orderdate) AS code, last_day(o_orderdate) AS month_end FROM orders")
def period_code(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", period.code_of_date(F.col("o_orderdate")).alias("code"), F.last_day("o_orderdate").alias("month_end"))


_HEADERS = "concat(CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'Q' || quarter(o_orderdate) || '-QTD-' || year(o_orderdate) WHEN 1 THEN 'Q' || quarter(o_orderdate) || '-' || year(o_orderdate) || ' IS' WHEN 2 THEN 'YTD-' || year(o_orderdate) || ' Total' ELSE '% change' END)"


def _headers():
    q, y = F.quarter("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 4
    return F.when(k == 0, F.concat(F.lit("Q"), q, F.lit("-QTD-"), y)).when(k == 1, F.concat(F.lit("Q"), q, F.lit("-"), y, F.lit(" IS"))).when(k == 2, F.concat(F.lit("YTD-"), y, F.lit(" Total"))).otherwise("% change")


@query(rf"""WITH h AS (SELECT o_orderkey, {_HEADERS} AS header FROM orders), c AS (SELECT *, regexp_extract(header, '^(Q[1-4]-QTD-\d{{4}}|Q[1-4]-YTD-\d{{4}}|Q[1-4]-\d{{4}}|YTD-\d{{4}})', 1) AS code FROM h)
SELECT o_orderkey, CASE WHEN code <> '' THEN code ELSE header END AS dates, CASE WHEN code <> '' THEN trim(substr(header, length(code) + 1)) ELSE '' END AS rest,
CASE WHEN header SIMILAR TO 'Q[1-4]-(QTD|YTD)-\d{{4}}.*' THEN 'period_based' WHEN header SIMILAR TO 'YTD-\d{{4}}.*' THEN 'annual_ytd' WHEN header SIMILAR TO 'Q[1-4]-\d{{4}}.*' THEN 'point_in_time' ELSE 'other' END AS kind FROM c""")
def period_header_split(spark, d):
    dates, rest = period.split_header(F.col("header"))
    return _t(spark, d, "orders").select("o_orderkey", _headers().alias("header")).select("o_orderkey", dates.alias("dates"), rest.alias("rest"), period.kind(F.col("header")).alias("kind"))


@query("SELECT string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS \"Source\", c_mktsegment AS \"Section\", CAST(n_regionkey AS VARCHAR) AS \"Category\" FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def master_merge(spark, d):
    # nation has 25 rows.
    facts = _t(spark, d, "customer").join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return merge.merge_sources(facts.select(F.col("n_name").alias("Source"), F.col("c_mktsegment").alias("Section"), F.col("n_regionkey").alias("Category")))


@query(f"""WITH q AS ({_QUARTERLY}), g AS (SELECT section, label, count(DISTINCT value) AS products, min(nullif(regexp_extract(period, '(20\\d{{2}})', 1), '')) AS lo, max(nullif(regexp_extract(period, '(20\\d{{2}})', 1), '')) AS hi, count(*) AS records FROM q GROUP BY section, label)
SELECT format('TBL_{{:03d}}', row_number() OVER (ORDER BY section, label)) AS table_id, section, label, products, CASE WHEN lo IS NULL THEN '' WHEN lo = hi THEN lo ELSE lo || '-' || hi END AS years, records FROM g""")
def table_catalog(spark, d):
    return merge.catalog(_quarterly(spark, d), ["section", "label"], "value", "period")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'login' OR value > 150 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS category FROM events")
def category_ffill(spark, d):
    e = _t(spark, d, "events")
    head = F.when((F.col("event_type") == "login") | (F.col("value") > 150), F.col("event_type"))
    return ordered.forward_fill(e, ["user_id"], ["ts", "event_id"], head, "category").select("event_id", "user_id", "category")


@query("SELECT event_id, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM events")
def row_islands(spark, d):
    return ordered.islands(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 100).select("event_id", "island")


@query("""WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_no, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT *, greatest(0, CAST(ceil((row_no - 10) / 7.0) AS BIGINT)) AS lo, least(CAST(floor((row_no - 1) / 7.0) AS BIGINT), CASE WHEN n <= 10 THEN 0 ELSE CAST(floor((n - 3) / 7.0) AS BIGINT) END) AS hi FROM n)
SELECT event_id, user_id, CAST(row_no AS INT) AS row_no, CAST(unnest(range(lo, hi + 1)) AS INT) AS chunk FROM c""")
def row_chunks(spark, d):
    return ordered.row_chunks(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "row_no", "chunk")


@query("""SELECT e.event_id, o.o_orderkey AS section FROM events e ASOF LEFT JOIN (SELECT event_id AS o_orderkey, user_id, ts FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) o ON e.user_id = o.user_id AND e.ts >= o.ts""")
def asof_section(spark, d):
    e = _t(spark, d, "events")
    heads = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.min("event_id").alias("section"))
    return ordered.asof(e.select("event_id", "user_id", "ts"), heads, ["user_id"], "ts", "section").select("event_id", "section")


_PAIR = "(SELECT section || label AS label, value FROM (" + _QUARTERLY + ") WHERE period = '{}')"


@query(f"SELECT label, coalesce(CAST(a.value AS VARCHAR), 'N/A') AS a, coalesce(CAST(b.value AS VARCHAR), 'N/A') AS b FROM {_PAIR.format('Q1-1995')} a FULL JOIN {_PAIR.format('Q2-1995')} b USING (label)".replace("CAST(a.value AS VARCHAR)", "CAST(CAST(a.value AS DECIMAL(18,2)) AS VARCHAR)").replace("CAST(b.value AS VARCHAR)", "CAST(CAST(b.value AS DECIMAL(18,2)) AS VARCHAR)"))
def outer_periods(spark, d):
    q = _quarterly(spark, d).withColumn("label", F.concat("section", "label")).withColumn("value", F.col("value").cast("decimal(18,2)"))
    return merge.outer_periods(q.where("period = 'Q1-1995'"), q.where("period = 'Q2-1995'"), "label", ("a", "b"), "value")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_view(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_links(spark, d):
    return _t(spark, d, "customer").select("c_custkey").join(_t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def dedup_top1(spark, d):
    return merge.top_one(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey")


@query("SELECT l_returnflag, count(l_quantity) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag")
def numeric_agg(spark, d):
    q = F.col("l_quantity")
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(q).alias("n"), F.round(F.sum(q), 2).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("least"), F.max(q).alias("most"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_stats(spark, d):
    return _t(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(f"SELECT section, label, period, round(value - lag(value) OVER w, 2) AS change, round((value - lag(value) OVER w) / abs(nullif(lag(value) OVER w, 0)) * 100, 4) AS pct_change FROM ({_QUARTERLY}) WINDOW w AS (PARTITION BY section, label ORDER BY right(period, 4), period)")
def period_change(spark, d):
    q = _quarterly(spark, d).withColumn("k", period.sort_key(F.col("period")))
    return ordered.period_change(q, ["section", "label"], ["k"], "value").select("section", "label", "period", F.round("change", 2).alias("change"), F.round("pct_change", 4).alias("pct_change"))


def _lists(spark, d) -> DataFrame:
    v = _t(spark, d, "embeddings")
    # Four stated queries.
    q = v.where("vec_id IN (3, 7, 11, 19)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = search.knn(v, q, 10, at_most=4).withColumn("strategy", F.lit("vector"))
    by_label = search.knn(v, q, 10, where=F.col("label") < 5, at_most=4).withColumn("strategy", F.lit("filtered"))
    return near.unionByName(by_label).withColumn("score", F.round("score", 6))


_KNN = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id IN (3, 7, 11, 19)),
s AS (SELECT query_id, vec_id AS id, label, list_dot_product(CAST(embedding AS DOUBLE[]), query) AS score FROM embeddings, q),
l AS (SELECT query_id, 'vector' AS strategy, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10
UNION ALL SELECT query_id, 'filtered', id, round(score, 6), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE label < 5 QUALIFY rank <= 10) """


@query(_KNN + "SELECT query_id, strategy, id, score, CAST(rank AS INT) AS rank FROM l")
def knn_topk(spark, d):
    return _lists(spark, d).select("query_id", "strategy", "id", "score", "rank")


@query(_KNN + "SELECT query_id, id, round(sum(CASE strategy WHEN 'vector' THEN 0.6 ELSE 0.4 END / (60 + rank)), 9) AS score, count(*) AS appearances FROM l GROUP BY query_id, id")
def rrf_fusion(spark, d):
    return search.rrf(_lists(spark, d), {"vector": 0.6, "filtered": 0.4}).select("query_id", "id", F.round("score", 9).alias("score"), "appearances")


@query(_KNN + ", m AS (SELECT *, (score - min(score) OVER w) / coalesce(nullif(max(score) OVER w - min(score) OVER w, 0), 1) AS x FROM l WINDOW w AS (PARTITION BY query_id, strategy)) SELECT query_id, id, round(sum(CASE strategy WHEN 'vector' THEN 0.6 ELSE 0.4 END * x), 6) AS score FROM m GROUP BY query_id, id")
def weighted_fusion(spark, d):
    return search.weighted(search.min_max(_lists(spark, d)), {"vector": 0.6, "filtered": 0.4}).select("query_id", "id", F.round("score", 6).alias("score"))


@query(_KNN + ", r AS (SELECT l.*, e.label % 2 = 0 AS rel FROM l JOIN embeddings e ON l.id = e.vec_id WHERE strategy = 'vector') SELECT query_id, round(avg(CAST(rel AS INT)), 6) AS precision, round(coalesce(max(CASE WHEN rel THEN 1.0 / rank END), 0), 6) AS mrr, CAST(sum(CAST(rel AS INT)) AS BIGINT) AS hits FROM r GROUP BY query_id")
def mrr_precision(spark, d):
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    ranked = _lists(spark, d).where("strategy = 'vector'").join(labels, "id")
    return search.metrics(ranked, F.col("label") % 2 == 0).select("query_id", F.round("precision", 6).alias("precision"), F.round("mrr", 6).alias("mrr"), "hits")


def _lists_all(spark, d) -> DataFrame:
    v = _t(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = search.knn_blocks(v, q, 10).withColumn("strategy", F.lit("vector"))
    by_label = search.knn_blocks(v, q, 10, where=F.col("label") < 5).withColumn("strategy", F.lit("filtered"))
    return near.unionByName(by_label).withColumn("score", F.round("score", 6))


def _all_queries(sql: str) -> str:
    """The SQL of a search with every row whose id is divisible by 50 as a query."""
    few, every = "vec_id IN (3, 7, 11, 19)", "vec_id % 50 = 0"
    assert few in sql
    return sql.replace(few, every)


@query(_all_queries(SQL["knn_topk"]))
def knn_topk_all(spark, d):
    return _lists_all(spark, d).select("query_id", "strategy", "id", "score", "rank")


@query(_all_queries(SQL["rrf_fusion"]))
def rrf_fusion_all(spark, d):
    return search.rrf(_lists_all(spark, d), {"vector": 0.6, "filtered": 0.4}).select("query_id", "id", F.round("score", 9).alias("score"), "appearances")


@query(_all_queries(SQL["weighted_fusion"]))
def weighted_fusion_all(spark, d):
    return search.weighted(search.min_max(_lists_all(spark, d)), {"vector": 0.6, "filtered": 0.4}).select("query_id", "id", F.round("score", 6).alias("score"))


@query(_all_queries(SQL["mrr_precision"]))
def mrr_precision_all(spark, d):
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    ranked = _lists_all(spark, d).where("strategy = 'vector'").join(labels, "id")
    return search.metrics(ranked, F.col("label") % 2 == 0).select("query_id", F.round("precision", 6).alias("precision"), F.round("mrr", 6).alias("mrr"), "hits")


#: The last term stands in over half of the documents.
_TERMS = ["stupid", "licensed", "the"]
_BM25 = """WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT term, id, count(*) AS tf, any_value(len) AS len FROM (SELECT id, unnest(w) AS term, len(w) AS len FROM t) GROUP BY term, id),
d AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term, n),
i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM d) ELSE idf END AS idf FROM d),
f AS (SELECT id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM p JOIN i USING (term), s WHERE term IN ('stupid', 'licensed', 'the') GROUP BY id)
SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM f WHERE score > 0 ORDER BY score DESC, id LIMIT 20"""


@query(_BM25)
def bm25_topk(spark, d):
    return search.bm25(_t(spark, d, "documents"), _TERMS, 20)


@query(_BM25)
def bm25_from_index(spark, d):
    docs = _t(spark, d, "documents")
    # Written once: the figures and the search read columns of the index, and no text again.
    index = stored(search.term_index(docs), "postings")
    n = docs.count()
    total = index.agg(F.sum("tf")).first()[0]
    mean = search.term_statistics(index).agg(F.avg(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0]
    return search.bm25_index(index, _TERMS, 20, n, total / n, mean)


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '($' || b || ')' ELSE '$' || b END AS shown, round(c_acctbal / 10000, 4) AS ratio FROM (SELECT *, CASE WHEN abs(c_acctbal) % 1 = 0 OR abs(c_acctbal) >= 1000 THEN format('{:,.0f}', abs(c_acctbal)) ELSE format('{:,.2f}', abs(c_acctbal)) END AS b FROM customer)")
def currency_format(spark, d):
    return _t(spark, d, "customer").select("c_custkey", currency.currency(F.col("c_acctbal")).alias("shown"), F.round(F.col("c_acctbal") / 10000, 4).alias("ratio"))


@query("SELECT p_partkey, CASE WHEN abs(v) <= 1 AND v <> 0 THEN format('{:,.1f}%', v * 100) ELSE format('{:,.1f}%', v) END AS shown FROM (SELECT p_partkey, p_size / 25.0 AS v FROM part)")
def percent_format(spark, d):
    return _t(spark, d, "part").select("p_partkey", currency.percentage(F.col("p_size") / 25.0).alias("shown"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS parsed FROM customer")
def currency_parse(spark, d):
    c = F.col("c_acctbal")
    body = F.format_number(F.abs(c), 2)
    text = F.when(F.col("c_custkey") % 7 == 0, "N/M").when(c < 0, F.concat(F.lit("($"), body, F.lit(")"))).otherwise(F.concat(F.lit("$"), body))
    return _t(spark, d, "customer").select("c_custkey", currency.parse(text).alias("parsed"))


@query("SELECT event_id, round(m, 6) AS deviation, CASE WHEN m IS NULL THEN NULL WHEN m <= 20 THEN 'green' WHEN m <= 30 THEN 'amber' ELSE 'red' END AS zone FROM (SELECT event_id, abs((value - 50) / nullif(value, 0)) * 100 AS m FROM events)")
def mape_zone(spark, d):
    m = series.mape(F.col("value"), F.lit(50.0))
    return _t(spark, d, "events").select("event_id", F.round(m, 6).alias("deviation"), series.zone(m, 20, 30).alias("zone"))


_Z = "SELECT e.event_id, e.event_type, abs(value - mean) / coalesce(nullif(std, 0), 1) AS z, abs((value - 50) / nullif(value, 0)) * 100 AS m FROM events e JOIN (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY event_type) s USING (event_type)"


def _scored(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    s = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    z = series.z_score(F.col("value"), F.col("mean"), F.col("std"))
    return e.join(s, "event_type").select("event_id", "event_type", z.alias("z"), series.mape(F.col("value"), F.lit(50.0)).alias("m"))


@query(f"SELECT event_id, round(z, 6) AS z, CASE WHEN z <= 2 THEN 'green' WHEN z <= 3 THEN 'amber' ELSE 'red' END AS zone FROM ({_Z})")
def zscore_zone(spark, d):
    return _scored(spark, d).select("event_id", F.round("z", 6).alias("z"), series.zone(F.col("z"), 2, 3).alias("zone"))


@query(f"SELECT CASE WHEN z > 1 AND m > 30 THEN 'both' WHEN z > 1 THEN 'first_only' WHEN m > 30 THEN 'second_only' ELSE 'none' END AS agreement, count(*) AS n FROM ({_Z}) GROUP BY 1")
def anomaly_agreement(spark, d):
    return series.agreement(_scored(spark, d), F.col("z") > 1, F.coalesce(F.col("m") > 30, F.lit(False)))


@query("SELECT event_id FROM (SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM events) WHERE f = 1")
def leading_trim(spark, d):
    return ordered.leading_trim(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id")


@query("SELECT doc_id, sha256(text) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def content_hash_dedup(spark, d):
    # min() combines in each task: a hash that a third of the rows share stays one row a task.
    return _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "hash")


_PII = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\b\\d{3}-\\d{2}-\\d{4}\\b', '[REDACTED]', 'g'), '\\b\\d{16}\\b', '[REDACTED]', 'g'), '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b', '[REDACTED]', 'g'), '\\b\\d{3}[-.]\\d{3}[-.]\\d{4}\\b', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, sha256({_PII}) AS redacted_hash, length({_PII}) AS n FROM documents")
def pii_redact(spark, d):
    r = guard.redact(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.sha2(r, 256).alias("redacted_hash"), F.length(r).cast("long").alias("n"))


@query("""SELECT conv_id, turn, regexp_matches(lower(text), 'ignore (all |previous )+instructions|system prompt|you are now|<script') AS injected,
CASE WHEN regexp_matches(lower(text), 'compare|versus| vs ') THEN 'comparison' WHEN regexp_matches(lower(text), 'trend|over time|growth') THEN 'trend' WHEN regexp_matches(lower(text), 'total|average|sum of') THEN 'aggregation' WHEN regexp_matches(lower(text), 'breakdown|under |within ') THEN 'hierarchical' ELSE 'specific_value' END AS kind FROM conversations""")
def query_type(spark, d):
    t = F.col("text")
    return _t(spark, d, "conversations").select("conv_id", "turn", guard.injected(t).alias("injected"), guard.query_kind(t).alias("kind"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<p[^>]*>([^<]*)</p>', 1)) AS n, array_to_string(regexp_extract_all(html, '(?i)<p[^>]*>([^<]*)</p>', 1), '|') AS texts FROM pages")
def html_tables(spark, d):
    x = files.html_texts(F.col("html"), "p")
    return _t(spark, d, "pages").select("page_id", F.size(x).cast("long").alias("n"), F.array_join(x, "|").alias("texts"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_rows, CAST(sum(len(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|'))) AS BIGINT) AS cells FROM l WHERE contains(line, '|') AND NOT regexp_matches(line, '^[\\s|:-]+$') GROUP BY doc_id""")
def markdown_rows(spark, d):
    rows = files.markdown_cells(F.col("text"))
    x = _t(spark, d, "documents").select("doc_id", F.explode(rows).alias("cells"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum(F.size("cells")).alias("cells"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(spark, d):
    return windows.tumbling(_t(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, d):
    return windows.sessions(_t(spark, d, "events"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS label FROM part")
def label_normalise(spark, d):
    return _t(spark, d, "part").select("p_partkey", label.normalise(F.col("p_name")).alias("label"))
