"""Scans, predicates, sorting and pages."""

from pyspark.sql import functions as F

from shoploom.functions.exprs import any_ilike, every
from shoploom.operators.relational import page, page_totals
from shoploom.operators.scale import By, deep_page

from .registry import query

AS_OF = "1998-06-15"
CLOSED = ["F"]


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def scan_columns(t):
    return t.customer.select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def point_lookup(t):
    return t.orders.where("o_orderkey = 77")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 150000")
def parametrised_query(t):
    text = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice >= :low"
    return t.sql(text, ["orders"], status="O", low=150000)


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 1")
def settings_row(t):
    return t.region.orderBy("r_regionkey").limit(1).select("r_regionkey", "r_name")


@query("SELECT o_orderkey AS ticket, o_orderstatus AS status, c_name AS customer_name FROM orders JOIN customer ON o_custkey = c_custkey")
def renamed_join(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("ticket"), F.col("o_orderstatus").alias("status"), F.col("c_name").alias("customer_name"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_in(t):
    return t.orders.where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F')")
def filter_not_in(t):
    return t.orders.where(~F.col("o_orderstatus").isin(CLOSED)).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority = '1-URGENT'")
def filter_not_equal(t):
    return t.orders.where("o_orderstatus <> 'O' and o_orderpriority = '1-URGENT'").select("o_orderkey")


@query(f"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS due FROM orders WHERE o_orderdate IS NOT NULL AND CAST(o_orderdate AS DATE) BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30")
def filter_between(t):
    due = F.to_date("o_orderdate")
    return t.orders.where(due.between(F.lit(AS_OF).cast("date"), F.date_add(F.lit(AS_OF).cast("date"), 30))).select("o_orderkey", due.cast("string").alias("due"))


@query(f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '{AS_OF}'")
def filter_date_equal(t):
    return t.orders.where(F.to_date("o_orderdate") == F.lit(AS_OF).cast("date")).select("o_orderkey")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%'")
def filter_like_prefix(t):
    return t.part.where(F.col("p_type").startswith("PROMO")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%BRASS' OR p_name LIKE '%e%'")
def filter_suffix(t):
    return t.part.where(F.col("p_type").endswith("BRASS") | F.col("p_name").contains("e")).select("p_partkey", "p_type")


@query("SELECT c_custkey FROM customer WHERE regexp_matches(regexp_replace(c_name, '[^0-9]', '', 'g'), '^[0-9]+$')")
def filter_regex(t):
    return t.customer.where(F.regexp_replace("c_name", "[^0-9]", "").rlike("^[0-9]+$")).select("c_custkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN true WHEN c_acctbal < 0 THEN NULL ELSE false END AS flagged FROM customer) WHERE flagged IS NULL OR flagged = false")
def filter_nullable_bool(t):
    flagged = F.when(F.col("c_acctbal") > 5000, True).when(F.col("c_acctbal") < 0, None).otherwise(False)
    return t.customer.where(~F.coalesce(flagged, F.lit(False))).select("c_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE 'FRANCE' IN (n_name, CAST(n_regionkey AS VARCHAR)) OR n_name = 'FRANCE' OR n_regionkey = 2")
def filter_multi_col_eq(t):
    given = F.lit("FRANCE").isin(F.col("n_name"), F.col("n_regionkey").cast("string"))
    return t.nation.where(given | (F.col("n_regionkey") == 2)).select("n_nationkey", "n_name")


@query(f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - INTERVAL 12 MONTH AND CAST(o_orderdate AS DATE) <= DATE '{AS_OF}'")
def filter_lookback(t):
    day, as_of = F.to_date("o_orderdate"), F.lit(AS_OF).cast("date")
    return t.orders.where((day >= F.add_months(as_of, -12)) & (day <= as_of)).select("o_orderkey")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS expires_at, o_orderpriority FROM orders) WHERE (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF} 00:00:00') AND o_orderpriority <> '5-LOW'")
def filter_expiry(t):
    expires = F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderdate"))
    valid = expires.isNull() | (expires > F.lit(f"{AS_OF} 00:00:00").cast("timestamp_ntz"))
    return t.orders.where(valid & (F.col("o_orderpriority") != "5-LOW")).select("o_orderkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 3 OR s_name ILIKE '%0000007%'")
def filter_mixed(t):
    return t.supplier.where((F.col("s_suppkey") == 3) | F.col("s_name").ilike("%0000007%")).select("s_suppkey", "s_name")


_SEARCH = "o_orderstatus NOT IN ('F') AND (c_name ILIKE '%9%' OR c_mktsegment ILIKE '%build%' OR o_orderpriority ILIKE '%urgent%')"


def search(t, status: str | None, text: str | None):
    """Orders with their customers; status is open, closed or an exact one, and each filter may be left out."""
    closed = F.col("o_orderstatus").isin(CLOSED)
    by_status = {None: None, "open": ~closed, "closed": closed}.get(status, F.col("o_orderstatus") == status)
    found = t.orders.where(every(by_status)).join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return found.where(any_ilike(text, "c_name", "c_mktsegment", "o_orderpriority")) if text else found


@query(f"SELECT o_orderkey, o_orderstatus, c_name, o_orderdate FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus NOT IN ('F') AND c_mktsegment ILIKE '%build%' OR (o_orderstatus NOT IN ('F') AND (c_name ILIKE '%build%' OR o_orderpriority ILIKE '%build%')) ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC LIMIT 50 OFFSET 50")
def ticket_search_page(t):
    order = [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc()]
    return page(search(t, "open", "build"), order, number=2).select("o_orderkey", "o_orderstatus", "c_name", "o_orderdate")


_LINES = "l_shipdate DESC NULLS FIRST, l_orderkey DESC NULLS FIRST, l_linenumber, l_partkey, l_suppkey"


@query(f"SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY {_LINES} LIMIT 5 OFFSET 49995")
def deep_page_of_lines(t):
    """Page 10,000: only the segment of it is sorted."""
    lines = t.lineitem.select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keys = [By("l_shipdate", True), By("l_orderkey", True), *map(By, ("l_linenumber", "l_partkey", "l_suppkey"))]
    return deep_page(lines, keys, 10_000, 5, task_rows=10_000)


@query("SELECT o_orderkey, o_orderstatus, c_name, o_orderdate FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus NOT IN ('F') ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC NULLS FIRST LIMIT 50 OFFSET 500")
def ticket_deep_page(t):
    """Page 11 of the open tickets; customers are joined to the page, not to what stands before it."""
    open_ = t.orders.where(~F.col("o_orderstatus").isin(CLOSED)).select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate")
    rows = deep_page(open_, [By("o_orderdate", True), By("o_orderkey", True)], 11, 50, task_rows=500)
    return rows.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderstatus", "c_name", "o_orderdate")


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM orders WHERE o_orderstatus NOT IN ('F')")
def page_total(t):
    return page_totals(t.orders.where(~F.col("o_orderstatus").isin(CLOSED)))


@query("SELECT (SELECT count(*) FROM part) AS total, count(*) AS filtered FROM part WHERE p_size > 25")
def page_total_unfiltered(t):
    return t.part.agg(F.count("*").alias("total"), F.count_if(F.col("p_size") > 25).alias("filtered"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 10")
def sort_top(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc_nulls_first(), "c_custkey").limit(10)


@query("SELECT s_suppkey, s_name, s_acctbal > 5000 AS preferred FROM supplier ORDER BY preferred DESC, s_name ASC NULLS LAST, s_suppkey LIMIT 20")
def sort_mixed(t):
    df = t.supplier.select("s_suppkey", "s_name", (F.col("s_acctbal") > 5000).alias("preferred"))
    return df.orderBy(F.col("preferred").desc(), F.col("s_name").asc_nulls_last(), "s_suppkey").limit(20)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def last_rows(t):
    return t.events.select("event_id", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100)


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE ts END, TIMESTAMP '1970-01-01 00:00:00') AS seen_at FROM events ORDER BY seen_at DESC, event_id LIMIT 50")
def sort_null_as_epoch(t):
    at = F.coalesce(F.when(F.col("event_type") == "click", None).otherwise(F.col("ts")), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return t.events.select("event_id", at.alias("seen_at")).orderBy(F.col("seen_at").desc(), "event_id").limit(50)
