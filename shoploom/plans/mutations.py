"""Changes to tables, as the new version of the table."""

from functools import reduce

from pyspark.sql import functions as F

from shoploom.operators import relational as r
from shoploom.operators.scale import differences
from shoploom.sources.tables import copy_levels, copy_table, describe

from .registry import query


def _customers(t):
    return t.customer.select("c_custkey", "c_name", "c_acctbal")


_C = "SELECT c_custkey, c_name, c_acctbal FROM customer"


@query(f"""SELECT c_custkey, c_name, c_acctbal FROM ({_C}) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  UNION ALL SELECT o_custkey, 'order ' || o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'P') WHERE n = 1""")
def upsert_latest(t):
    new = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey")
    last = r.latest_per_key(new, ["c_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).drop("o_orderdate", "o_orderkey")
    return r.upsert(_customers(t), last, ["c_custkey"], [F.col("c_name")])


@query(f"{_C} UNION ALL SELECT s_suppkey + 1400, s_name, s_acctbal FROM supplier WHERE s_suppkey + 1400 NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(t):
    new = t.supplier.select((F.col("s_suppkey") + 1400).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return r.insert_ignore(_customers(t), new, ["c_custkey"])


@query("SELECT coalesce(nullif(r_name, ''), 'Main') AS store_name, true AS is_default FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey) ORDER BY r_regionkey LIMIT 1")
def insert_select(t):
    used = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return used.orderBy("r_regionkey").limit(1).select(F.coalesce(F.nullif("r_name", F.lit("")), F.lit("Main")).alias("store_name"), F.lit(True).alias("is_default"))


_DELETED = "SELECT o_orderkey, o_orderstatus, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40) AS is_active FROM orders"


def _orders_deleted(t):
    gone = t.lineitem.where("l_returnflag = 'R' and l_quantity >= 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return r.soft_delete(t.orders.select("o_orderkey", "o_orderstatus"), gone, "o_orderkey")


@query(_DELETED)
def soft_delete(t):
    return _orders_deleted(t)


@query(f"SELECT o_orderstatus, count(*) AS n FROM ({_DELETED}) WHERE is_active GROUP BY 1")
def soft_delete_guard(t):
    """What readers see of a table with inactive rows."""
    return _orders_deleted(t).where("is_active").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT * FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def hard_delete(t):
    gone = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return r.delete_keys(t.supplier, gone, "s_nationkey")


_LINES = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem"


@query(f"""{_LINES} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def child_replace(t):
    new = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_custkey").alias("l_partkey"))
    return r.child_replace(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), new, "l_orderkey")


@query("SELECT c_custkey, coalesce(s_name, c_name) AS c_name, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def patch_merge(t):
    patch = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("c_acctbal"))
    return r.patch_merge(_customers(t), patch, "c_custkey")


@query("SELECT s_suppkey, s_suppkey = (SELECT min(s_suppkey) FROM supplier) AS is_default FROM supplier")
def exclusive_flag(t):
    first = t.supplier.agg(F.min("s_suppkey").alias("first"))
    df = t.supplier.select("s_suppkey").join(first, F.col("s_suppkey") == F.col("first"), "left")
    return r.exclusive_flag(df, "is_default", F.col("first").isNotNull()).drop("first")


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND n = 1 THEN 'read' ELSE event_type END AS event_type
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts DESC, event_id DESC) AS n FROM events)""")
def update_latest(t):
    df = r.update_latest(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], F.col("event_type") == "click", event_type=F.lit("read"))
    return df.select("event_id", "event_type")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN true ELSE turn > 1 END AS is_read FROM conversations")
def bulk_status_flip(t):
    return t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", True).otherwise(F.col("turn") > 1).alias("is_read"))


@query("SELECT conv_id, count(*) FILTER (WHERE role <> 'user' AND turn <= 2) AS flipped, count(*) FILTER (WHERE role = 'user' OR turn > 2) AS unread FROM conversations GROUP BY 1")
def bulk_flip_counts(t):
    """How many rows of each conversation marking it read has changed, and how many are unread after it."""
    unread = t.conversations.select("conv_id", "role", "turn", F.lit(False).alias("is_read"))
    changed, n = r.flip(unread, ~F.col("is_read") & (F.col("role") != "user") & (F.col("turn") <= 2), is_read=F.lit(True))
    counts = unread.groupBy("conv_id").agg(n.alias("flipped"))
    left = changed.groupBy("conv_id").agg(F.count_if(~F.col("is_read")).alias("unread"))
    return counts.join(left, "conv_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)")
def uniqueness_check(t):
    again = t.part.groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")
    return t.part.join(again, "p_name", "left_semi").select("p_partkey", "p_name")


@query("""SELECT o_orderkey, coalesce(w.s_name, d.s_name) AS s_name FROM orders
  LEFT JOIN supplier w ON w.s_suppkey = o_custkey AND w.s_acctbal > 0, (SELECT arg_min(s_name, s_suppkey) AS s_name FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 10) d""")
def store_fallback(t):
    orders = t.orders.select("o_orderkey", "o_custkey")
    found = r.with_fallback(orders, t.supplier, "o_custkey", "s_suppkey", F.col("s_acctbal") > 0, F.col("s_nationkey") < 10, ["s_name"])
    return found.select("o_orderkey", "s_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_keys(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT (SELECT count(*) FROM customer) AS found, false AS skipped, (SELECT count(*) FROM customer) AS copied")
def table_copy(t):
    return copy_table(t.customer, None, "c_custkey")[1]


@query("""SELECT 'customer' AS table_name, 1 AS level, count(*) AS found, false AS skipped, count(*) AS copied, count(*) AS in_target, CAST(round(sum(c_acctbal) * 100) AS BIGINT) AS cents FROM customer
  UNION ALL SELECT 'region', 1, count(*), true, 0, count(*) FILTER (WHERE r_regionkey < 2), 0 FROM region
  UNION ALL SELECT 'nation', 2, count(*), false, count(*), count(*), 0 FROM nation
  UNION ALL SELECT 'supplier', 3, count(*), false, count(*), count(*), CAST(round(sum(s_acctbal) * 100) AS BIGINT) FROM supplier""")
def table_copies(t):
    """Copies in the order that references ask for, into targets that are empty or have rows, checked by counts of the rows written."""
    sources = {"customer": t.customer, "region": t.region, "nation": t.nation, "supplier": t.supplier}
    targets = {"customer": t.customer.limit(0), "region": t.region.where("r_regionkey < 2"), "nation": t.nation.limit(0).select("n_name", "n_regionkey"), "supplier": t.supplier.limit(0)}
    money = {"customer": "c_acctbal", "supplier": "s_acctbal"}
    levels = copy_levels({"nation": ["region"], "supplier": ["nation"], "customer": [], "region": []})
    parts = []
    for name in sorted(levels, key=lambda n: (levels[n], n)):
        rows, stats = copy_table(sources[name], targets[name], "id")
        after = targets[name].unionByName(rows, allowMissingColumns=True)
        amount = F.round(F.sum(F.when(F.lit(name in money), F.col(money.get(name, after.columns[0])).cast("double"))) * 100)
        counted = after.agg(F.count("*").alias("in_target"), F.coalesce(amount, F.lit(0)).cast("long").alias("cents"))
        parts.append(stats.withColumn("one", F.lit(1)).join(counted.withColumn("one", F.lit(1)), "one").drop("one").withColumns({"table_name": F.lit(name), "level": F.lit(levels[name])}))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("""SELECT c_custkey, 'c_name' AS "column", c_name AS source_value, 'changed' AS target_value FROM customer WHERE c_custkey = 77
  UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, NULL FROM customer WHERE c_custkey = 123 AND c_mktsegment IS NOT NULL
  UNION ALL SELECT c_custkey, NULL, 'row', NULL FROM customer WHERE c_custkey = 9 UNION ALL SELECT -5, NULL, NULL, 'row'""")
def copy_differences(t):
    """What a copy of the customers has otherwise: two cells, a row that is missing and one too many; ranges that agree are read once."""
    columns = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    name = F.when(F.col("c_custkey") == 77, "changed").otherwise(F.col("c_name")).alias("c_name")
    segment = F.when(F.col("c_custkey") != 123, F.col("c_mktsegment")).alias("c_mktsegment")
    extra = columns.limit(1).select(F.lit(-5).cast("long").alias("c_custkey"), "c_name", "c_nationkey", "c_mktsegment")
    copied = columns.where("c_custkey <> 9").select("c_custkey", name, "c_nationkey", segment).unionByName(extra)
    return differences(columns, copied, "c_custkey", leaf_rows=100, bounds=16)


@query("""SELECT 'region' AS table_name, 'r_regionkey' AS column_name, 'int' AS data_type, 1 AS position UNION ALL SELECT 'region', 'r_name', 'string', 2""")
def table_columns(t):
    return describe(t.region, "region")


@query("""WITH raw AS (SELECT event_id, user_id, event_type, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'ticket_' || event_id ELSE 'cust_x' END AS conversation FROM events WHERE user_id IS NOT NULL),
  fixed AS (SELECT event_id, user_id, event_type, CASE event_id % 3 WHEN 0 THEN 'cust_91' || lpad(conversation, 10, '0') WHEN 1 THEN coalesce('cust_91' || lpad(CAST(o_custkey AS VARCHAR), 10, '0'), conversation) ELSE conversation END AS conversation
    FROM raw LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P') ON event_id = o_orderkey),
  named AS (SELECT f.*, coalesce(c_name, 'unknown') AS customer FROM fixed f LEFT JOIN customer ON f.user_id = c_custkey)
  SELECT event_id, conversation, customer FROM named n WHERE event_type <> 'signup' OR event_id = (SELECT min(event_id) FROM named m WHERE m.event_type = 'signup' AND m.conversation = n.conversation)""")
def conversation_repair(t):
    """Four steps in order: ids from phone-like texts, ids from the tickets' customers, the customer's name, then one creation event each."""
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.col("user_id").cast("string")).when(kind == 1, F.concat(F.lit("ticket_"), F.col("event_id").cast("string"))).otherwise("cust_x")
    df = t.events.where("user_id is not null").select("event_id", "user_id", "event_type", raw.alias("conversation"))
    canonical = lambda c: F.concat(F.lit("cust_91"), F.lpad(c, 10, "0"))
    df = df.withColumn("conversation", F.when(F.col("conversation").rlike(r"^\d+$"), canonical(F.col("conversation"))).otherwise(F.col("conversation")))
    df = df.withColumn("ticket", F.expr("try_cast(regexp_extract(conversation, '^ticket_(.*)$', 1) as bigint)"))
    tickets = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("ticket"), canonical(F.col("o_custkey").cast("string")).alias("own"))
    df = df.join(tickets, "ticket", "left").withColumn("conversation", F.coalesce("own", "conversation"))
    df = df.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left").withColumn("customer", F.coalesce("c_name", F.lit("unknown")))
    created, others = df.where("event_type = 'signup'"), df.where("not (event_type <=> 'signup')")
    return r.keep_first(created, ["conversation"], "event_id").unionByName(others).select("event_id", "conversation", "customer")
