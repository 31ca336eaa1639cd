"""Orders, invoices and payments; money is decimal throughout."""

from pyspark.sql import functions as F

from shoploom.functions.exprs import MONEY, errors, leading_number, payment_status as status_of, phone_lenient
from shoploom.operators.relational import apply_payments, nest_children

from .registry import query

GST = "0.18"
D = "DECIMAL(15,2)"


def money(c):
    return F.col(c).cast(MONEY)


def total(c):
    return F.sum(c).cast("decimal(18,2)")


@query("""SELECT o.o_orderkey, o.o_custkey, coalesce(i.components, '[]') AS components FROM orders o LEFT JOIN (
  SELECT l_orderkey, CAST(to_json(list(struct_pack(l_linenumber := l_linenumber, l_partkey := l_partkey, l_suppkey := l_suppkey) ORDER BY l_linenumber, l_partkey, l_suppkey)) AS VARCHAR) AS components
  FROM lineitem GROUP BY 1) i ON o.o_orderkey = i.l_orderkey""")
def order_with_components(t):
    nested = nest_children(t.orders.select("o_orderkey", "o_custkey"), t.lineitem, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "components")
    return nested.withColumn("components", F.to_json("components"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n_completed FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linestatus = 'F' GROUP BY 1""")
def left_join_residual(t):
    done = t.lineitem.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return t.orders.join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_completed"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority, s_name FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def visits_with_dims(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderpriority", "s_name")


_TOTALS = f"""SELECT o_orderkey, CAST(CAST(o_totalprice AS {D}) + coalesce(s, 0) AS DECIMAL(18,2)) AS subtotal, CAST(coalesce(d, 0) AS {D}) AS discount
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS {D})) AS s, sum(CAST(l_discount * 100 AS {D})) AS d FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""


def _totals(t):
    parts = t.lineitem.groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("s"), F.sum((F.col("l_discount") * 100).cast(MONEY)).alias("d"))
    joined = t.orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = F.lit(0).cast(MONEY)
    return joined.select("o_orderkey", (money("o_totalprice") + F.coalesce("s", zero)).cast("decimal(18,2)").alias("subtotal"), F.coalesce("d", zero).cast(MONEY).alias("discount"))


@query(f"""SELECT o_orderkey, subtotal, CAST(subtotal * {GST} AS DECIMAL(18,2)) AS gst, CAST(subtotal + CAST(subtotal * {GST} AS DECIMAL(18,2)) - discount AS DECIMAL(18,2)) AS grand_total FROM ({_TOTALS})""")
def order_totals_gst(t):
    gst = (F.col("subtotal") * F.lit(GST).cast("decimal(3,2)")).cast("decimal(18,2)")
    return _totals(t).select("o_orderkey", "subtotal", gst.alias("gst"), (F.col("subtotal") + gst - F.col("discount")).cast("decimal(18,2)").alias("grand_total"))


_ADVANCE = f"CASE o_orderkey % 4 WHEN 0 THEN CAST(o_totalprice AS {D}) WHEN 1 THEN CAST(100 AS {D}) WHEN 2 THEN CAST(0 AS {D}) ELSE CAST(CAST(o_totalprice AS {D}) + 1 AS {D}) END"


def _advance(t):
    price, rest = money("o_totalprice"), F.col("o_orderkey") % 4
    paid = F.when(rest == 0, price).when(rest == 1, F.lit(100).cast(MONEY)).when(rest == 2, F.lit(0).cast(MONEY)).otherwise((price + 1).cast(MONEY))
    return t.orders.select("o_orderkey", price.alias("grand"), paid.alias("advance"))


@query(f"""SELECT o_orderkey, advance, CASE WHEN advance > 0 AND grand - advance = 0 THEN 'Paid' WHEN advance > 0 AND grand - advance > 0 THEN 'Partially Paid' ELSE 'Unpaid' END AS payment_status
  FROM (SELECT o_orderkey, CAST(o_totalprice AS {D}) AS grand, {_ADVANCE} AS advance FROM orders)""")
def payment_status(t):
    return _advance(t).select("o_orderkey", "advance", status_of(F.col("grand"), F.col("advance")).alias("payment_status"))


@query(f"""SELECT o_orderkey, CAST(greatest(0, grand - advance) AS DECIMAL(18,2)) AS remaining FROM (SELECT o_orderkey, CAST(o_totalprice AS {D}) AS grand, {_ADVANCE} AS advance FROM orders)""")
def printed_totals(t):
    return _advance(t).select("o_orderkey", F.greatest(F.lit(0), F.col("grand") - F.col("advance")).cast("decimal(18,2)").alias("remaining"))


@query(f"""SELECT o_orderkey, grand, advance FROM (SELECT o_orderkey, CAST(o_totalprice AS {D}) AS grand, {_ADVANCE} AS advance FROM orders) WHERE advance > grand""")
def overpayment_guard(t):
    broken = errors(advance__more_than_total=F.col("advance") > F.col("grand"))
    return _advance(t).where(F.size(broken) > 0)


@query(f"""SELECT o_orderkey, CAST(coalesce(paid, 0) AS DECIMAL(18,2)) AS amount_paid, CAST(CAST(o_totalprice AS {D}) - coalesce(paid, 0) AS DECIMAL(18,2)) AS balance_due
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS {D})) AS paid FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON o_orderkey = l_orderkey""")
def invoice_balance(t):
    paid = t.lineitem.where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.sum(money("l_quantity")).alias("paid"))
    got = F.coalesce("paid", F.lit(0).cast(MONEY))
    return t.orders.join(paid, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", got.cast("decimal(18,2)").alias("amount_paid"), (money("o_totalprice") - got).cast("decimal(18,2)").alias("balance_due"))


@query(f"""SELECT o_orderkey, CAST(value + value * rate * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS total_value FROM (SELECT o_orderkey, CAST(o_totalprice AS {D}) AS value,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN 18 WHEN 1 THEN 12.5 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE o_custkey % 29 END AS DECIMAL(5,2)) AS rate FROM orders)""")
def contract_total(t):
    """The value and its tax at the contract's own rate, a text of which the leading number counts; without one there is no tax."""
    n = F.col("o_orderkey") % 5
    text = F.when(n == 0, "18").when(n == 1, "12.5 %").when(n == 3, "none").when(n == 4, F.concat(F.lit(" "), (F.col("o_custkey") % 29).cast("string")))
    rate = F.coalesce(leading_number(text), F.lit(0)).cast("decimal(5,2)")
    value = money("o_totalprice")
    return t.orders.select("o_orderkey", (value + value * rate / 100).cast("decimal(18,2)").alias("total_value"))


@query(f"""SELECT o_orderkey, CAST(advance + coalesce(paid, 0) AS DECIMAL(18,2)) AS amount_paid, CAST(total - (advance + coalesce(paid, 0)) AS DECIMAL(18,2)) AS balance_due, coalesce(n, 0) AS n_payments
  FROM (SELECT o_orderkey, CAST(o_totalprice AS {D}) AS total, CASE WHEN o_orderstatus = 'P' THEN CAST(100 AS {D}) ELSE CAST(0 AS {D}) END AS advance FROM orders)
  LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag <> 'N' THEN CAST(l_extendedprice AS {D}) ELSE 0 END) AS paid FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON o_orderkey = l_orderkey""")
def payments_onto_invoices(t):
    """Every payment is added to what its invoice has had; the balance follows from the total. A payment without an amount adds 0."""
    invoices = t.orders.select("o_orderkey", money("o_totalprice").alias("total_amount"), F.when(F.col("o_orderstatus") == "P", 100).otherwise(0).cast(MONEY).alias("amount_paid"))
    payments = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "N", money("l_extendedprice")).alias("amount"))
    return apply_payments(invoices, payments, "o_orderkey").select("o_orderkey", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("amount_paid", "balance_due")], "n_payments")


@query(f"SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS {D})) AS DECIMAL(18,2)) AS amount, count(*) AS n FROM lineitem GROUP BY 1")
def payment_rollup(t):
    return t.lineitem.groupBy("l_returnflag").agg(total(money("l_extendedprice")).alias("amount"), F.count("*").alias("n"))


@query(f"SELECT event_type, CAST(sum(coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS {D}), 0)) AS DECIMAL(18,2)) AS amount FROM events GROUP BY 1")
def sum_of_texts(t):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.get_json_object("props", "$.k"))
    return t.events.groupBy("event_type").agg(total(F.coalesce(text.try_cast(MONEY), F.lit(0).cast(MONEY))).alias("amount"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 12.0 WHEN event_id % 3 = 1 THEN 3.5 ELSE 0.0 END AS number FROM (SELECT event_id FROM events)")
def number_prefixes(t):
    text = F.when(F.col("event_id") % 3 == 0, "12abc").when(F.col("event_id") % 3 == 1, " 3.5 kg").otherwise("abc")
    return t.events.select("event_id", leading_number(text).alias("number"))


@query(f"""SELECT o_orderkey, coalesce(l_partkey, -1) AS item, CAST(coalesce(CAST(l_extendedprice AS {D}), CAST(o_totalprice AS {D})) AS {D}) AS amount
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'""")
def default_child_line(t):
    items = t.lineitem.where("l_returnflag = 'R'")
    joined = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("l_partkey", F.lit(-1)).alias("item"), F.coalesce(money("l_extendedprice"), money("o_totalprice")).cast(MONEY).alias("amount"))


_DIGITS = "regexp_replace(regexp_replace({}, '[^0-9]', '', 'g'), '^0+', '')"
_LENIENT = "CASE WHEN length(d) = 10 THEN '91' || d WHEN length(d) = 12 AND starts_with(d, '91') THEN d WHEN length(d) > 10 THEN '91' || right(d, 10) END"


@query(f"""SELECT event_id, {_LENIENT} AS phone FROM (SELECT event_id, {_DIGITS.format("coalesce(CASE WHEN event_id % 7 = 0 THEN '+91 98765-' || lpad(CAST(event_id AS VARCHAR), 5, '0') END, c_phone, o_phone)")} AS d
  FROM events LEFT JOIN (SELECT c_custkey, '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS c_phone FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey
  LEFT JOIN (SELECT s_suppkey, '0044' || lpad(CAST(s_suppkey AS VARCHAR), 10, '7') AS o_phone FROM supplier) ON user_id = s_suppkey)""")
def resolve_phone(t):
    by_customer = t.customer.where("c_acctbal > 0").select("c_custkey", F.concat(F.lit("98"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("c_phone"))
    by_order = t.supplier.select("s_suppkey", F.concat(F.lit("0044"), F.lpad(F.col("s_suppkey").cast("string"), 10, "7")).alias("o_phone"))
    given = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("+91 98765-"), F.lpad(F.col("event_id").cast("string"), 5, "0")))
    joined = t.events.join(by_customer, F.col("user_id") == F.col("c_custkey"), "left").join(by_order, F.col("user_id") == F.col("s_suppkey"), "left")
    return joined.select("event_id", phone_lenient(F.coalesce(given, "c_phone", "o_phone")).alias("phone"))
