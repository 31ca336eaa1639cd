"""Scalar functions over whole tables: phones, numbers, addresses, digests and checks."""

from pyspark.sql import functions as F

from shoploom.functions import exprs as x
from shoploom.operators.relational import running_number
from shoploom.operators.scale import give_numbers, high_marks

from .registry import query

_RAW = "CASE c_custkey % 6 WHEN 0 THEN '+91-' || lpad(CAST(c_custkey AS VARCHAR), 10, '9') WHEN 1 THEN '0' || lpad(CAST(c_custkey AS VARCHAR), 10, '8') WHEN 2 THEN c_name WHEN 3 THEN '1-202-' || lpad(CAST(c_custkey AS VARCHAR), 8, '5') WHEN 4 THEN NULL ELSE '' END"
_D = f"regexp_replace(regexp_replace({_RAW}, '[^0-9]', '', 'g'), '^0+', '')"


def _raw():
    n, text = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    return (
        F.when(n == 0, F.concat(F.lit("+91-"), F.lpad(text, 10, "9"))).when(n == 1, F.concat(F.lit("0"), F.lpad(text, 10, "8"))).when(n == 2, F.col("c_name"))
        .when(n == 3, F.concat(F.lit("1-202-"), F.lpad(text, 8, "5"))).when(n == 4, F.lit(None)).otherwise("")
    )


@query(f"SELECT c_custkey, CASE WHEN length(d) = 10 THEN '91' || d WHEN length(d) = 12 AND starts_with(d, '91') THEN d END AS phone FROM (SELECT c_custkey, {_D} AS d FROM customer)")
def phone_normalize_strict(t):
    return t.customer.select("c_custkey", x.phone_strict(_raw()).alias("phone"))


@query(f"SELECT c_custkey, CASE WHEN length(d) = 10 THEN '91' || d WHEN length(d) = 12 AND starts_with(d, '91') THEN d WHEN length(d) > 10 THEN '91' || right(d, 10) END AS phone FROM (SELECT c_custkey, {_D} AS d FROM customer)")
def phone_normalize_lenient(t):
    return t.customer.select("c_custkey", x.phone_lenient(_raw()).alias("phone"))


@query(f"SELECT c_custkey, CASE WHEN length(d) = 10 THEN '91' || d ELSE d END AS phone FROM (SELECT c_custkey, regexp_replace({_RAW}, '[\\s\\-+()]', '', 'g') AS d FROM customer)")
def phone_format(t):
    return t.customer.select("c_custkey", x.phone_plain(_raw()).alias("phone"))


@query("""SELECT o_orderkey, 'ORD-' || upper(strftime(o_orderdate, '%Y-%b')) || '-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS order_number
  FROM (SELECT *, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%b') ORDER BY o_orderdate, o_orderkey) AS n FROM orders)""")
def business_numbers(t):
    orders = t.orders.withColumns({"month": F.date_format("o_orderdate", "yyyy-MMM"), "day": F.to_date("o_orderdate")})
    numbered = running_number(orders, "month", "day", [F.col("o_orderdate"), F.col("o_orderkey")])
    return numbered.select("o_orderkey", F.concat(x.number_prefix("ORD", F.col("o_orderdate")), x.padded(F.col("number"))).alias("order_number"))


_STORED = """SELECT o_orderkey, prefix || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS number, o_orderstatus FROM (
    SELECT *, 'AMC-' || upper(strftime(o_orderdate, '%Y-%b')) || '-' AS prefix, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%b') ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderpriority <> '5-LOW') WHERE o_orderstatus <> 'P'"""
_MARKS = f"SELECT regexp_extract(number, '^(.*-)([0-9]+)$', 1) AS prefix, max(CAST(regexp_extract(number, '^(.*-)([0-9]+)$', 2) AS BIGINT)) AS high FROM ({_STORED}) GROUP BY 1"


def _stored_numbers(t):
    """The numbers of contracts, of which those of status P have been deleted since they were given."""
    orders = t.orders.where("o_orderpriority <> '5-LOW'").withColumns({"month": F.date_format("o_orderdate", "yyyy-MMM"), "day": F.to_date("o_orderdate")})
    numbered = running_number(orders, "month", "day", [F.col("o_orderdate"), F.col("o_orderkey")])
    return numbered.where("o_orderstatus <> 'P'").select("o_orderkey", F.concat(x.number_prefix("AMC", F.col("o_orderdate")), x.padded(F.col("number"))).alias("number"))


@query(f"SELECT prefix, high + 1 AS next FROM ({_MARKS})")
def next_number(t):
    """The next number of each prefix and month, behind the highest one that stored numbers show."""
    return high_marks(_stored_numbers(t), "number").select("prefix", (F.col("high") + 1).alias("next"))


@query(f"""SELECT o_orderkey, prefix || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS number FROM (
    SELECT o_orderkey, o.prefix, coalesce(high, 0) + row_number() OVER (PARTITION BY o.prefix ORDER BY o_orderdate, o_orderkey) AS n
    FROM (SELECT *, 'AMC-' || upper(strftime(o_orderdate, '%Y-%b')) || '-' AS prefix FROM orders WHERE o_orderpriority = '5-LOW') o LEFT JOIN ({_MARKS}) m ON o.prefix = m.prefix)""")
def numbers_given(t):
    """New contracts with the numbers behind those that are stored, without a gap and none of them twice."""
    new = t.orders.where("o_orderpriority = '5-LOW'").select("o_orderkey", "o_orderdate", x.number_prefix("AMC", F.col("o_orderdate")).alias("prefix"))
    given, _ = give_numbers(new, "prefix", "o_orderdate", [F.col("o_orderkey")], high_marks(_stored_numbers(t), "number"))
    return given.select("o_orderkey", F.concat("prefix", x.padded(F.col("number"))).alias("number"))


@query("""SELECT s_suppkey, array_to_string(list_filter([s_name, CASE WHEN s_acctbal > 0 THEN n_name ELSE ' ' END, CASE WHEN s_suppkey % 2 = 0 THEN r_name END], lambda p: trim(p) <> ''), ', ') AS address
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def address_line(t):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    parts = [F.col("s_name"), F.when(F.col("s_acctbal") > 0, F.col("n_name")).otherwise(" "), F.when(F.col("s_suppkey") % 2 == 0, F.col("r_name"))]
    return joined.select("s_suppkey", x.joined(", ", *parts).alias("address"))


@query("SELECT c_custkey, sha256(c_name) AS token_hash, c_acctbal >= 0 AS is_valid FROM customer")
def token_hash(t):
    return t.customer.select("c_custkey", F.sha2("c_name", 256).alias("token_hash"), (F.col("c_acctbal") >= 0).alias("is_valid"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_detail_counts(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


def _broken_sql(table, key, given, rules):
    """(key, place, field, message) of the rules that rows break."""
    listed = ", ".join(f"CASE WHEN {bad} THEN struct_pack(field := '{field}', message := '{message}') END" for bad, field, message in rules)
    return f"""SELECT {key}, unnest(range(1, len(e) + 1)) AS place, unnest(e).field AS field, unnest(e).message AS message
      FROM (SELECT {key}, list_filter([{listed}], lambda x: x IS NOT NULL) AS e FROM (SELECT *, {given} FROM {table}))"""


def _blank_sql(c):
    return f"NOT coalesce(regexp_matches({c}, '\\S'), false)"


def _listed(df, key, found):
    return df.select(key, F.posexplode(found).alias("place", "e")).select(key, (F.col("place") + 1).cast("long").alias("place"), "e.field", "e.message")


_TICKET = """CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE p_name END AS customer_name, CASE p_partkey % 5 WHEN 0 THEN '98' WHEN 1 THEN '' END AS primary_phone, CASE p_partkey % 3 WHEN 0 THEN '97' WHEN 1 THEN ' ' END AS customer_phone,
  CASE WHEN p_size > 5 THEN p_type ELSE '' END AS device_type, CASE WHEN p_size % 4 > 0 THEN p_brand END AS brand, CASE WHEN p_size % 6 > 0 THEN p_type END AS model, CASE WHEN p_retailprice > 950 THEN 'Screen' END AS category,
  CASE p_partkey % 4 WHEN 0 THEN 'broken' WHEN 1 THEN '' END AS description, CASE p_partkey % 6 WHEN 0 THEN 'cracked' WHEN 1 THEN ' ' || chr(10) || ' ' END AS issue"""
_TICKET_RULES = [
    (_blank_sql("customer_name"), "customerName", "Customer Name is required"), (f"{_blank_sql('primary_phone')} AND {_blank_sql('customer_phone')}", "primaryPhone", "Phone Number is required"),
    (_blank_sql("device_type"), "deviceType", "Device Type is required"), (_blank_sql("brand"), "brand", "Brand is required"), (_blank_sql("model"), "model", "Model is required"),
    (_blank_sql("category"), "issueCategory", "Issue Category is required"), (f"{_blank_sql('description')} AND {_blank_sql('issue')}", "problemDescription", "Problem Description is required"),
]


@query(_broken_sql("part", "p_partkey", _TICKET, _TICKET_RULES))
def validation_report(t):
    """What each ticket lacks, as rows of field and message in the order of the rules."""
    n = lambda k: F.col("p_partkey") % k
    size = F.col("p_size")
    found = x.ticket_errors(
        F.when(n(7) == 1, "  ").when(n(7) > 1, F.col("p_name")), F.when(n(5) == 0, "98").when(n(5) == 1, ""), F.when(n(3) == 0, "97").when(n(3) == 1, " "),
        F.when(size > 5, F.col("p_type")).otherwise(""), F.when(size % 4 > 0, F.col("p_brand")), F.when(size % 6 > 0, F.col("p_type")), F.when(F.col("p_retailprice") > 950, "Screen"),
        F.when(n(4) == 0, "broken").when(n(4) == 1, ""), F.when(n(6) == 0, "cracked").when(n(6) == 1, " \n "),
    )
    return _listed(t.part, "p_partkey", found)


@query(_broken_sql("customer", "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS name, CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '98' END AS phone",
    [(_blank_sql("name"), "name", "Customer name is required"), (_blank_sql("phone"), "phone", "Phone number is required")]))
def customer_validation(t):
    n = lambda k: F.col("c_custkey") % k
    return _listed(t.customer, "c_custkey", x.customer_errors(F.when(n(4) == 0, "").when(n(4) > 1, F.col("c_name")), F.when(n(3) == 0, " ").when(n(3) == 1, "98")))


@query(_broken_sql("(SELECT * FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)", "o_orderkey", "1 AS one",
    [(_blank_sql("c_name"), "customerName", "Customer name is required"), ("coalesce(items, 0) = 0", "items", "At least one invoice item is required")]))
def invoice_validation(t):
    """Invoices without a name or without items; an order without line items has none, one whose items are all left out an empty list."""
    items = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("items"))
    named = t.orders.join(t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return _listed(named, "o_orderkey", x.invoice_errors(F.col("c_name"), F.col("items")))


_CONTRACT = """CASE WHEN o_orderkey % 9 > 0 THEN 'Company' ELSE ' ' END AS company, CASE o_orderkey % 5 WHEN 0 THEN '+91 (98) 123-4567' WHEN 1 THEN '12a' WHEN 2 THEN '' WHEN 3 THEN '123456' END AS mobile,
  CASE o_orderkey % 6 WHEN 0 THEN 'a@b.co' WHEN 1 THEN 'a@b' WHEN 2 THEN 'a b@c.de' WHEN 3 THEN '' WHEN 4 THEN '@x.y' END AS email, CASE WHEN o_orderkey % 8 > 0 THEN CAST(o_orderdate AS DATE) END AS start,
  CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT) - 1 END AS finish, CASE o_orderkey % 5 WHEN 0 THEN '-1' WHEN 1 THEN '12.50' WHEN 2 THEN 'x' WHEN 3 THEN '' END AS worth,
  CASE o_orderkey % 4 WHEN 0 THEN '18' WHEN 1 THEN '100.5' WHEN 2 THEN '-0.1' END AS gst, CASE o_orderstatus WHEN 'F' THEN 'Basic' WHEN 'O' THEN 'Gold' END AS kind, CASE o_orderpriority WHEN '5-LOW' THEN 'Yearly' WHEN '1-URGENT' THEN 'Weekly' ELSE '' END AS cycle"""
_CONTRACT_RULES = [
    (_blank_sql("company"), "companyName", "Company name is required"), ("mobile <> '' AND NOT regexp_matches(mobile, '^[+]?[0-9\\s()-]{7,20}$')", "mobile", "Invalid mobile number format"),
    ("email <> '' AND NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')", "email", "Invalid email format"), ("start IS NULL", "startDate", "Start date is required"), ("finish IS NULL", "endDate", "End date is required"),
    ("finish <= start", "endDate", "End date must be after start date"), ("worth <> '' AND coalesce(TRY_CAST(worth AS DOUBLE), -1) < 0", "contractValue", "Contract value must be a positive number"),
    ("gst <> '' AND NOT coalesce(TRY_CAST(gst AS DOUBLE), -1) BETWEEN 0 AND 100", "gstPercentage", "GST percentage must be between 0 and 100"),
    ("kind NOT IN ('Basic', 'Standard', 'Premium', 'Comprehensive', 'Custom')", "contractType", "Invalid contract type. Must be one of: Basic, Standard, Premium, Comprehensive, Custom"),
    ("cycle <> '' AND cycle NOT IN ('Monthly', 'Quarterly', 'Half-Yearly', 'Yearly', 'One-Time')", "billingCycle", "Invalid billing cycle. Must be one of: Monthly, Quarterly, Half-Yearly, Yearly, One-Time"),
]


@query(_broken_sql("orders", "o_orderkey", _CONTRACT, _CONTRACT_RULES))
def contract_validation(t):
    n = lambda k: F.col("o_orderkey") % k
    day, status, priority = F.to_date("o_orderdate"), F.col("o_orderstatus"), F.col("o_orderpriority")
    found = x.contract_errors(
        F.when(n(9) > 0, "Company").otherwise(" "), F.when(n(5) == 0, "+91 (98) 123-4567").when(n(5) == 1, "12a").when(n(5) == 2, "").when(n(5) == 3, "123456"),
        F.when(n(6) == 0, "a@b.co").when(n(6) == 1, "a@b").when(n(6) == 2, "a b@c.de").when(n(6) == 3, "").when(n(6) == 4, "@x.y"), F.when(n(8) > 0, day), F.when(n(7) > 0, F.date_add(day, (n(4) - 1).cast("int"))),
        F.when(n(5) == 0, "-1").when(n(5) == 1, "12.50").when(n(5) == 2, "x").when(n(5) == 3, ""), F.when(n(4) == 0, "18").when(n(4) == 1, "100.5").when(n(4) == 2, "-0.1"),
        F.when(status == "F", "Basic").when(status == "O", "Gold"), F.when(priority == "5-LOW", "Yearly").when(priority == "1-URGENT", "Weekly").otherwise(""),
    )
    return _listed(t.orders, "o_orderkey", found)


@query("SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS day, ['M','T','W','T','F','S','S'][isodow(o_orderdate)] AS letter, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month FROM orders")
def date_formats(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(d, "dd MMM yyyy").alias("day"), x.weekday_letter(F.to_date(d)).alias("letter"), F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9]', '_', 'g') AS file, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), 'none') AS label, lower(trim(p_type)) AS kind, split_part(p_type, ' ', -1) AS last_word FROM part")
def text_functions(t):
    label = x.or_else(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")), F.lit("none"))
    return t.part.select("p_partkey", x.file_name(F.col("p_name")).alias("file"), label.alias("label"), F.lower(F.trim("p_type")).alias("kind"), F.element_at(F.split("p_type", " "), -1).alias("last_word"))


@query("""SELECT p_partkey, CASE WHEN size IS NULL OR size = 0 THEN 7 ELSE size END AS shown, coalesce(size, 7) AS nullish, CASE WHEN coalesce(name, '') = '' THEN 'none' ELSE name END AS name
  FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN p_size END AS size, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN p_name END AS name FROM part)""")
def truthy_defaults(t):
    """Defaults that stand in for null, 0 and the empty text, beside the one that stands in for null only; the text 0 counts as given."""
    n, m = F.col("p_partkey") % 3, F.col("p_partkey") % 4
    size = F.when(n == 0, 0).when(n == 1, F.col("p_size"))
    name = F.when(m == 0, "").when(m == 1, "0").when(m == 2, F.col("p_name"))
    return t.part.select("p_partkey", x.truthy_or(size, F.lit(7)).alias("shown"), F.coalesce(size, F.lit(7)).alias("nullish"), x.or_else(name, F.lit("none")).alias("name"))


@query("SELECT p_partkey, 'image/png' AS mime, 'png' AS extension, CAST(length(p_name) AS BIGINT) AS n_bytes FROM part")
def data_urls(t):
    url = F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("p_name").cast("binary")))
    found = x.data_url(url)
    return t.part.select("p_partkey", found.mime.alias("mime"), found.extension.alias("extension"), F.octet_length(found.data).cast("long").alias("n_bytes"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN w >= 1000 THEN CAST(w // 1000 AS VARCHAR) || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') ELSE CAST(w AS VARCHAR) END || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS amount
  FROM (SELECT c_custkey, c_acctbal, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS c, CAST(round(abs(c_acctbal) * 100) AS BIGINT) // 100 AS w FROM customer)""")
def rupee_format(t):
    return t.customer.select("c_custkey", x.rupees(F.col("c_acctbal")).alias("amount"))


@query("SELECT s_suppkey, coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END, ''), nullif(n_name, ''), 'Store') AS store_name, coalesce(nullif(n_name, ''), s_name) AS city FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def store_fields(t):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    own = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise("")
    return joined.select("s_suppkey", x.or_else(own, x.or_else(F.col("n_name"), F.lit("Store"))).alias("store_name"), x.or_else(F.col("n_name"), F.col("s_name")).alias("city"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_candidates(t):
    return t.part.select("p_brand", "p_size").distinct()


@query("""SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1998-06-15 00:00:00' AND NOT coalesce(c_acctbal < 0, false)""")
def session_check(t):
    """Sessions that are valid, not expired, and whose user isn't disabled."""
    valid = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > F.lit("1998-06-15 00:00:00").cast("timestamp_ntz"))
    users = t.customer.where(~F.coalesce(F.col("c_acctbal") < 0, F.lit(False)))
    return t.orders.where(valid).join(users, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey")


@query("SELECT conv_id, turn FROM conversations WHERE turn BETWEEN 1 AND 5 AND length(trim(text)) >= 10")
def feedback_validity(t):
    return t.conversations.where(F.col("turn").between(1, 5) & (F.length(F.trim("text")) >= 10)).select("conv_id", "turn")
