"""Ticket reports: key figures, status counts, charts and feeds."""

from pyspark.sql import functions as F

from shoploom.functions.exprs import MONEY, rating_label, truthy_or, weekday_letter
from shoploom.operators.relational import days
from shoploom.operators.scale import running

from .filters import AS_OF
from .registry import query

WEEK = ("1998-06-09", AS_OF)


@query(f"""SELECT count(*) AS total,
  count(*) FILTER (WHERE CAST(o_orderdate AS DATE) = DATE '{AS_OF}') AS new_today,
  count(*) FILTER (WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) = DATE '{AS_OF}') AS completed_today,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS in_progress,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) - count(*) FILTER (WHERE o_orderstatus = 'F') AS open_tickets
  FROM orders""")
def ticket_status_kpis(t):
    status, today = F.col("o_orderstatus"), F.to_date("o_orderdate") == F.lit(AS_OF).cast("date")
    return t.orders.agg(
        F.count("*").alias("total"),
        F.count_if(today).alias("new_today"),
        F.count_if(today & (status == "F")).alias("completed_today"),
        F.count_if(status == "F").alias("completed"),
        F.count_if(status == "O").alias("in_progress"),
        F.count_if(status == "P").alias("pending"),
        (F.count("*") - F.count_if(status == "F")).alias("open_tickets"),
    )


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1")
def issue_status_counts(t):
    return t.lineitem.groupBy(F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS in_progress, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders GROUP BY 1""")
def status_pivot(t):
    pivot = t.orders.groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return pivot.select("priority", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("F", "completed"), ("O", "in_progress"), ("P", "pending"))])


@query("""SELECT o_orderstatus AS status, string_agg(p || '=' || n, '; ' ORDER BY p) AS counts,
  CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def status_count_map(t):
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    by = counts.groupBy(F.col("o_orderstatus").alias("status")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_orderpriority", "n")))).alias("m"))
    entries = F.transform(F.map_entries("m"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return by.select("status", F.array_join(entries, "; ").alias("counts"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))


@query("""SELECT e.event_id, e.ts, e.event_type, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey
  ORDER BY e.ts DESC, e.event_id DESC LIMIT 15""")
def recent_activity(t):
    joined = t.events.join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "ts", "event_type", "c_name")
    return joined.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(15)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC LIMIT 10")
def recent_tickets(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").orderBy(F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc()).limit(10)


@query(f"""WITH d AS (SELECT CAST(unnest(generate_series(DATE '{WEEK[0]}', DATE '{WEEK[1]}', INTERVAL 1 DAY)) AS DATE) AS day),
  o AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS created, (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_orderkey = o_orderkey) AS updated FROM orders)
  SELECT CAST(day AS VARCHAR) AS day, ['M','T','W','T','F','S','S'][isodow(day)] AS label,
    (SELECT count(*) FROM o WHERE created = day) AS opened,
    (SELECT count(*) FROM o WHERE o_orderstatus = 'F' AND updated = day) AS completed,
    (SELECT count(*) FROM o WHERE o_orderstatus = 'O' AND created <= day AND (updated IS NULL OR updated >= day)) AS in_progress
  FROM d""")
def weekly_chart(t):
    """Counts by day as running and plain sums of events; a ticket is two of them at most, whatever the range."""
    return _chart(t, *WEEK).select(F.col("day").cast("string").alias("day"), weekday_letter(F.col("day")).alias("label"), "opened", "completed", "in_progress")


def ticket_events(t, first, last):
    """(o_orderkey, day, opened, completed, change): what changes on a day; change is of the number in progress.

    The first event of a ticket is on the day it is created, or on the first day if it
    stands by then; the second is behind the day it was last updated, or on it, if it is
    completed.
    """
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    created = t.orders.select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("created")).where((F.col("created") <= high) | (F.col("o_orderstatus") == "F"))
    updated = t.lineitem.groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("updated"))
    tickets = created.join(updated, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status, end = F.col("o_orderstatus"), F.coalesce("updated", high)
    begins = F.greatest(F.col("created"), low)
    stands = (status == "O") & (begins <= end)
    event = lambda day, opened, completed, change: F.struct(day.alias("day"), opened.cast("long").alias("opened"), completed.cast("long").alias("completed"), change.cast("long").alias("change"))
    none = F.lit(0)
    opening = event(begins, (F.col("created") >= low), none, stands)
    closing = F.when(status == "F", event(F.col("updated"), none, F.lit(1), none)).when(stands, event(F.date_add(end, 1), none, none, F.lit(-1)))
    within = lambda e: e.isNotNull() & e.day.between(low, high) & ((e.opened != 0) | (e.completed != 0) | (e.change != 0))
    return tickets.select("o_orderkey", F.explode(F.filter(F.array(opening, closing), within)).alias("e")).select("o_orderkey", "e.*")


def _chart(t, first, last):
    changes = ticket_events(t, first, last).groupBy("day").agg(*[F.sum(c).alias(n) for c, n in (("opened", "opened"), ("completed", "completed"), ("change", "in_progress"))])
    return running(days(t.spark, first, last).join(changes, "day", "left").fillna(0), "in_progress")


YEARS = ("1992-01-01", "2001-12-31")


@query(f"""WITH d AS (SELECT CAST(unnest(generate_series(DATE '{YEARS[0]}', DATE '{YEARS[1]}', INTERVAL 1 DAY)) AS DATE) AS day),
  u AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS updated FROM lineitem GROUP BY 1),
  o AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS created, updated FROM orders LEFT JOIN u ON l_orderkey = o_orderkey),
  s AS (SELECT day, count(*) AS n FROM d JOIN o ON o_orderstatus = 'O' AND created <= day AND coalesce(updated, DATE '9999-01-01') >= day GROUP BY 1),
  c AS (SELECT created AS day, count(*) AS n FROM o GROUP BY 1), f AS (SELECT updated AS day, count(*) AS n FROM o WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT CAST(day AS VARCHAR) AS day, coalesce(c.n, 0) AS opened, coalesce(f.n, 0) AS completed, coalesce(s.n, 0) AS in_progress FROM d LEFT JOIN s USING (day) LEFT JOIN c USING (day) LEFT JOIN f USING (day)""")
def daily_chart(t):
    """The weekly chart's counts for every day of ten years, at the cost of one week's."""
    return _chart(t, *YEARS).withColumn("day", F.col("day").cast("string"))


@query("""SELECT o_orderkey, days_valid, CAST(coalesce(finished, CAST(o_orderdate AS DATE)) + days_valid AS VARCHAR) AS warranty_until
  FROM (SELECT *, CAST(CASE o_orderkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 90 WHEN 2 THEN 30 ELSE 365 END AS INT) AS days_valid FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
  LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS finished FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON o_orderkey = l_orderkey""")
def warranty_window(t):
    """The end of the warranty of tickets that have one: their period, else 90 days, from completion, else from creation."""
    finished = t.lineitem.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("finished"))
    n = F.col("o_orderkey") % 4
    period = F.when(n == 1, 0).when(n == 2, 30).when(n == 3, 365)  # null or 0: not given
    covered = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    joined = covered.join(finished, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("days_valid", truthy_or(period, F.lit(90)))
    return joined.select("o_orderkey", "days_valid", F.date_add(F.coalesce("finished", F.to_date("o_orderdate")), F.col("days_valid")).cast("string").alias("warranty_until"))


@query("""SELECT o.o_orderkey, o.o_orderstatus, c.c_name, coalesce(h.n, 0) AS n_history, coalesce(h.history, '[]') AS history FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(to_json(list(struct_pack(l_linenumber := l_linenumber, l_linestatus := l_linestatus) ORDER BY l_linenumber, l_linestatus)) AS VARCHAR) AS history FROM lineitem GROUP BY 1) h ON h.l_orderkey = o.o_orderkey""")
def tracking_document(t):
    history = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.to_json(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_linestatus")))).alias("history"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(history, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "o_orderstatus", "c_name", F.coalesce("n", F.lit(0)).alias("n_history"), F.coalesce("history", F.lit("[]")).alias("history"))


_INVOICES = """SELECT l_orderkey, CAST(to_json(list(struct_pack(invoice_id := 'INV-' || l_partkey, amount_paid := CAST(CAST(l_quantity AS DECIMAL(15,2)) AS VARCHAR), status := l_linestatus) ORDER BY 'INV-' || l_partkey, CAST(CAST(l_quantity AS DECIMAL(15,2)) AS VARCHAR), l_linestatus)) AS VARCHAR) AS invoices
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1"""
_TOKEN = "o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) + 400 > DATE '1998-06-15'"


def _invoices(t):
    """The active invoices of each ticket, as JSON."""
    fields = F.struct(F.concat(F.lit("INV-"), F.col("l_partkey").cast("string")).alias("invoice_id"), F.col("l_quantity").cast(MONEY).cast("string").alias("amount_paid"), F.col("l_linestatus").alias("status"))
    return t.lineitem.where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.to_json(F.sort_array(F.collect_list(fields))).alias("invoices"))


def _valid_tokens(t):
    """Tickets whose link is unused and hasn't expired."""
    as_of = F.lit(AS_OF).cast("date")
    return t.orders.where((F.col("o_orderstatus") != "P") & (F.date_add(F.to_date("o_orderdate"), 400) > as_of))


@query(f"""SELECT o_orderkey, o_orderstatus, c_name, c_mktsegment AS store, coalesce(history, '[]') AS history, coalesce(invoices, '[]') AS invoices FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT user_id, CAST(to_json(list(struct_pack(event_id := event_id, new_status := event_type) ORDER BY event_id)) AS VARCHAR) AS history FROM events GROUP BY 1) ON user_id = o_orderkey
  LEFT JOIN ({_INVOICES}) ON l_orderkey = o_orderkey WHERE {_TOKEN}""")
def tracking_with_invoices(t):
    """The tracking document of every ticket with a valid link: the ticket, its history and its active invoices."""
    history = t.events.groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("event_id", F.col("event_type").alias("new_status"))))).alias("history"))
    joined = _valid_tokens(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(history, F.col("user_id") == F.col("o_orderkey"), "left")
    joined = joined.join(_invoices(t), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    empty = F.lit("[]")
    return joined.select("o_orderkey", "o_orderstatus", "c_name", F.col("c_mktsegment").alias("store"), F.coalesce("history", empty).alias("history"), F.coalesce("invoices", empty).alias("invoices"))


@query(f"""SELECT o_orderkey, c_name, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS total_amount, coalesce(invoices, '[]') AS invoices FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN ({_INVOICES}) ON l_orderkey = o_orderkey WHERE {_TOKEN} AND o_orderstatus = 'F'""")
def collection_document(t):
    """What a customer who collects a finished device is shown."""
    joined = _valid_tokens(t).where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(_invoices(t), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select("o_orderkey", "c_name", F.col("o_totalprice").cast(MONEY).cast("string").alias("total_amount"), F.coalesce("invoices", F.lit("[]")).alias("invoices"))


@query(f"""WITH f AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1)
  SELECT o_orderkey, c_name, trim(coalesce(p_brand, '') || ' ' || coalesce(CASE WHEN p_size % 3 > 0 THEN p_type END, '')) AS device, f.event_id IS NOT NULL AS already_submitted,
    CASE WHEN f.event_id IS NOT NULL THEN f.event_id % 6 END AS rating, CASE f.event_id % 6 WHEN 1 THEN 'Poor' WHEN 2 THEN 'Fair' WHEN 3 THEN 'Good' WHEN 4 THEN 'Very Good' WHEN 5 THEN 'Excellent' END AS label
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON p_partkey = o_orderkey LEFT JOIN f ON f.user_id = o_orderkey WHERE {_TOKEN}""")
def feedback_document(t):
    """The form of each ticket with a valid link, with the feedback that was given already."""
    given = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("given"))
    joined = _valid_tokens(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.part, F.col("p_partkey") == F.col("o_orderkey"), "left").join(given, F.col("user_id") == F.col("o_orderkey"), "left")
    model = F.when(F.col("p_size") % 3 > 0, F.col("p_type"))
    device = F.trim(F.concat_ws(" ", F.coalesce("p_brand", F.lit("")), F.coalesce(model, F.lit(""))))
    rating = F.col("given") % 6
    return joined.select("o_orderkey", "c_name", device.alias("device"), F.col("given").isNotNull().alias("already_submitted"), rating.alias("rating"), rating_label(rating).alias("label"))
