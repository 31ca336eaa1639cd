"""Maintenance contracts, their visits and issues."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoploom.functions.exprs import bar, event_class as class_of, mapped, percent, truthy_or, weekday_letter
from shoploom.operators.relational import days, nest_children, on_spine, running_number, top_per_key, unpivoted
from shoploom.operators.scale import nest_in_parts

from .filters import AS_OF
from .registry import query

WEEK = ("1998-06-09", AS_OF)
_NEST = "CAST(to_json(list(struct_pack({0}) ORDER BY {1})) AS VARCHAR)"


@query("""WITH v AS (SELECT l_orderkey, CAST(to_json(list(struct_pack(l_linenumber := l_linenumber, l_partkey := l_partkey, l_suppkey := l_suppkey) ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC)) AS VARCHAR) AS visits FROM lineitem GROUP BY 1),
  i AS (SELECT l_orderkey, CAST(to_json(list(struct_pack(l_suppkey := l_suppkey, l_linestatus := l_linestatus) ORDER BY l_suppkey, l_linestatus)) AS VARCHAR) AS issues FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linestatus FROM lineitem) GROUP BY 1),
  e AS (SELECT user_id, CAST(to_json(list(struct_pack(event_id := event_id, event_type := event_type) ORDER BY event_id, event_type)) AS VARCHAR) AS timeline FROM events GROUP BY 1)
  SELECT o_orderkey, coalesce(visits, '[]') AS visits, coalesce(issues, '[]') AS issues, coalesce(timeline, '[]') AS timeline
  FROM orders LEFT JOIN v ON v.l_orderkey = o_orderkey LEFT JOIN i ON i.l_orderkey = o_orderkey LEFT JOIN e ON user_id = o_orderkey""")
def contract_detail_nested(t):
    """Both lists of the visits come from one grouping, gathered before the join."""
    visits, issues = F.struct("l_linenumber", "l_partkey", "l_suppkey"), F.struct("l_suppkey", "l_linestatus")
    own = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(visits), asc=False).alias("visits"), F.sort_array(F.collect_set(issues)).alias("issues"))
    df = t.orders.select("o_orderkey").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    df = nest_children(df, t.events, "o_orderkey", "user_id", ["event_id", "event_type"], "timeline")
    return df.select("o_orderkey", *[F.coalesce(F.to_json(c), F.lit("[]")).alias(c) for c in ("visits", "issues", "timeline")])


@query("""SELECT o_orderkey, coalesce(v, '[]') AS visits FROM orders LEFT JOIN (
  SELECT l_orderkey, CAST(to_json(list(struct_pack(d := d, l_linenumber := l_linenumber, l_partkey := l_partkey) ORDER BY d DESC, l_linenumber DESC, l_partkey DESC)) AS VARCHAR) AS v FROM (
    SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS d, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem)
  WHERE r <= 5 GROUP BY 1) ON o_orderkey = l_orderkey""")
def contract_recent_visits_top5(t):
    order = [F.col(c).desc_nulls_first() for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]
    last = top_per_key(t.lineitem, ["l_orderkey"], order, 5).withColumn("d", F.date_format("l_shipdate", "yyyy-MM-dd"))
    nested = nest_children(t.orders.select("o_orderkey"), last, "o_orderkey", "l_orderkey", ["d", "l_linenumber", "l_partkey"], "visits", descending=True)
    return nested.withColumn("visits", F.to_json("visits"))


@query("""SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS completed,
  count(*) FILTER (WHERE l_linestatus = 'O' OR l_returnflag = 'R') AS pending FROM lineitem GROUP BY 1""")
def contract_visit_counts(t):
    status = F.col("l_linestatus")
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(status == "F").alias("completed"), F.count_if((status == "O") | (F.col("l_returnflag") == "R")).alias("pending"))


@query(f"""SELECT l_suppkey, count(*) AS visits, count(*) FILTER (WHERE l_linestatus = 'F') AS completed FROM lineitem
  WHERE CAST(l_shipdate AS DATE) >= DATE '{AS_OF}' - INTERVAL 3 MONTH GROUP BY 1 ORDER BY completed DESC, l_suppkey LIMIT 10""")
def engineer_performance(t):
    recent = t.lineitem.where(F.to_date("l_shipdate") >= F.add_months(F.lit(AS_OF).cast("date"), -3))
    by = recent.groupBy("l_suppkey").agg(F.count("*").alias("visits"), F.count_if(F.col("l_linestatus") == "F").alias("completed"))
    return by.orderBy(F.col("completed").desc(), "l_suppkey").limit(10)


@query(f"""SELECT strftime(l_shipdate, '%Y-%b') AS month, count(*) AS n FROM lineitem
  WHERE CAST(l_shipdate AS DATE) >= DATE '{AS_OF}' - INTERVAL 12 MONTH GROUP BY year(l_shipdate), month(l_shipdate), 1 ORDER BY year(l_shipdate), month(l_shipdate)""")
def monthly_visits(t):
    recent = t.lineitem.where(F.to_date("l_shipdate") >= F.add_months(F.lit(AS_OF).cast("date"), -12))
    by = recent.groupBy(F.date_format("l_shipdate", "yyyy-MMM").alias("month"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"))
    return by.agg(F.count("*").alias("n")).orderBy("y", "m").select("month", "n")


@query(f"""WITH d AS (SELECT CAST(unnest(generate_series(DATE '{WEEK[0]}', DATE '{WEEK[1]}', INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT CAST(day AS VARCHAR) AS day, ['M','T','W','T','F','S','S'][isodow(day)] AS label, (SELECT count(*) FROM lineitem WHERE CAST(l_shipdate AS DATE) = day) AS visits FROM d""")
def weekly_visits(t):
    day = F.to_date("l_shipdate")
    counts = t.lineitem.where(day.between(*[F.lit(d).cast("date") for d in WEEK])).groupBy(day.alias("day")).agg(F.count("*").alias("visits"))
    return on_spine(days(t.spark, *WEEK), counts, "visits").select(F.col("day").cast("string").alias("day"), weekday_letter(F.col("day")).alias("label"), "visits")


@query(f"""SELECT o_orderkey, CAST(renewal AS VARCHAR) AS renewal FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS renewal FROM orders)
  WHERE renewal IS NOT NULL AND renewal BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30 ORDER BY renewal, o_orderkey""")
def upcoming_renewals(t):
    as_of = F.lit(AS_OF).cast("date")
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("renewal"))
    return df.where(F.col("renewal").isNotNull() & F.col("renewal").between(as_of, F.date_add(as_of, 30))).orderBy("renewal", "o_orderkey").withColumn("renewal", F.col("renewal").cast("string"))


_CONTRACTS = "(SELECT *, CAST(o_orderdate AS DATE) AS renewal_date FROM orders WHERE o_orderpriority <> '5-LOW')"
_VISITS = "(SELECT *, CAST(l_shipdate AS DATE) AS visit_date FROM lineitem WHERE l_returnflag <> 'R')"
_ISSUES = "(SELECT * FROM events WHERE value >= 5)"
_ENGINEERS = f"""SELECT l_suppkey AS engineer, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS completed FROM {_VISITS} WHERE visit_date >= DATE '{AS_OF}' - INTERVAL 3 MONTH
  GROUP BY 1 ORDER BY completed DESC, engineer LIMIT 10"""
_MONTHS = f"""SELECT strftime(visit_date, '%Y-%m') AS sort, strftime(visit_date, '%Y-%b') AS month, count(*) AS n FROM {_VISITS} WHERE visit_date >= DATE '{AS_OF}' - INTERVAL 12 MONTH GROUP BY 1, 2"""


@query(f"""SELECT (SELECT count(*) FROM {_CONTRACTS}) AS total_contracts, (SELECT count(*) FROM {_CONTRACTS} WHERE o_orderstatus = 'O') AS active_contracts,
  (SELECT count(*) FROM {_CONTRACTS} WHERE o_orderstatus = 'F') AS expired_contracts,
  (SELECT count(*) FROM {_CONTRACTS} WHERE renewal_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30) AS renewals,
  (SELECT count(*) FROM {_VISITS} WHERE visit_date = DATE '{AS_OF}') AS visits_today,
  (SELECT count(*) FROM {_VISITS} WHERE l_linestatus = 'F') AS completed_visits, (SELECT count(*) FROM {_VISITS} WHERE l_linestatus = 'O') AS pending_visits,
  (SELECT count(*) FROM {_ISSUES} WHERE event_type = 'error') AS open_issues, (SELECT count(*) FROM {_ISSUES} WHERE event_type = 'purchase') AS closed_issues,
  (SELECT string_agg(month || '=' || n, '; ' ORDER BY sort) FROM ({_MONTHS})) AS monthly_visits,
  (SELECT string_agg(engineer || '=' || completed || '/' || total, '; ' ORDER BY completed DESC, engineer) FROM ({_ENGINEERS})) AS engineers,
  (SELECT string_agg(o_orderstatus || '=' || n, '; ' ORDER BY o_orderstatus) FROM (SELECT o_orderstatus, count(*) AS n FROM {_CONTRACTS} GROUP BY 1)) AS contract_statuses,
  (SELECT string_agg(event_type || '=' || n, '; ' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM {_ISSUES} GROUP BY 1)) AS issue_statuses""")
def amc_dashboard(t):
    """All thirteen measures over active rows: one grouping of contracts, of issues and of visits each."""
    as_of = F.lit(AS_OF).cast("date")
    visits = t.lineitem.where("l_returnflag <> 'R'").withColumn("visit_date", F.to_date("l_shipdate"))
    sums = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias(name)
    pairs = lambda key, name, text="n": F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*key, text))), lambda e: F.concat(e[key[-1]].cast("string"), F.lit("="), e[text].cast("string"))), "; ").alias(name)

    by_status = t.orders.where("o_orderpriority <> '5-LOW'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.to_date("o_orderdate").between(as_of, F.date_add(as_of, 30))).alias("due"))
    status = F.col("o_orderstatus")
    contracts = by_status.agg(F.sum("n").alias("total_contracts"), sums(status == "O", "active_contracts"), sums(status == "F", "expired_contracts"), F.sum("due").alias("renewals"), pairs(["o_orderstatus"], "contract_statuses"))

    # visits in one pass, by month and by engineer; of each no more than a few rows go on
    line, recent = F.col("l_linestatus"), F.col("visit_date") >= F.add_months(as_of, -12)
    late = F.col("visit_date") >= F.add_months(as_of, -3)
    visits = visits.withColumn("month", F.when(recent, F.trunc("visit_date", "month")))
    both = visits.groupingSets([["month"], ["l_suppkey"]], "month", "l_suppkey").agg(
        F.grouping_id().alias("set"), F.count("*").alias("n"), F.count_if(F.col("visit_date") == as_of).alias("today"), F.count_if(line == "F").alias("done"), F.count_if(line == "O").alias("open"),
        F.count_if(late).alias("late"), F.count_if(late & (line == "F")).alias("late_done"),
    )
    rank = F.row_number().over(Window.partitionBy("set", "month").orderBy((F.col("late") > 0).desc(), F.col("late_done").desc(), "l_suppkey"))
    few = both.withColumn("rank", rank).where("rank <= 10")  # every month is a row of its own
    of_month, of_engineer = F.col("set") == 1, (F.col("set") != 1) & (F.col("late") > 0)
    total = lambda c, name: F.coalesce(F.sum(F.when(of_month, F.col(c))), F.lit(0)).alias(name)
    listed = lambda when, entry, text, name: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, entry))), text), "; ").alias(name)
    months = listed(of_month & F.col("month").isNotNull(), F.struct("month", "n"), lambda e: F.concat(F.date_format(e.month, "yyyy-MMM"), F.lit("="), e.n.cast("string")), "monthly_visits")
    best = listed(of_engineer, F.struct("rank", "l_suppkey", "late_done", "late"), lambda e: F.concat(e.l_suppkey.cast("string"), F.lit("="), e.late_done.cast("string"), F.lit("/"), e.late.cast("string")), "engineers")
    visited = few.agg(total("today", "visits_today"), total("done", "completed_visits"), total("open", "pending_visits"), months, best)

    by_type, kind = t.events.where("value >= 5").groupBy("event_type").agg(F.count("*").alias("n")), F.col("event_type")
    issues = by_type.agg(sums(kind == "error", "open_issues"), sums(kind == "purchase", "closed_issues"), pairs(["event_type"], "issue_statuses"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  each side is one row
    return reduce(lambda a, b: a.join(b, "one"), map(one, (contracts, visited, issues))).drop("one")


@query("SELECT o_orderpriority AS contract_type, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def contracts_by_type(t):
    return t.orders.where("o_orderstatus <> 'P'").groupBy(F.col("o_orderpriority").alias("contract_type")).agg(F.count("*").alias("n"))


_UNION = """SELECT l_linestatus AS status, CASE WHEN l_quantity > 30 THEN 'High' WHEN l_quantity > 15 THEN 'Medium' ELSE 'Low' END AS priority FROM lineitem
  UNION ALL SELECT CASE event_type WHEN 'click' THEN 'F' ELSE 'O' END, 'Critical' FROM events"""


def _issues(t):
    q = F.col("l_quantity")
    own = t.lineitem.select(F.col("l_linestatus").alias("status"), F.when(q > 30, "High").when(q > 15, "Medium").otherwise("Low").alias("priority"))
    reported = t.events.select(F.when(F.col("event_type") == "click", "F").otherwise("O").alias("status"), F.lit("Critical").alias("priority"))
    return own.unionByName(reported)


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'F') AS resolved, count(*) FILTER (WHERE priority IN ('High', 'Critical')) AS high,
  count(*) FILTER (WHERE priority = 'Medium') AS medium, count(*) FILTER (WHERE priority = 'Low') AS low,
  CAST(round(count(*) FILTER (WHERE status = 'F') * 100.0 / count(*)) AS BIGINT) AS completion FROM ({_UNION})""")
def report_metrics(t):
    p, done = F.col("priority"), F.count_if(F.col("status") == "F")
    return _issues(t).agg(
        F.count("*").alias("total"), done.alias("resolved"), F.count_if(p.isin("High", "Critical")).alias("high"), F.count_if(p == "Medium").alias("medium"), F.count_if(p == "Low").alias("low"),
        percent(done, F.count("*")).alias("completion"),
    )


@query(f"""WITH c AS (SELECT priority AS label, count(*) AS n FROM ({_UNION}) GROUP BY 1), x AS (SELECT *, CAST(round(n * 100.0 / sum(n) OVER ()) AS BIGINT) AS pct, greatest(max(n) OVER (), 1) AS most FROM c)
  SELECT label, n, pct, repeat('█', CAST(round(pct / 5.0) AS INT)) || repeat('░', 20 - CAST(round(pct / 5.0) AS INT)) AS bar, most FROM x""")
def report_breakdown(t):
    counts = _issues(t).groupBy(F.col("priority").alias("label")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    whole = counts.groupBy("one").agg(F.sum("n").alias("all"), F.greatest(F.max("n"), F.lit(1)).alias("most"))
    df = counts.join(whole, "one").withColumn("pct", percent(F.col("n"), F.col("all")))
    return df.select("label", "n", "pct", bar(F.col("pct")).alias("bar"), "most")


_VISIT_STATUS = "CASE WHEN l_linestatus = 'F' THEN 'Completed' WHEN l_returnflag = 'R' THEN 'Cancelled' WHEN l_returnflag = 'N' THEN 'Scheduled' ELSE 'In Progress' END"
_ISSUE_ROWS = """SELECT user_id AS contract, CASE event_type WHEN 'error' THEN 'Open' WHEN 'click' THEN 'In Progress' WHEN 'purchase' THEN 'Resolved' WHEN 'signup' THEN 'Closed' END AS status,
    CASE WHEN value > 200 THEN 'Critical' WHEN value > 100 THEN 'High' WHEN value > 50 THEN 'Medium' WHEN value > 20 THEN 'Low' END AS priority FROM events"""
_METRICS = f"""SELECT o_orderkey, total_visits, completed_visits, CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE total_visits - completed_visits END AS pending_visits, scheduled, cancelled, total_issues, open_issues, in_progress, resolved,
    high, medium, low, CASE WHEN total_visits > 0 THEN CAST(floor(completed_visits * 100 / total_visits + 0.5) AS BIGINT) ELSE 0 END AS completion
  FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 1 THEN 12 ELSE coalesce(v.n, 0) END AS total_visits, CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 3 > 0 THEN o_orderkey % 3 ELSE coalesce(v.completed, 0) END AS completed_visits,
      coalesce(v.scheduled, 0) AS scheduled, coalesce(v.cancelled, 0) AS cancelled, coalesce(i.n, 0) AS total_issues, coalesce(i.opened, 0) AS open_issues, coalesce(i.going, 0) AS in_progress, coalesce(i.resolved, 0) AS resolved,
      coalesce(i.high, 0) AS high, coalesce(i.medium, 0) AS medium, coalesce(i.low, 0) AS low FROM orders
    LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE s = 'Completed') AS completed, count(*) FILTER (WHERE s = 'Scheduled') AS scheduled, count(*) FILTER (WHERE s = 'Cancelled') AS cancelled
      FROM (SELECT l_orderkey, {_VISIT_STATUS} AS s FROM lineitem) GROUP BY 1) v ON l_orderkey = o_orderkey
    LEFT JOIN (SELECT contract, count(*) AS n, count(*) FILTER (WHERE status = 'Open') AS opened, count(*) FILTER (WHERE status = 'In Progress') AS going, count(*) FILTER (WHERE status IN ('Resolved', 'Closed')) AS resolved,
      count(*) FILTER (WHERE priority IN ('High', 'Critical')) AS high, count(*) FILTER (WHERE priority = 'Medium') AS medium, count(*) FILTER (WHERE priority = 'Low') AS low FROM ({_ISSUE_ROWS}) GROUP BY 1) i ON contract = o_orderkey)"""


def _visit_statuses(t):
    line, flag = F.col("l_linestatus"), F.col("l_returnflag")
    status = F.when(line == "F", "Completed").when(flag == "R", "Cancelled").when(flag == "N", "Scheduled").otherwise("In Progress")
    return t.lineitem.select("l_orderkey", "l_shipdate", status.alias("status"))


def _issue_statuses(t):
    kinds, value = {"error": "Open", "click": "In Progress", "purchase": "Resolved", "signup": "Closed"}, F.col("value")
    priority = F.when(value > 200, "Critical").when(value > 100, "High").when(value > 50, "Medium").when(value > 20, "Low")
    return t.events.select("user_id", mapped(F.col("event_type"), kinds).alias("status"), priority.alias("priority"), priority.alias("level"))


def _statuses(*values):
    return F.count_if(F.col("status").isin(*values))


def _visit_counts():
    return F.count("*").alias("v"), _statuses("Completed").alias("done"), _statuses("Scheduled").alias("scheduled"), _statuses("Cancelled").alias("cancelled")


def _issue_counts():
    of = lambda *values: F.count_if(F.col("level").isin(*values))
    return (
        F.count("*").alias("total_issues"), _statuses("Open").alias("open_issues"), _statuses("In Progress").alias("in_progress"), _statuses("Resolved", "Closed").alias("resolved"),
        of("High", "Critical").alias("high"), of("Medium").alias("medium"), of("Low").alias("low"),
    )


def _figures(counted, *kept):
    """The figures of each contract's report; counters stored with the contract win over counted rows unless they are null or 0."""
    key = F.col("o_orderkey")
    zero = lambda c: F.coalesce(c, F.lit(0))
    stored = F.when(key % 5 == 1, 12), F.when(key % 5 == 1, key % 3), F.when(F.col("o_custkey") % 7 == 0, 2)
    df = counted.withColumns({"total_visits": truthy_or(stored[0], zero("v")), "completed_visits": truthy_or(stored[1], zero("done"))})
    df = df.withColumns({"pending_visits": truthy_or(stored[2], F.col("total_visits") - F.col("completed_visits")), "completion": percent(F.col("completed_visits"), F.col("total_visits"))})
    counts = ("scheduled", "cancelled", "total_issues", "open_issues", "in_progress", "resolved", "high", "medium", "low")
    return df.select("o_orderkey", "total_visits", "completed_visits", "pending_visits", "completion", *[zero(c).alias(c) for c in counts], *kept)


def _metrics(t):
    visits = _visit_statuses(t).groupBy("l_orderkey").agg(*_visit_counts())
    issues = _issue_statuses(t).groupBy("user_id").agg(*_issue_counts())
    key = F.col("o_orderkey")
    return _figures(t.orders.join(visits, F.col("l_orderkey") == key, "left").join(issues, F.col("user_id") == key, "left"))


@query(_METRICS)
def contract_report_metrics(t):
    return _metrics(t)


_BAR = "repeat('█', least(20, CAST(floor(pct / 5.0 + 0.5) AS INT))) || repeat('░', greatest(0, 20 - CAST(floor(pct / 5.0 + 0.5) AS INT)))"


def _rows_sql(labels, most):
    rows = " UNION ALL ".join(f"SELECT o_orderkey, '{label}' AS label, {c} AS n, {most} AS most FROM m" for c, label in labels.items())
    return f"WITH m AS ({_METRICS}), r AS ({rows}), p AS (SELECT *, CAST(floor(n * 100 / most + 0.5) AS BIGINT) AS pct FROM r) SELECT o_orderkey, label, n, pct, {_BAR} AS bar FROM p"


_PROGRESS = {"completed_visits": "Completed Visits", "pending_visits": "Pending Visits", "scheduled": "Scheduled Visits", "total_visits": "Total Visits"}
_PRIORITY = {"high": "High / Critical", "medium": "Medium", "low": "Low"}


def _report_rows(df, labels, most):
    """Columns turned into rows with their share of the greatest value and a bar."""
    rows = unpivoted(df.select("o_orderkey", *labels, F.greatest(most, F.lit(1)).alias("most")), "label", "n", **labels)
    rows = rows.withColumn("pct", percent(F.col("n"), F.col("most")))
    return rows.select("o_orderkey", "label", "n", "pct", bar(F.col("pct")).alias("bar"))


@query(_rows_sql(_PROGRESS, "greatest(total_visits, 1)"))
def report_progress_rows(t):
    return _report_rows(_metrics(t), _PROGRESS, F.col("total_visits"))


@query(_rows_sql(_PRIORITY, "greatest(high, medium, low, 1)"))
def report_priority_rows(t):
    return _report_rows(_metrics(t), _PRIORITY, F.greatest("high", "medium", "low"))


_SHEET_MONTHS = """SELECT NULL::BIGINT AS contract, 'trend' AS sheet, strftime(l_shipdate, '%Y-%m') AS label, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS part FROM lineitem GROUP BY 3"""
_SHEET_ISSUES = f"""SELECT NULL::BIGINT, 'issues', coalesce(priority, 'none'), count(*), count(*) FILTER (WHERE status IN ('Resolved', 'Closed')) FROM ({_ISSUE_ROWS}) GROUP BY 3"""


def _sheet_sql(sheet, labels, most):
    return " UNION ALL ".join(f"SELECT o_orderkey, '{sheet}', '{label}', {c}, {most} FROM m" for c, label in labels.items())


_SUMMARY = {"total_visits": "Visits", "completed_visits": "Completed", "total_issues": "Issues", "open_issues": "Open"}


@query(f"""WITH m AS ({_METRICS}), rows AS ({_SHEET_MONTHS} UNION ALL {_SHEET_ISSUES} UNION ALL {_sheet_sql("summary", _SUMMARY, "NULL::BIGINT")}
    UNION ALL {_sheet_sql("progress", _PROGRESS, "greatest(total_visits, 1)")} UNION ALL {_sheet_sql("priority", _PRIORITY, "greatest(high, medium, low, 1)")})
  SELECT contract, sheet, label, n, part, CASE WHEN sheet IN ('trend', 'issues') THEN CAST(floor(part * 100 / n + 0.5) AS BIGINT) WHEN part IS NOT NULL THEN CAST(floor(n * 100 / part + 0.5) AS BIGINT) END AS pct FROM rows""")
def report_sheets(t):
    """The five sheets of the report as rows of one table: each of the three tables is read once for all of them.

    Visits are grouped by contract and by month in one pass with grouping sets, issues by
    contract and by priority; rows of contracts meet in one join. part is the share of the
    whole for the trend and the issues, and the greatest value of a contract's sheet.
    """
    visits = _visit_statuses(t).withColumn("month", F.trunc("l_shipdate", "month"))
    visits = visits.groupingSets([["l_orderkey"], ["month"]], "l_orderkey", "month").agg(F.grouping_id().alias("set"), *_visit_counts())
    issues = _issue_statuses(t).groupingSets([["user_id"], ["priority"]], "user_id", "priority").agg(F.grouping_id().alias("set"), *_issue_counts())
    of_contract = lambda df, key, kind: df.select(F.when(F.col("set") == 1, F.col(key)).alias("contract"), F.when(F.col("set") == 2, kind).alias("label"), "*")
    v, i = of_contract(visits, "l_orderkey", F.date_format("month", "yyyy-MM")), of_contract(issues, "user_id", F.coalesce("priority", F.lit("none")))
    v = v.drop("l_orderkey", "month", "set").withColumn("sheet", F.when(F.col("label").isNotNull(), "trend"))
    i = i.drop("user_id", "priority", "set").withColumn("sheet", F.when(F.col("label").isNotNull(), "issues"))
    # rows of a contract meet under its key, each of the others stays alone under its sheet and label
    facts = t.orders.select(F.col("o_orderkey").alias("contract"), "o_custkey", F.lit(True).alias("known"))
    together = facts.unionByName(v, allowMissingColumns=True).unionByName(i, allowMissingColumns=True)
    counts = [c for c in together.columns if c not in ("contract", "o_custkey", "known", "sheet", "label")]
    one = together.groupBy("contract", "sheet", "label").agg(F.max("o_custkey").alias("o_custkey"), F.max("known").alias("known"), *[F.sum(c).alias(c) for c in counts])
    m = _figures(one.withColumn("o_orderkey", F.col("contract")), "sheet", "label", "known", "v", "done").where("sheet is not null or known")
    row = lambda sheet, label, n, part: F.struct(F.lit(sheet).alias("sheet"), label.alias("label"), n.cast("long").alias("n"), part.cast("long").alias("part"))
    own = lambda sheet, labels, most: [row(sheet, F.lit(text), F.col(c), most) for c, text in labels.items()]
    lists = [*own("summary", _SUMMARY, F.lit(None)), *own("progress", _PROGRESS, F.greatest("total_visits", F.lit(1))), *own("priority", _PRIORITY, F.greatest("high", "medium", "low", F.lit(1)))]
    rows = F.when(F.col("sheet") == "trend", F.array(row("trend", F.col("label"), F.col("v"), F.col("done")))).when(F.col("sheet") == "issues", F.array(row("issues", F.col("label"), F.col("total_issues"), F.col("resolved")))).otherwise(F.array(*lists))
    flat = m.select("o_orderkey", F.explode(rows).alias("r")).select(F.col("o_orderkey").alias("contract"), "r.*")
    n, part = F.col("n"), F.col("part")
    return flat.withColumn("pct", F.when(F.col("sheet").isin("trend", "issues"), percent(part, n)).when(part.isNotNull(), percent(n, part)))


@query("""SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS completed,
  CAST(round(count(*) FILTER (WHERE l_linestatus = 'F') * 100.0 / count(*)) AS BIGINT) AS rate FROM lineitem GROUP BY 1 ORDER BY 1""")
def monthly_trend(t):
    done = F.count_if(F.col("l_linestatus") == "F")
    by = t.lineitem.groupBy(F.trunc("l_shipdate", "month").alias("first")).agg(F.count("*").alias("total"), done.alias("completed"))
    # months are written out once each, not for every visit
    return by.select(F.date_format("first", "yyyy-MM").alias("month"), "total", "completed", percent(F.col("completed"), F.col("total")).alias("rate")).orderBy("month")


@query(f"""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND CAST(o_orderdate AS DATE) = DATE '{AS_OF}') AS today,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND CAST(o_orderdate AS DATE) > DATE '{AS_OF}') AS upcoming,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS completed FROM customer""")
def my_contracts_counts(t):
    day, as_of = F.to_date("o_orderdate"), F.lit(AS_OF).cast("date")
    counts = t.orders.groupBy("o_custkey").agg(F.count_if(day == as_of).alias("today"), F.count_if(day > as_of).alias("upcoming"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"))
    return t.customer.select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey").fillna(0)


@query("""SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS row_no, l_orderkey, l_linenumber, l_partkey,
  CASE l_linestatus WHEN 'F' THEN 100 WHEN 'O' THEN 50 ELSE 0 END AS progress, strftime(l_shipdate, '%d %b %Y') AS visit_date FROM lineitem""")
def visit_history(t):
    """The visits of each contract, numbered; a day of a contract is sorted, not the contract."""
    progress = F.when(F.col("l_linestatus") == "F", 100).when(F.col("l_linestatus") == "O", 50).otherwise(0)
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]
    visits = running_number(t.lineitem.withColumn("day", F.to_date("l_shipdate")), "l_orderkey", "day", order, "row_no")
    return visits.select(F.col("row_no").cast("long").alias("row_no"), "l_orderkey", "l_linenumber", "l_partkey", progress.alias("progress"), F.date_format("l_shipdate", "dd MMM yyyy").alias("visit_date"))


@query("""SELECT engineer, part, count(*) AS n, CAST(to_json(list(struct_pack(day := day, l_orderkey := l_orderkey, l_linenumber := l_linenumber, l_partkey := l_partkey) ORDER BY i)) AS VARCHAR) AS visits FROM (
    SELECT *, (i - 1) // 100 AS part FROM (SELECT l_returnflag AS engineer, strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem)) GROUP BY 1, 2""")
def visits_in_parts(t):
    """The visits of parents that have very many, in lists of at most 100."""
    visits = t.lineitem.select(F.col("l_returnflag").alias("engineer"), "l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_orderkey", "l_linenumber", "l_partkey")
    lists = nest_in_parts(visits, "engineer", "l_shipdate", ["day", "l_orderkey", "l_linenumber", "l_partkey"], "visits", per_row=100)
    return lists.select("engineer", "part", F.size("visits").cast("long").alias("n"), F.to_json("visits").alias("visits"))


@query("""SELECT event_id, CASE WHEN title LIKE '%created%' OR title LIKE '%added%' THEN 'create' WHEN title LIKE '%updated%' OR title LIKE '%modified%' THEN 'update'
  WHEN title LIKE '%completed%' OR title LIKE '%resolved%' THEN 'complete' WHEN title LIKE '%cancelled%' OR title LIKE '%deleted%' THEN 'cancel' ELSE 'other' END AS class
  FROM (SELECT event_id, lower(event_type || CASE event_id % 5 WHEN 0 THEN ' Created' WHEN 1 THEN ' Modified' WHEN 2 THEN ' resolved' WHEN 3 THEN ' DELETED' ELSE '' END) AS title FROM events)""")
def event_class(t):
    words = F.array(*[F.lit(w) for w in (" Created", " Modified", " resolved", " DELETED", "")])
    title = F.concat("event_type", words[(F.col("event_id") % 5).cast("int")])
    return t.events.select("event_id", class_of(title).alias("class"))


@query("""SELECT o_orderkey, count(*) AS joined_rows, count(l.l_orderkey) AS visit_rows FROM orders LEFT JOIN lineitem l ON l.l_orderkey = o_orderkey AND l_returnflag = 'R'
  LEFT JOIN events ON user_id = o_orderkey GROUP BY 1""")
def contract_detail_fanout(t):
    """What a literal join of two lists gives: each visit once for every entry of the timeline."""
    visits = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("v"))
    entries = t.events.groupBy("user_id").agg(F.count("*").alias("e"))
    joined = t.orders.join(visits, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(entries, F.col("o_orderkey") == F.col("user_id"), "left")
    one = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(1))
    return joined.select("o_orderkey", (one("v") * one("e")).alias("joined_rows"), (F.coalesce("v", F.lit(0)) * one("e")).alias("visit_rows"))
