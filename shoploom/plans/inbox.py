"""Conversations: latest messages, the inbox, unread counts and the repair of ids."""

from pyspark.sql import functions as F

from shoploom.functions.exprs import STATUS_TEMPLATES, TEMPLATE_LANGUAGES, any_ilike, conversation_id, conversation_kind as kind_of, digits, mapped, phone_candidates, phone_strict, rating_label, status_event
from shoploom.operators.relational import first_by_affix, keep_first, latest_per_key
from shoploom.operators.scale import TASK_ROWS, changed_rows, join_spread, latest_containing, parts_of

from .registry import query


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def conversation_latest(t):
    return latest_per_key(t.conversations, ["conv_id"], [F.col("turn").desc_nulls_first()]).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def conversation_thread(t):
    return t.conversations.where("conv_id = 3").orderBy(F.col("turn").asc_nulls_last())


@query("SELECT conv_id, count(*) AS unread FROM conversations WHERE role = 'user' AND turn >= 2 GROUP BY 1")
def unread_counts(t):
    return t.conversations.where("role = 'user' and turn >= 2").groupBy("conv_id").agg(F.count("*").alias("unread"))


@query("SELECT * FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user' AND turn >= 4)")
def unread_semi_join(t):
    return t.conversations.join(t.conversations.where("role = 'user' and turn >= 4").select("conv_id"), "conv_id", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_semi_join(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR)")
def cast_key_join(t):
    return t.orders.join(t.customer, F.col("o_custkey").cast("string") == F.col("c_custkey").cast("string"), "left").select("o_orderkey", "c_name")


_INBOX = """SELECT m.conv_id, m.last_match, l.turn AS last_turn, l.role AS last_sender, l.text AS last_text, u.unread, c_name,
    CASE WHEN m.conv_id % 3 = 0 THEN 'order' WHEN m.conv_id % 3 = 1 THEN 'customer' ELSE 'ticket' END AS kind
  FROM (SELECT conv_id, max(turn) AS last_match FROM conversations WHERE text ILIKE '%an%' OR role ILIKE '%an%' GROUP BY 1) m
  JOIN (SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY 1) l USING (conv_id)
  JOIN (SELECT conv_id, count(*) FILTER (WHERE role = 'user' AND turn >= 2) AS unread FROM conversations GROUP BY 1) u USING (conv_id)
  LEFT JOIN customer ON CAST(m.conv_id AS VARCHAR) = CAST(c_custkey AS VARCHAR)"""


@query(_INBOX)
def conversation_inbox(t):
    """One pass over the messages gives the newest match, the newest message and the unread count."""
    matches = any_ilike("an", "text", "role")
    newest = F.max_by(F.struct("turn", "role", "text"), F.col("turn")).alias("last")
    by = t.conversations.groupBy("conv_id").agg(F.max(F.when(matches, F.col("turn"))).alias("last_match"), newest, F.count_if((F.col("role") == "user") & (F.col("turn") >= 2)).alias("unread"))
    number = F.col("conv_id") % 3
    kind = kind_of(F.when(number == 0, F.col("conv_id")), F.when(number == 1, F.lit("cust_1")).otherwise("t"))
    joined = by.where("last_match is not null").join(t.customer, F.col("conv_id").cast("string") == F.col("c_custkey").cast("string"), "left")
    return joined.select("conv_id", "last_match", F.col("last.turn").alias("last_turn"), F.col("last.role").alias("last_sender"), F.col("last.text").alias("last_text"), "unread", "c_name", kind.alias("kind"))


_MAIL = """SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'cust_9198' || lpad(CAST(user_id AS VARCHAR), 8, '0') ELSE 'ticket_' || user_id END AS conversation_id, user_id AS customer_id,
    CASE WHEN event_id % 2 = 0 THEN user_id END AS ticket_id, CASE WHEN event_type = 'purchase' THEN event_id END AS order_id, CASE WHEN event_type IN ('click', 'view') THEN 'Customer' ELSE 'Staff' END AS sender,
    event_type AS type, event_type || ' ' || event_id AS text, value > 3 AS is_read, ts AS created_at FROM events"""


def _mail_sql(where="true", after="true"):
    """The inbox with its lookups as correlated subqueries: the newest message that meets the conditions, of each conversation."""
    last = lambda c: f"(SELECT {c} FROM mail x WHERE x.conversation_id = m.conversation_id ORDER BY created_at DESC, id DESC LIMIT 1)"
    return f"""WITH mail AS ({_MAIL}), picked AS (
      SELECT m.* FROM (SELECT m.*, row_number() OVER (PARTITION BY m.conversation_id ORDER BY m.created_at DESC, m.id DESC) AS n FROM mail m
        LEFT JOIN (SELECT o_orderkey AS t_id, c_name AS t_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey) t ON t_id = ticket_id
        LEFT JOIN (SELECT c_custkey AS c_id, c_name AS c_own FROM customer) c ON CAST(c_id AS VARCHAR) = CAST(customer_id AS VARCHAR)
        LEFT JOIN (SELECT o_orderkey AS o_id, 'ORD-' || o_orderkey AS o_number FROM orders) o ON o_id = order_id WHERE {where}) m WHERE n = 1)
      SELECT * FROM (SELECT conversation_id, customer_id, ticket_id, order_id, created_at AS last_message_at, {last("text")} AS last_text, {last("type")} AS last_type, {last("sender")} AS last_sender,
        (SELECT count(*) FROM mail x WHERE x.conversation_id = m.conversation_id AND NOT is_read AND sender = 'Customer') AS unread_count,
        (SELECT c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = m.ticket_id) AS ticket_customer_name, (SELECT 'ORD-' || o_orderkey FROM orders WHERE o_orderkey = m.order_id) AS order_number,
        (SELECT c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) = CAST(m.customer_id AS VARCHAR)) AS saved_customer_name,
        CASE WHEN order_id IS NOT NULL THEN 'order' WHEN starts_with(conversation_id, 'cust_') THEN 'customer' ELSE 'ticket' END AS conversation_type FROM picked m) WHERE {after}"""


def _mail(t):
    id, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    number = F.concat(F.lit("cust_9198"), F.lpad(user.cast("string"), 8, "0"))
    return t.events.select(
        id.alias("id"), F.when(user % 3 == 0, number).otherwise(F.concat(F.lit("ticket_"), user.cast("string"))).alias("conversation_id"), user.alias("customer_id"), F.when(id % 2 == 0, user).alias("ticket_id"),
        F.when(kind == "purchase", id).alias("order_id"), F.when(kind.isin("click", "view"), "Customer").otherwise("Staff").alias("sender"), kind.alias("type"),
        F.concat(kind, F.lit(" "), id.cast("string")).alias("text"), (F.col("value") > 3).alias("is_read"), F.col("ts").alias("created_at"),
    )


#: Fixed value: parts that a conversation's messages are dealt out to.
_DEALT = 8


def inbox(messages, tickets, orders, customers, search=None, filter=None, customer_id=None, task_rows=TASK_ROWS):
    """One row for each conversation with a message that meets the search and the filter: that message's ids, and the newest text, type and sender.

    messages has id, conversation_id, customer_id, ticket_id, order_id, sender, type, text,
    is_read and created_at; tickets id and customer_name; orders id and order_number;
    customers id and name. filter is unread, tickets, orders, customers or team: the
    conversations with an unread message of a customer; messages of tickets, of orders; by the kind of the
    message found customers and tickets, or customers alone. One grouping gives it all:
    the lookups are joined to conversations, and for a search only those that match to
    messages that have such an id. Messages are grouped in parts of about task_rows, a
    conversation of very many in several; ids that are null are dealt out.
    """
    messages = messages.withColumn("__hit", F.lit(False))
    rows, wanted, parts = messages, ~F.col("__hit"), parts_of(messages, task_rows)
    if search:
        found = [messages.where(any_ilike(search, "conversation_id"))]
        for table, name, key in ((tickets, "customer_name", "ticket_id"), (orders, "order_number", "order_id"), (customers, "name", "customer_id")):
            hits = table.where(any_ilike(search, name)).select(F.col("id").cast("string").alias("__id"))
            keyed = messages.withColumn("__key", F.col(key).cast("string")).where("__key is not null").repartition(parts, "__key")
            found.append(keyed.join(hits, F.col("__key") == F.col("__id"), "left_semi").drop("__key"))
        for part in found:  # a message that meets several is there for each, which its conversation's newest is not changed by
            rows = rows.unionByName(part.withColumn("__hit", F.lit(True)))
        wanted = F.col("__hit")
    if customer_id is not None:
        wanted = wanted & (F.col("customer_id") == customer_id)
    if filter in ("tickets", "orders"):
        wanted = wanted & F.col({"tickets": "ticket_id", "orders": "order_id"}[filter]).isNotNull()
    order = F.struct("created_at", "id")
    own = ~F.col("__hit")
    by = rows.repartition(parts, "conversation_id", F.pmod(F.xxhash64("id"), F.lit(_DEALT))).groupBy("conversation_id").agg(
        F.max_by(F.struct("customer_id", "ticket_id", "order_id", "created_at"), F.when(wanted, order)).alias("found"),
        F.max_by(F.struct("text", "type", "sender"), F.when(own, order)).alias("last"),
        F.count_if(own & ~F.col("is_read") & (F.col("sender") == "Customer")).alias("unread_count"),
    )
    by = by.where("found is not null").withColumn("conversation_type", kind_of(F.col("found.order_id"), F.col("conversation_id")))
    kept = {"unread": F.col("unread_count") > 0, "customers": F.col("conversation_type").isin("customer", "ticket"), "team": F.col("conversation_type") == "customer"}
    by = by.where(kept[filter]) if filter in kept else by
    text = lambda c: F.col(c).cast("string")
    joined = by
    for table, key, name, of in ((tickets, "ticket_id", "customer_name", "ticket_customer_name"), (orders, "order_id", "order_number", "order_number"), (customers, "customer_id", "name", "saved_customer_name")):
        found = table.select(text("id").alias("__id"), F.col(name).alias(of))
        joined = join_spread(joined, found, text(f"found.{key}"), F.col("__id"), F.col("conversation_id")).drop("__id")
    return joined.select(
        "conversation_id", "found.customer_id", "found.ticket_id", "found.order_id", F.col("found.created_at").alias("last_message_at"), F.col("last.text").alias("last_text"), F.col("last.type").alias("last_type"),
        F.col("last.sender").alias("last_sender"), "unread_count", "ticket_customer_name", "order_number", "saved_customer_name", "conversation_type",
    )


def _inbox(t, **wanted):
    tickets = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("customer_name"))
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_number"))
    return inbox(_mail(t), tickets, orders, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), **wanted)


@query(_mail_sql("m.conversation_id IN (SELECT conversation_id FROM mail WHERE NOT is_read AND sender = 'Customer')"))
def inbox_unread(t):
    return _inbox(t, filter="unread")


@query(_mail_sql("m.ticket_id IS NOT NULL"))
def inbox_tickets(t):
    return _inbox(t, filter="tickets")


@query(_mail_sql("m.order_id IS NOT NULL"))
def inbox_orders(t):
    return _inbox(t, filter="orders")


@query(_mail_sql(after="conversation_type IN ('customer', 'ticket')"))
def inbox_customers(t):
    return _inbox(t, filter="customers")


@query(_mail_sql(after="conversation_type = 'customer'"))
def inbox_team(t):
    return _inbox(t, filter="team")


@query(_mail_sql("(m.conversation_id ILIKE '%12%' OR t_name ILIKE '%12%' OR o_number ILIKE '%12%' OR c_own ILIKE '%12%')"))
def inbox_search(t):
    return _inbox(t, search="12")


@query("SELECT * FROM events e WHERE event_type <> 'click' OR user_id IS NULL OR event_id = (SELECT min(event_id) FROM events x WHERE x.event_type = 'click' AND x.user_id = e.user_id)")
def dedup_keep_first(t):
    clicks, others = t.events.where("event_type = 'click'"), t.events.where("not (event_type <=> 'click')")
    return keep_first(clicks, ["user_id", "event_type"], "event_id").unionByName(others)


@query("""SELECT event_id, CASE WHEN regexp_matches(conv, '^[0-9]+$') THEN 'cust_91' || lpad(conv, 10, '0') ELSE conv END AS conversation
  FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'ticket_' || user_id END AS conv FROM events)""")
def id_repair_update(t):
    conv = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("ticket_"), F.col("user_id").cast("string")))
    repaired = F.when(conv.rlike(r"^\d+$"), F.concat(F.lit("cust_91"), F.lpad(conv, 10, "0"))).otherwise(conv)
    return t.events.select("event_id", repaired.alias("conversation"))


@query("""SELECT e.event_id, coalesce(e.own, s.own) AS filled FROM (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN value END AS own FROM events) e
  LEFT JOIN (SELECT user_id, arg_min(value, event_id) AS own FROM events WHERE event_id % 4 = 0 AND value IS NOT NULL GROUP BY 1) s ON e.user_id = s.user_id""")
def sibling_fill(t):
    own = F.when(F.col("event_id") % 4 == 0, F.col("value"))
    df = t.events.select("event_id", "user_id", own.alias("own"))
    first = df.where("own is not null").groupBy("user_id").agg(F.min_by("own", "event_id").alias("sibling"))
    return df.join(first, "user_id", "left").select("event_id", F.coalesce("own", "sibling").alias("filled"))


_STATUSES = ("New", "Pending", "Diagnosed", "Awaiting Approval", "In Progress", "Waiting For Parts", "Awaiting Parts", "Awaiting Payment", "Ready for Pickup", "Completed", "Delivered", "Collected", "Cancelled")


@query("""WITH events_of(status, event, text, description) AS (VALUES
    ('New', 'repair_received', 'Repair Received', 'Device has been received for repair.'),
    ('Diagnosed', 'device_diagnosed', 'Device Diagnosed', 'Device has been diagnosed by technician.'),
    ('Awaiting Approval', 'awaiting_approval', 'Awaiting Approval', 'Estimate sent. Awaiting customer approval.'),
    ('In Progress', 'repair_in_progress', 'Repair In Progress', 'Repair work is in progress.'),
    ('Waiting For Parts', 'parts_ordered', 'Parts Ordered', 'Parts have been ordered for the repair.'),
    ('Completed', 'repair_completed', 'Repair Completed', 'Repair has been completed.'),
    ('Ready for Pickup', 'ready_for_pickup', 'Ready For Pickup', 'Device is ready for pickup.'),
    ('Delivered', 'delivered', 'Delivered', 'Device has been delivered to customer.'),
    ('Collected', 'collected', 'Collected', 'Device has been collected.'),
    ('Cancelled', 'cancelled', 'Cancelled', 'Repair has been cancelled.')),
  templates(status, template, language) AS (VALUES ('Pending', 'ticket_pending', 'en_GB'), ('In Progress', 'ticket_in_progress', 'en'),
    ('Ready for Pickup', 'ticket_ready_for_pickup', 'en_IN'), ('Completed', 'ticket_completed', 'en_GB'), ('Cancelled', 'ticket_cancelled', 'en')),
  named AS (SELECT o_orderkey, ['New', 'Pending', 'Diagnosed', 'Awaiting Approval', 'In Progress', 'Waiting For Parts', 'Awaiting Parts', 'Awaiting Payment', 'Ready for Pickup', 'Completed', 'Delivered', 'Collected', 'Cancelled'][o_orderkey % 13 + 1] AS status FROM orders)
  SELECT o_orderkey, status, event, text, description, template, language FROM named LEFT JOIN events_of USING (status) LEFT JOIN templates USING (status)""")
def status_event_map(t):
    status = F.array(*[F.lit(s) for s in _STATUSES])[(F.col("o_orderkey") % len(_STATUSES)).cast("int")]
    template = mapped(F.col("status"), STATUS_TEMPLATES)
    named = t.orders.select("o_orderkey", status.alias("status")).withColumn("e", status_event(F.col("status")))
    return named.select("o_orderkey", "status", "e.event", "e.text", "e.description", template.alias("template"), mapped(template, TEMPLATE_LANGUAGES).alias("language"))


@query("SELECT conv_id, turn, CASE turn WHEN 1 THEN 'Poor' WHEN 2 THEN 'Fair' WHEN 3 THEN 'Good' WHEN 4 THEN 'Very Good' WHEN 5 THEN 'Excellent' END AS label FROM conversations")
def rating_labels(t):
    return t.conversations.select("conv_id", "turn", rating_label(F.col("turn")).alias("label"))


_PHONES = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN '9198' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')
  WHEN 2 THEN '+9198' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 3 THEN '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || ' home' END AS phone FROM customer"""
_SENDERS = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '9198' || lpad(CAST(user_id AS VARCHAR), 8, '0') WHEN 1 THEN '98' || lpad(CAST(user_id AS VARCHAR), 8, '0') WHEN 2 THEN '+91 98' || lpad(CAST(user_id AS VARCHAR), 8, '0')
  WHEN 3 THEN CAST(user_id AS VARCHAR) ELSE '' END AS raw FROM events"""


def _phones(t):
    text, n = F.concat(F.lit("98"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")), F.col("c_custkey") % 4
    phone = F.when(n == 0, text).when(n == 1, F.concat(F.lit("91"), text)).when(n == 2, F.concat(F.lit("+91"), text)).otherwise(F.concat(text, F.lit(" home")))
    return t.customer.select("c_custkey", phone.alias("phone"))


def _senders(t):
    user = F.col("user_id").cast("string")
    text, n = F.concat(F.lit("98"), F.lpad(user, 8, "0")), F.col("event_id") % 5
    raw = F.when(n == 0, F.concat(F.lit("91"), text)).when(n == 1, text).when(n == 2, F.concat(F.lit("+91 "), text)).when(n == 3, user).otherwise("")
    return t.events.select(F.col("event_id").alias("id"), raw.alias("raw"))


@query(f"""WITH s AS (SELECT DISTINCT raw FROM ({_SENDERS})),
  c AS (SELECT raw, CASE WHEN length(d) = 10 THEN '91' || d ELSE d END AS clean FROM (SELECT raw, regexp_replace(regexp_replace(raw, '[^0-9]', '', 'g'), '^0+', '') AS d FROM s)),
  f AS (SELECT raw, turn, form FROM (SELECT raw, 0 AS turn, raw AS form FROM c UNION ALL SELECT raw, 1, clean FROM c UNION ALL SELECT raw, 2, regexp_replace(raw, '^91', '') FROM c
    UNION ALL SELECT raw, 3, '91' || regexp_replace(clean, '^91', '') FROM c WHERE clean <> '') WHERE form <> ''),
  h AS (SELECT raw, turn, min(c_custkey) AS c_custkey FROM f JOIN ({_PHONES}) ON ends_with(phone, form) OR starts_with(phone, form) GROUP BY 1, 2)
  SELECT id, raw, customer FROM ({_SENDERS}) LEFT JOIN (SELECT raw, arg_min(c_custkey, turn) AS customer FROM h GROUP BY 1) USING (raw)""")
def fuzzy_phone_match(t):
    """The customer of each sender: of the first of four spellings that some customer's number begins or ends with, the lowest one."""
    return first_by_affix(_senders(t), phone_candidates(F.col("raw")), _phones(t), "phone", "c_custkey", "customer").select("id", "raw", "customer")


@query("""SELECT event_id, user_id, old_status, event_type AS new_status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status FROM events)
  WHERE old_status IS DISTINCT FROM event_type""")
def status_changes(t):
    """Each user's events whose type differs from the one before; of a user with very many, a day is sorted and not the user."""
    found = changed_rows(t.events, "user_id", "event_type", ["ts", "event_id"], F.to_date("ts"), "old_status")
    return found.select("event_id", "user_id", "old_status", F.col("event_type").alias("new_status"))


@query("""WITH m AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'p' || event_id END AS provider, CASE event_id % 4 WHEN 0 THEN 'ticket_' || event_id WHEN 1 THEN 'wa_98' || lpad(CAST(user_id AS VARCHAR), 8, '0') ELSE 'cust_9198' || lpad(CAST(user_id AS VARCHAR), 8, '0') END AS conversation
    FROM events WHERE event_type = 'purchase'),
  s AS (SELECT event_id AS status_id, CASE WHEN event_id % 2 = 0 THEN 'p' || (event_id - event_id % 3) END AS provider,
    CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '91' || '98' || lpad(CAST(user_id AS VARCHAR), 8, '0') ELSE '98' || lpad(CAST(user_id AS VARCHAR), 8, '0') END AS digits FROM events WHERE event_type = 'click'),
  d AS (SELECT digits, (SELECT event_id FROM m WHERE conversation LIKE '%' || digits || '%' ORDER BY ts DESC, event_id DESC LIMIT 1) AS event_id FROM (SELECT DISTINCT coalesce(digits, '') AS digits FROM s))
  SELECT s.status_id, coalesce(a.event_id, d.event_id) AS message_id FROM s LEFT JOIN m a ON s.provider = a.provider LEFT JOIN d ON coalesce(s.digits, '') = d.digits""")
def delivery_resolution(t):
    """The message that a status report is about: by the provider's id, else the latest one whose conversation contains the recipient's digits.

    A report without a recipient goes to the latest message of all.
    """
    of = lambda kind: t.events.where(F.col("event_type") == kind)
    name = lambda n: F.concat(F.lit("p"), n.cast("string"))
    id, number = F.col("event_id"), F.concat(F.lit("98"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    thread = F.when(id % 4 == 0, F.concat(F.lit("ticket_"), id.cast("string"))).when(id % 4 == 1, F.concat(F.lit("wa_"), number)).otherwise(F.concat(F.lit("cust_91"), number))
    messages = of("purchase").select("event_id", "ts", F.when(id % 3 == 0, name(id)).alias("provider"), thread.alias("conversation"))
    recipient = F.when(id % 5 == 1, "").when(id % 5 == 2, F.concat(F.lit("+91 "), number)).when(id % 5 > 2, number)
    reports = of("click").select(id.alias("status_id"), F.when(id % 2 == 0, name(id - id % 3)).alias("provider"), F.coalesce(digits(recipient), F.lit("")).alias("digits"))
    known = messages.where("provider is not null").select("provider", F.col("event_id").alias("known"))
    joined = reports.join(known, "provider", "left")
    found = latest_containing(joined, "digits", messages, "conversation", F.struct("ts", "event_id"), F.col("event_id"), "latest")
    return found.select("status_id", F.coalesce("known", "latest").alias("message_id"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'given' WHEN 1 THEN 'cust_9198' || lpad(CAST(user_id AS VARCHAR), 8, '0') WHEN 2 THEN 'ticket_' || user_id ELSE 'order_' || event_id END AS conversation FROM events""")
def conversation_ids(t):
    n, text = F.col("event_id") % 4, F.col("user_id").cast("string")
    found = conversation_id(F.when(n == 0, F.lit("given")).otherwise(""), F.when(n == 1, F.concat(F.lit("098"), F.lpad(text, 8, "0"))), F.when(n == 2, F.col("user_id")), F.col("event_id"))
    return t.events.select("event_id", found.alias("conversation"))


_THREADS = """SELECT event_id AS message, CASE WHEN event_id % 2 = 0 THEN '98' ELSE '+9198' END || lpad(CAST(user_id AS VARCHAR), 8, '0') AS phone,
    CASE WHEN event_id % 3 = 0 THEN 'cust_9198' || lpad(CAST(user_id AS VARCHAR), 8, '0') ELSE 'ticket_' || event_id END AS conversation FROM events WHERE event_type = 'signup' AND user_id % 2 = 0"""


@query(f"""WITH s AS (SELECT id, CASE WHEN length(d) = 10 THEN '91' || d WHEN length(d) = 12 AND starts_with(d, '91') THEN d END AS number
    FROM (SELECT id, regexp_replace(regexp_replace(raw, '[^0-9]', '', 'g'), '^0+', '') AS d FROM ({_SENDERS}))),
  t AS ({_THREADS}), n AS (SELECT DISTINCT number FROM s WHERE number IS NOT NULL),
  own AS (SELECT DISTINCT number, conversation FROM n JOIN t ON conversation = 'cust_' || number),
  near AS (SELECT number, arg_min(conversation, message) AS conversation FROM n JOIN t ON phone LIKE '%' || regexp_replace(number, '^91', '') GROUP BY 1)
  SELECT id, coalesce(own.conversation, near.conversation) AS conversation FROM s LEFT JOIN own USING (number) LEFT JOIN near USING (number)""")
def existing_conversation(t):
    """The conversation that a sender's message goes to: that of the number, if there is one, else the one of the first message whose number ends like it."""
    id, user = F.col("event_id"), F.lpad(F.col("user_id").cast("string"), 8, "0")
    thread = F.when(id % 3 == 0, F.concat(F.lit("cust_9198"), user)).otherwise(F.concat(F.lit("ticket_"), id.cast("string")))
    messages = t.events.where("event_type = 'signup' and user_id % 2 = 0").select(F.concat(F.when(id % 2 == 0, "98").otherwise("+9198"), user).alias("phone"), F.struct(id.alias("message"), thread.alias("conversation")).alias("m"))
    asked = _senders(t).select("id", phone_strict(F.col("raw")).alias("number"))
    numbers = asked.where("number is not null").select(F.col("number").alias("id")).distinct()
    near = first_by_affix(numbers, F.array(F.regexp_replace("id", "^91", "")), messages, "phone", "m", "near", starts=False)
    own = messages.select(F.col("m.conversation").alias("own")).distinct()
    known = near.join(own, F.concat(F.lit("cust_"), "id") == F.col("own"), "left").select(F.col("id").alias("number"), F.coalesce("own", "near.conversation").alias("conversation"))
    return asked.join(known, "number", "left").select("id", "conversation")
