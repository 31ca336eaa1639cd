"""Streaming reports over the events table, equal to their batch forms."""

from pyspark.sql import functions as F

from shoploom.session import new_table
from shoploom.sources.tables import POST_OBJECT, parsed_posts, webhook_messages, webhook_statuses
from shoploom.streaming import compaction
from shoploom.streaming import transforms as s
from shoploom.streaming.announce import announce_once

from .registry import query


def _events(t):
    stream = s.follow(t.spark, t.folder, "events", t.events.schema)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) AS unread FROM events GROUP BY 1")
def stream_unread(t):
    return s.run_to_table(s.unread(_events(t), "event_type", F.col("value") > 50))


@query("SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def stream_status_latest(t):
    keyed = _events(t).withColumn("key", F.col("user_id"))
    return s.run_to_table(s.latest_status(keyed, "key", F.col("event_type"), F.struct("ts", "event_id")))


def _threads(t):
    return _events(t).select("at", F.col("user_id").alias("conversation"), F.col("event_type").alias("channel"))


@query("SELECT DISTINCT user_id AS conversation, event_type AS channel FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def stream_conversations(t):
    """Every conversation of a channel when its first message comes, once for good."""
    return s.run_to_table(announce_once(_threads(t), ["conversation", "channel"], "at"), "append")


@query("""SELECT DISTINCT user_id AS conversation FROM events WHERE event_type <> 'signup' AND user_id IS NOT NULL
  AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 150 AND user_id IS NOT NULL)""")
def stream_new_conversations(t):
    """The conversations that a stream of messages begins, beside a table of those that exist."""
    known = t.events.where("event_type = 'signup' and value > 150").select(F.col("user_id").alias("conversation"))
    return s.run_to_table(announce_once(_threads(t).where("channel <> 'signup'"), ["conversation"], "at", known), "append")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'""")
def stream_compacted(t):
    """The last event of each user, from a table that a stream adds to and a compaction folds; an error deletes the user."""
    spark, path = t.spark, new_table(t.spark)
    stream = _events(t).drop("at")
    order, gone = [F.col("ts").desc(), F.col("event_id").desc()], F.col("event_type") == "error"
    s.upsert_each_batch(stream, f"{path}/table", f"{path}/state", ["user_id"]).awaitTermination()
    compaction.compact(spark, f"{path}/table", stream.schema, ["user_id"], order, gone)
    return compaction.current_rows(spark, f"{path}/table", stream.schema, ["user_id"], order, gone).select("user_id", "event_id", "event_type", "value")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(t):
    by = _events(t).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return s.run_to_table(by.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n"))


# --- the messaging provider's posts ---

#: By event: posts hold eight events each; clicks and views are messages, purchases and errors status reports of earlier ones.
_POST = "event_id // 8"
_READ = f"({_POST}) % 7 <> 3 AND ({_POST}) % 11 <> 5"
_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
_PHONE = "'98' || lpad(CAST(user_id AS VARCHAR), 8, '0')"
_MESSAGES = f"""SELECT 'm' || event_id AS provider_message_id, {_PHONE} AS phone, CASE WHEN event_id % 3 = 0 THEN 'image' ELSE 'text' END AS type,
    CASE WHEN event_id % 3 = 0 THEN '[image]' ELSE 'hello ' || event_id END AS text, CASE WHEN ({_POST}) % 4 = 0 THEN 'Unknown' ELSE 'c' || ({_POST}) END AS sender_name, {_SECONDS} AS sent
  FROM events WHERE event_type IN ('click', 'view') AND {_READ}"""
_REPORTS = f"""SELECT 'm' || (event_id - event_id % 5) AS provider_message_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 2 = 0 THEN 'read' ELSE 'delivered' END AS status,
    {_PHONE} AS recipient, CASE WHEN event_type = 'error' AND event_id % 4 > 0 THEN 'e' || event_id || '; second' END AS error_message, {_SECONDS} AS reported
  FROM events WHERE event_type IN ('purchase', 'error') AND {_READ}"""


def _lines(t):
    """The posts as JSON texts; some are of another kind, some are no JSON."""
    id, kind = F.col("event_id"), F.col("event_type")
    phone = F.concat(F.lit("98"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    seconds = F.expr("cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as string)")
    named = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    body = F.when(id % 3 > 0, F.struct(named("hello ", id).alias("body")))
    message = F.struct(named("m", id).alias("id"), phone.alias("from"), F.when(id % 3 == 0, "image").otherwise("text").alias("type"), seconds.alias("timestamp"), body.alias("text"))
    problems = F.array(F.struct(named("e", id).alias("title"), F.lit("x").alias("message")), F.struct(F.lit("").alias("title"), F.lit("second").alias("message")))
    state = F.when(kind == "error", "failed").when(id % 2 == 0, "read").otherwise("delivered")
    report = F.struct(named("m", id - id % 5).alias("id"), state.alias("status"), phone.alias("recipient_id"), seconds.alias("timestamp"), F.when((kind == "error") & (id % 4 > 0), problems).alias("errors"))
    by = t.events.groupBy(F.floor(id / 8).alias("post")).agg(F.collect_list(F.when(kind.isin("click", "view"), message)).alias("messages"), F.collect_list(F.when(kind.isin("purchase", "error"), report)).alias("statuses"))
    name = F.struct(F.when(F.col("post") % 4 == 0, "").otherwise(named("c", F.col("post"))).alias("name"))
    value = F.struct(F.array(F.struct(name.alias("profile"), F.lit("91").alias("wa_id"))).alias("contacts"), "messages", "statuses")
    what = F.when(F.col("post") % 7 == 3, "page").otherwise(POST_OBJECT)
    empty = F.struct(F.lit(None).cast(by.select(value.alias("v")).schema["v"].dataType).alias("value"))
    post = F.struct(what.alias("object"), F.array(F.struct(F.array(empty, F.struct(value.alias("value"))).alias("changes"))).alias("entry"))
    return by.select(F.when(F.col("post") % 11 == 5, "not json").otherwise(F.to_json(post)).alias("value"))


def _posts(t):
    return s.isolated(parsed_posts(_lines(t)))[0]


@query(_MESSAGES)
def webhook_inbound(t):
    found = webhook_messages(_posts(t))
    return found.withColumn("sent", F.col("sent_at").cast("long")).drop("sent_at")


@query(_REPORTS)
def webhook_reports(t):
    found = webhook_statuses(_posts(t))
    return found.withColumn("reported", F.col("reported_at").cast("long")).drop("reported_at")


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT {_POST} AS post FROM events) WHERE post % 7 = 3 OR post % 11 = 5")
def webhook_set_aside(t):
    return s.isolated(parsed_posts(_lines(t)))[1].agg(F.count("*").alias("n"))


@query(f"""SELECT provider_message_id, '91' || phone AS number, customer_id, 'cust_91' || phone AS conversation_id FROM ({_MESSAGES})
  LEFT JOIN (SELECT '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS own, c_custkey AS customer_id FROM customer WHERE c_acctbal > 0) ON phone = own""")
def webhook_enriched(t):
    """Inbound messages with their number, the customer whose number it is, and their conversation."""
    customers = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("+91 98"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"))
    return s.enrich(webhook_messages(_posts(t)), customers).select("provider_message_id", "number", "customer_id", "conversation_id")


@query(f"""WITH r AS (SELECT provider_message_id, arg_max(struct_pack(s := status, e := error_message), struct_pack(a := reported, b := status, c := coalesce(error_message, ''))) AS last FROM ({_REPORTS}) GROUP BY 1)
  SELECT m.provider_message_id, phone, text, coalesce(last.s, 'delivered') AS status, last.e AS error_message FROM ({_MESSAGES}) m LEFT JOIN r USING (provider_message_id)""")
def stream_webhook(t):
    """The posts as a stream of JSON files: every batch upserts its messages and reports, which are then folded into messages."""
    spark, path = t.spark, new_table(t.spark)
    _lines(t).write.text(f"{path}/posts")
    good, _ = s.isolated(s.webhook_stream(spark, f"{path}/posts"))
    rows = s.changes(good)
    s.upsert_each_batch(rows, f"{path}/table", f"{path}/state", ["provider_message_id"]).awaitTermination()
    return s.folded(s.written_rows(spark, f"{path}/table", rows.schema))
