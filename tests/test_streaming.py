import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shoploom.sources.tables import copy_levels, copy_table, describe, missing_columns, parsed_posts, webhook_messages, webhook_statuses
from shoploom.streaming import transforms as s


def post(messages=(), statuses=()):
    value = {"contacts": [{"profile": {"name": "Ann"}, "wa_id": "91"}], "messages": list(messages), "statuses": list(statuses)}
    return {"object": "whatsapp_business_account", "entry": [{"changes": [{"value": value}]}]}


def message(id, phone, text="hi", at="1700000000"):
    return {"id": id, "from": phone, "type": "text", "timestamp": at, "text": {"body": text}}


def status(id, what, at):
    return {"id": id, "status": what, "recipient_id": "91", "timestamp": at, "errors": [{"title": "t", "message": "m"}]}


def write(folder, posts):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(p if isinstance(p, str) else json.dumps(p) for p in posts))


def test_stream_equals_batch(spark, tmp_path):
    write(tmp_path / "in", [post([message("a", "9876543210"), message("b", "9876543210")]), post([message("a", "9876543210")], [status("a", "read", "1700000009")]), "not json"])
    write(tmp_path / "in", [post([], [status("a", "sent", "1700000001"), status("b", "sent", "1700000002")])])
    posts = s.webhook_stream(spark, str(tmp_path / "in"), 1)
    good, bad = s.isolated(posts)
    assert s.run_to_table(bad, "append").count() == 1
    last = s.run_to_table(s.latest_status(webhook_statuses(good), "provider_message_id", F.col("status"), F.col("reported_at")))
    assert {r.provider_message_id: r.status for r in last.collect()} == {"a": "read", "b": "sent"}
    unread = s.run_to_table(s.unread(webhook_messages(good), "phone", F.lit(True)))
    batch = webhook_messages(spark.read.schema(posts.schema).json(str(tmp_path / "in")))
    assert unread.first().unread == batch.count() == 3
    once = s.run_to_table(s.first_seen(webhook_messages(good), ["provider_message_id"], "sent_at"), "append")
    assert sorted(r.provider_message_id for r in once.collect()) == ["a", "b"]


def test_enrich_and_upsert(spark, tmp_path):
    write(tmp_path / "in", [post([message("a", "+91 98765-43210", "one", "1700000000")])])
    write(tmp_path / "in", [post([message("a", "+91 98765-43210", "two", "1700000005"), message("c", "123", "x")])])
    customers = spark.createDataFrame([(7, "9876543210"), (4, "09876543210"), (9, None)], "id int, phone string")
    found = s.enrich(webhook_messages(s.webhook_stream(spark, str(tmp_path / "in"), 1)), customers)
    run = lambda check: s.upsert_each_batch(found, str(tmp_path / "out"), str(tmp_path / check), ["provider_message_id"]).awaitTermination()
    order = [F.col("sent_at").desc_nulls_last(), F.col("text")]
    newest = lambda: s.newest_rows(spark, str(tmp_path / "out"), found.schema, ["provider_message_id"], order)
    assert newest().count() == 0
    run("check")
    write(tmp_path / "in", [post([message("a", "+91 98765-43210", "late", "1700000002"), message("d", "5")])])
    run("check")
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        run("other")
    rows = {r.provider_message_id: r for r in newest().collect()}
    assert len(rows) == 3 and rows["d"].number is None
    rows.pop("d")
    assert rows["a"].text == "two" and rows["a"].customer_id == 4 and rows["a"].conversation_id == "cust_919876543210"
    assert rows["c"].customer_id is None and len(rows) == 2


def test_tables(spark):
    source = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "id int, name string, extra int")
    target = spark.createDataFrame([], "id int, name string")
    rows, stats = copy_table(source, target)
    assert rows.columns == ["name"] and rows.count() == 2 and tuple(stats.first()) == (2, False, 2)
    rows, stats = copy_table(source, source)
    assert rows.count() == 0 and tuple(stats.first()) == (2, True, 0)
    assert [r.column_name for r in describe(source, "t").orderBy("position").collect()] == source.columns
    assert missing_columns(target, ["id", "extra"]) == ["extra"]
    assert copy_levels({"a": ["b", "c"], "b": ["c"], "c": []}) == {"c": 1, "b": 2, "a": 3}
    with pytest.raises(ValueError, match="ring"):
        copy_levels({"a": ["b"], "b": ["a"]})


def test_odd_posts(spark):
    lines = ["", "null", "{}", '{"object": "whatsapp_business_account"}', '{"object": "whatsapp_business_account", "entry": [{"changes": [{"value": null}, {}]}, {}]}', json.dumps(post([], [])), json.dumps(post([message("a", None)]))]
    posts = parsed_posts(spark.createDataFrame([(x,) for x in lines], "value string"))
    good, bad = s.isolated(posts)
    assert (good.count(), bad.count()) == (3, 4)
    assert [r.provider_message_id for r in webhook_messages(good).collect()] == ["a"] and webhook_statuses(good).count() == 0
    assert [r.status for r in s.folded(s.changes(good)).collect()] == ["delivered"]
