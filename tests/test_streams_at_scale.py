"""Streams over tables of several files, keyed state over many batches, and compaction."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shoploom.plans import registry
from shoploom.sources.tables import Tables
from shoploom.streaming import compaction
from shoploom.streaming import transforms as s
from shoploom.streaming.announce import announce_once

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events as a folder of five files."""
    if not os.path.isdir(FOLDER):
        pytest.skip("the test tables are not here")
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(5).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["stream_unread", "stream_status_latest", "stream_conversations", "stream_new_conversations", "stream_daily_counts", "stream_compacted"])
def test_tables_of_several_files(spark, parts, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{parts}/events.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, parts).select(*want.columns)
    plain = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert plain(got.collect()) == plain(want.fetchall()) != []


def test_one_file_a_batch(spark, parts):
    events = Tables(spark, parts).events
    stream = s.follow(spark, parts, "events", events.schema, files_per_batch=1)
    got = s.run_to_table(s.unread(stream, "event_type", F.col("value") > 50))
    want = events.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("unread"))
    assert sorted(got.collect()) == sorted(want.collect())
    plan = spark.streams.active
    assert plan == []


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def feed(spark, folder, number, rows):
    spark.createDataFrame(rows, "conversation string, sent timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_once_over_six_batches_and_a_restart(spark, tmp_path):
    known = spark.createDataFrame([("old",), ("old",), (None,)], "conversation string")
    seen = []
    for number in range(6):  # each start is a restart: one batch, then the query ends
        feed(spark, tmp_path, number, [("a", at(200 * number)), ("a", at(200 * number)), (f"new{number}", at(200 * number)), ("old", at(0)), (None, at(0))])
        stream = spark.readStream.schema("conversation string, sent timestamp").parquet(f"{tmp_path}/in")
        query = announce_once(stream, ["conversation"], "sent", known).writeStream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").format("parquet").trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(sorted(r.conversation for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert seen == [sorted(["a", *(f"new{k}" for k in range(n + 1))]) for n in range(6)]


def test_own_timers_forget_after_silence(spark, tmp_path):
    counts = []
    for number, day in enumerate([0, 3, 6, 9, 30, 31]):  # b speaks on the first day only, a until the tenth and at the end
        feed(spark, tmp_path, number, [("tick", at(day))] + ([("a", at(day))] if day != 30 else []) + ([("b", at(day))] if day in (0, 31) else []))
        stream = spark.readStream.schema("conversation string, sent timestamp").parquet(f"{tmp_path}/in")
        found = announce_once(stream, ["conversation"], "sent", forget=dt.timedelta(days=5))
        query = found.writeStream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").format("parquet").trigger(availableNow=True).start()
        query.awaitTermination()
        counts.append([sum(r.conversation == k for r in spark.read.parquet(f"{tmp_path}/out").collect()) for k in ("a", "b")])
    assert counts[:4] == [[1, 1]] * 4 and counts[-1] == [2, 2]


SCHEMA = "id int, at int, text string, gone boolean"


def batches(spark, tmp_path, numbers):
    """Batch n brings key n % 7 anew, and deletes key 3 with its 40th."""
    for n in numbers:
        spark.createDataFrame([(n % 7, n, f"t{n}", n == 45), (100 + n, n, "once", False)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        s.upsert_each_batch(stream, f"{tmp_path}/table", f"{tmp_path}/state", ["id"], buckets=4).awaitTermination()


def test_compaction_changes_no_row(spark, tmp_path, monkeypatch):
    path, schema = f"{tmp_path}/table", spark.createDataFrame([], SCHEMA).schema
    rows = lambda: sorted(tuple(r) for r in compaction.current_rows(spark, path, schema, ["id"], [F.col("at").desc()], F.col("gone")).collect())
    fold = lambda: compaction.compact(spark, path, schema, ["id"], [F.col("at").desc()], F.col("gone"))
    assert rows() == []
    batches(spark, tmp_path, range(12))
    before = rows()
    assert len(before) == 7 + 12 and fold() == 1 and rows() == before
    assert compaction.table_rows(spark, path, schema).count() == 19
    batches(spark, tmp_path, [45])  # key 3 ends
    before = rows()
    assert len(before) == 6 + 13 and 3 not in {r[0] for r in before}

    with monkeypatch.context() as patch:  # a crash between the base and its version
        patch.setattr(compaction.Folder, "put", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError, match="crash"):
            fold()
    assert rows() == before and compaction.version(compaction.Folder(spark, path))[0] == 1
    assert fold() == 2 and rows() == before
    bases = compaction.version(compaction.Folder(spark, path))[1]
    assert len(bases) == 4 and len(set(bases.values())) == 2  # the last batch has added to some buckets only
    gone = compaction.vacuum(spark, path)
    assert any(g.startswith("_bases/") for g in gone) and sum("batch=" in g for g in gone) == 13 and rows() == before
    assert {b: base for b, base in bases.items() if f"bucket={b}" in compaction.Folder(spark, path).names(base)} == bases
    assert compaction.table_rows(spark, path, schema).where("id = 3").count() == 0
    batches(spark, tmp_path, [52])  # key 3 again, later than its end
    assert (3, 52, "t52", False) in rows() and len(rows()) == 7 + 14


def test_two_compactions_at_once(spark, tmp_path):
    path, schema = f"{tmp_path}/table", spark.createDataFrame([], SCHEMA).schema
    batches(spark, tmp_path, range(3))
    folder = compaction.Folder(spark, path)
    folder.put("_versions/00000001.json", '{"bases": {}, "folded": {}}')
    with pytest.raises(FileExistsError, match="compact again"):
        folder.put("_versions/00000001.json", "{}")
    assert compaction.compact(spark, path, schema, ["id"], [F.col("at").desc()]) == 2
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        s.upsert_each_batch(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), path, f"{tmp_path}/other", ["id"]).awaitTermination()


def test_fifty_batches_and_a_compaction(spark, tmp_path):
    """One run of fifty batches, one file each; every bucket's deltas become one base."""
    path, schema = f"{tmp_path}/table", spark.createDataFrame([], SCHEMA).schema
    spark.range(500).selectExpr("cast(id % 37 as int) as id", "cast(id as int) as at", "concat('t', id) as text", "id % 61 = 0 as gone").repartition(50).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    s.upsert_each_batch(stream, path, f"{tmp_path}/state", ["id"], buckets=2).awaitTermination()
    folder, order = compaction.Folder(spark, path), [F.col("at").desc()]
    run = next(n for n in folder.names() if n.startswith("run="))
    assert len([n for n in folder.names(run) if n.startswith("batch=")]) == 50
    rows = lambda: sorted(tuple(r) for r in compaction.current_rows(spark, path, schema, ["id"], order, F.col("gone")).collect())
    before = rows()
    last = {i % 37: i for i in range(500)}
    assert before == sorted((k, i, f"t{i}", False) for k, i in last.items() if i % 61)
    assert compaction.compact(spark, path, schema, ["id"], order, F.col("gone")) == 1
    bases = compaction.version(folder)[1]
    assert rows() == before and set(bases) == {"0", "1"} and len(set(bases.values())) == 1
    compaction.vacuum(spark, path)
    assert rows() == before and [n for n in folder.names(run) if n.startswith("batch=")] == []
