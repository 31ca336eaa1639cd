"""Streams of messages and status reports: the same transforms as on tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shoploom.functions.exprs import phone_lenient
from shoploom.operators.relational import latest_per_key
from shoploom.session import new_table
from shoploom.sources.tables import POST_OBJECT, WEBHOOK, webhook_messages, webhook_statuses

from .compaction import runs, table_rows


def webhook_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Posts of a messaging provider, one JSON document a line."""
    return spark.readStream.schema(WEBHOOK).option("maxFilesPerTrigger", files_per_batch).json(folder)


def enrich(messages: DataFrame, customers: DataFrame) -> DataFrame:
    """Inbound messages with the customer of their number and their conversation; customers is a table."""
    known = customers.select(F.col("id").alias("customer_id"), phone_lenient(F.col("phone")).alias("number")).where("number is not null")
    first = known.groupBy("number").agg(F.min("customer_id").alias("customer_id"))
    with_number = messages.withColumn("number", phone_lenient(F.col("phone")))
    return with_number.join(first, "number", "left").withColumn("conversation_id", F.concat(F.lit("cust_"), "number"))


def first_seen(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "1 day") -> DataFrame:
    """Each key once, as for a redelivered message or a conversation that already exists; state ends with the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def latest_status(reports: DataFrame, key: str, status: Column, order: Column) -> DataFrame:
    """The last status of each key by time, however late reports arrive."""
    return reports.groupBy(key).agg(F.max_by(status, order).alias("status"))


def unread(messages: DataFrame, key: str, is_unread: Column) -> DataFrame:
    return messages.groupBy(key).agg(F.count_if(is_unread).alias("unread"))


def upsert_each_batch(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], buckets: int = 16) -> StreamingQuery:
    """Writes the rows of each batch beside those before it, dealt out by a hash of their keys; newest_rows reads the table.

    A batch costs what it holds, whatever the table's size, and one that is run
    again replaces itself. A path that another checkpoint has written to is refused.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        if number == 0 and (others := runs(spark, path) - {run}):
            raise ValueError(f"{path} has rows of another checkpoint's stream: {sorted(others)}")
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows that upsert_each_batch wrote, with their batch; of those that a compaction has folded the newest of each key."""
    return table_rows(spark, path, schema).drop("bucket")


def newest_rows(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row in order of each key, of all batches; later batches go first in ties."""
    rows = written_rows(spark, path, schema)
    return latest_per_key(rows, keys, [*order, F.col("batch").desc()]).drop("batch")


def isolated(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed posts of the messaging provider, and the others for a side output."""
    good = F.coalesce((F.col("object") == POST_OBJECT) & F.col("entry").isNotNull(), F.lit(False))
    return posts.where(good), posts.where(~good)


def changes(posts: DataFrame) -> DataFrame:
    """Messages and status reports as one kind of row, to be upserted and folded later."""
    messages = webhook_messages(posts).select("provider_message_id", "phone", "text", F.lit("delivered").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("step"), F.col("sent_at").alias("at"))
    reports = webhook_statuses(posts).select("provider_message_id", F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("text"), "status", "error_message", F.lit(1).alias("step"), F.col("reported_at").alias("at"))
    return messages.unionByName(reports)


def folded(rows: DataFrame) -> DataFrame:
    """Every message with its last status: reports go after the message, by time, then by text; reports without a message fall out."""
    order = F.struct("step", "at", "status", F.coalesce("error_message", F.lit("")))
    by = rows.groupBy("provider_message_id").agg(
        F.max_by("phone", F.when(F.col("step") == 0, F.col("at"))).alias("phone"),
        F.max_by("text", F.when(F.col("step") == 0, F.col("at"))).alias("text"),
        F.max_by(F.struct("status", "error_message"), order).alias("last"),
        F.min("step").alias("step"),
    )
    return by.where("step = 0").select("provider_message_id", "phone", "text", "last.status", "last.error_message")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now, into a table in the shared folder, and reads it.

    In complete mode each batch replaces the table, in append mode it adds to it;
    a batch that is run again replaces its own rows.
    """
    spark = stream.sparkSession
    path, columns = new_table(spark), stream.columns
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")  # so that no rows are a table, too

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number if mode == 'append' else 0}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path).select(columns)


def follow(spark: SparkSession, folder: str, table: str, schema, change: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A table as a stream of its files: of those in the folder {table}.parquet, or of the one file of that name."""
    own = f"{folder}/{table}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    is_folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(own) if is_folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return change(stream) if change else stream


__all__ = ["changes", "enrich", "first_seen", "folded", "follow", "isolated", "latest_status", "newest_rows", "run_to_table", "unread", "upsert_each_batch", "webhook_messages", "webhook_statuses", "webhook_stream", "written_rows"]
