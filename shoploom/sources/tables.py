"""Reading, describing and copying tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Messages and status reports of a messaging provider, as its webhook posts them.
WEBHOOK = """object STRING, entry ARRAY<STRUCT<changes: ARRAY<STRUCT<value: STRUCT<
         contacts: ARRAY<STRUCT<profile: STRUCT<name: STRING>, wa_id: STRING>>,
         messages: ARRAY<STRUCT<id: STRING, `from`: STRING, type: STRING, timestamp: STRING, text: STRUCT<body: STRING>>>,
         statuses: ARRAY<STRUCT<id: STRING, status: STRING, recipient_id: STRING, timestamp: STRING,
                                errors: ARRAY<STRUCT<title: STRING, message: STRING>>>>>>>>>"""

#: Fixed value: what a post of the messaging provider calls itself; others are not read.
POST_OBJECT = "whatsapp_business_account"


class Tables:
    """The parquet tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, names: Iterable[str], **args) -> DataFrame:
        """SQL over tables given by name, as {name}, with named parameters :arg."""
        return self.spark.sql(text, args=args or None, **{n: getattr(self, n) for n in names})


def from_database(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A live table over JDBC, read in parts by ranges of its key; the driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def describe(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, data_type, position): what an information schema would say."""
    rows = [(table, f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")


def missing_columns(df: DataFrame, expected: Iterable[str]) -> list[str]:
    """Expected columns that a table lacks, for writers that fall back to fewer."""
    return [c for c in expected if c not in df.columns]


def copy_table(source: DataFrame, target: DataFrame | None, generated: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows to append and one row of statistics.

    Only columns that both sides have are copied, without the generated key; a
    target that has rows is left alone.
    """
    common = [c for c in source.columns if c != generated and (target is None or c in target.columns)]
    skipped = target is not None and not target.isEmpty()
    rows = source.select(common).where(F.lit(not skipped))
    stats = source.agg(F.count("*").alias("found")).withColumns({"skipped": F.lit(skipped), "copied": F.when(F.lit(skipped), F.lit(0)).otherwise(F.col("found")).cast("long")})
    return rows, stats


def copy_levels(references: dict[str, Iterable[str]]) -> dict[str, int]:
    """The level of each table in the order of copying: 1 without references, else one above the highest it refers to."""
    levels: dict[str, int] = {}
    while len(levels) < len(references):
        ready = {n: 1 + max((levels[r] for r in refs), default=0) for n, refs in references.items() if n not in levels and all(r in levels for r in refs)}
        if not ready:
            raise ValueError(f"tables refer to each other in a ring or to unknown ones: {sorted(set(references) - set(levels))}")
        levels |= ready
    return levels


def parsed_posts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Posts from JSON texts; what isn't JSON gives a post of nulls."""
    return lines.select(F.from_json(column, WEBHOOK).alias("post")).select("post.*")


def _values(posts: DataFrame) -> DataFrame:
    return posts.select(F.explode("entry").alias("e")).select(F.explode("e.changes.value").alias("v"))


def webhook_messages(posts: DataFrame) -> DataFrame:
    """One row for each message of the posts; one that isn't text has its type in brackets as its text.

    Posts, entries, changes and values that are null or hold no messages add nothing.
    """
    return _values(posts).select(F.col("v.contacts")[0].alias("contact"), F.explode("v.messages").alias("m")).select(
        F.col("m.id").alias("provider_message_id"),
        F.col("m.from").alias("phone"),
        F.col("m.type").alias("type"),
        F.when(F.col("m.type") == "text", F.col("m.text.body")).otherwise(F.concat(F.lit("["), "m.type", F.lit("]"))).alias("text"),
        F.coalesce(F.nullif("contact.profile.name", F.lit("")), F.lit("Unknown")).alias("sender_name"),
        F.timestamp_seconds(F.expr("try_cast(m.timestamp as bigint)")).alias("sent_at"),
    )


def webhook_statuses(posts: DataFrame) -> DataFrame:
    """One row for each status report of the posts."""
    said = lambda e: F.coalesce(F.nullif(e.title, F.lit("")), F.nullif(e.message, F.lit("")))
    return _values(posts).select(F.explode("v.statuses").alias("s")).select(
        F.col("s.id").alias("provider_message_id"),
        F.col("s.status").alias("status"),
        F.col("s.recipient_id").alias("recipient"),
        F.when(F.size("s.errors") > 0, F.array_join(F.transform("s.errors", said), "; ")).alias("error_message"),
        F.timestamp_seconds(F.expr("try_cast(s.timestamp as bigint)")).alias("reported_at"),
    )
