"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shoploom.session import clear_tables, new_table, shared_folder

__all__ = ["clear_tables", "cut", "read", "stored", "with_fields"]


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and restarts its lineage from files that outlive any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like cut, as a compressed table: for wide rows that are read more than once. clear_tables deletes all of them."""
    path = new_table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_fields(df: DataFrame, added: dict[str, str]) -> T.StructType:
    """df's schema with the added columns last, in place of any of their names."""
    kept = [f for f in df.schema.fields if f.name not in added]
    return T.StructType([*kept, *(T.StructField(n, T.DataType.fromDDL(kind)) for n, kind in added.items())])
