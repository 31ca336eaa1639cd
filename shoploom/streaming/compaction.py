"""Compaction of tables that streams add batches to.

A table is the folders run=R/batch=N that upsert_each_batch writes, and versions: small
JSON files, numbered from 1, of which the last one counts. A version names a base
folder for each bucket that has rows and, for each run, the last batch that is folded
into them. Readers take the bases and the batches behind them. A version's file is put
in place by a rename that fails if another one has been faster, so a compaction is there
as a whole or not at all. It rewrites only the buckets that batches have added to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shoploom.operators.relational import latest_per_key

class Folder:
    """A table's folder, by the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self.at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read_text(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect())

    def put(self, name: str, text: str) -> None:
        """Writes a file that must not be there yet."""
        self.fs.mkdirs(self.at(name).getParent())
        draft = self.at(f"_drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(draft, self.at(name)):
            raise FileExistsError(f"{self.path}/{name} was written meanwhile; compact again")


def version(folder: Folder) -> tuple[int, dict[str, str], dict[str, int]]:
    """(number, base folder by bucket, last folded batch by run) of the version that counts; 0 without any."""
    numbers = [int(n.removesuffix(".json")) for n in folder.names("_versions") if n.endswith(".json")]
    if not numbers:
        return 0, {}, {}
    found = json.loads(folder.read_text(f"_versions/{max(numbers):08d}.json"))
    return max(numbers), found["bases"], found["folded"]


def runs(spark: SparkSession, path: str) -> set[str]:
    """The streams that have written to the table."""
    folder = Folder(spark, path)
    return {n.removeprefix("run=") for n in folder.names() if n.startswith("run=")} | set(version(folder)[2])


def _batches(folder: Folder, folded: dict[str, int]) -> dict[str, list[int]]:
    """The committed batches behind the folded ones, by run."""
    found: dict[str, list[int]] = {}
    for run in (n.removeprefix("run=") for n in folder.names() if n.startswith("run=")):
        numbers = sorted(int(n.removeprefix("batch=")) for n in folder.names(f"run={run}") if n.startswith("batch="))
        found[run] = [n for n in numbers if n > folded.get(run, -1) and "_SUCCESS" in folder.names(f"run={run}/batch={n}")]
    return found


def _rows(folder: Folder, schema: StructType, bases: dict[str, str], batches: dict[str, list[int]]) -> DataFrame:
    spark = folder.spark
    whole = StructType([*schema.fields, StructField("batch", IntegerType()), StructField("bucket", IntegerType())])
    places: dict[str, list[str]] = {}
    for bucket, base in bases.items():
        places.setdefault(f"{folder.path}/{base}", []).append(f"{folder.path}/{base}/bucket={bucket}")
    for run, numbers in batches.items():
        if numbers:
            root = f"{folder.path}/run={run}"
            places[root] = [f"{root}/batch={n}" for n in numbers]
    # one read for each root: as many as there are runs and bases that still count
    parts = [spark.read.schema(whole).option("basePath", root).parquet(*paths) for root, paths in places.items()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], whole)


def table_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the version that counts and of the batches behind it, with batch and bucket."""
    folder = Folder(spark, path)
    _, bases, folded = version(folder)
    return _rows(folder, schema, bases, _batches(folder, folded))


def current_rows(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[Column], deleted: Column | None = None) -> DataFrame:
    """The first row in order of each key, later batches first in ties; keys whose first row is a tombstone are left out."""
    newest = latest_per_key(table_rows(spark, path, schema), keys, [*order, F.col("batch").desc()])
    return (newest if deleted is None else newest.where(~F.coalesce(deleted, F.lit(False)))).drop("batch", "bucket")


def compact(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[Column], deleted: Column | None = None) -> int:
    """Folds all batches that are there into new bases of the buckets they add to, and gives the new version's number.

    Only the first row in order of each key goes on. A tombstone goes with the key's older
    rows, as bases have all there was before it; with a late row of a time before the
    tombstone the key would be there again, so deletions should be final. The number of
    buckets must stay what it was. Batches that
    come meanwhile stand behind the new version. What a failed compaction has written is
    in no version; vacuum deletes it.
    """
    folder = Folder(spark, path)
    number, bases, folded = version(folder)
    batches = _batches(folder, folded)
    touched = {n.removeprefix("bucket=") for run, numbers in batches.items() for k in numbers for n in folder.names(f"run={run}/batch={k}") if n.startswith("bucket=")}
    rows = latest_per_key(_rows(folder, schema, {b: base for b, base in bases.items() if b in touched}, batches), ["bucket", *keys], [*order, F.col("batch").desc()])
    if deleted is not None:
        rows = rows.where(~F.coalesce(deleted, F.lit(False)))
    new = f"_bases/{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{new}")
    written = {n.removeprefix("bucket=") for n in folder.names(new) if n.startswith("bucket=")}
    kept = {b: base for b, base in bases.items() if b not in touched} | dict.fromkeys(written, new)
    last = {run: numbers[-1] for run, numbers in batches.items() if numbers}
    folder.put(f"_versions/{number + 1:08d}.json", json.dumps({"bases": kept, "folded": folded | last}))
    return number + 1


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes the folders that the version that counts doesn't need, and names them; readers of earlier versions must be done."""
    folder = Folder(spark, path)
    _, bases, folded = version(folder)
    gone = ["_drafts"]
    for name in (f"_bases/{n}" for n in folder.names("_bases")):
        own = [b for b, base in bases.items() if base == name]
        gone += [f"{name}/{n}" for n in folder.names(name) if n.startswith("bucket=") and n.removeprefix("bucket=") not in own] if own else [name]
    for run, last in folded.items():
        gone += [f"run={run}/{n}" for n in folder.names(f"run={run}") if n.startswith("batch=") and int(n.removeprefix("batch=")) <= last]
    for name in gone:
        folder.fs.delete(folder.at(name), True)
    return gone
