"""Operators over DataFrames that Spark has no single method for.

Each is a composition of built-in operations. Orders are always complete: ties
are broken by the columns given last.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import TASK_ROWS, parts_of


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; the limit is pushed below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def nest_children(parents: DataFrame, children: DataFrame, key: str, foreign: str, fields: Sequence[str], name: str, descending: bool = False) -> DataFrame:
    """Adds the children of each parent as a sorted array of structs, empty without any.

    Children are gathered before the join, so parents aren't multiplied and other
    lists can be added in the same way.
    """
    lists = children.groupBy(F.col(foreign).alias("__key")).agg(F.sort_array(F.collect_list(F.struct(*fields)), asc=not descending).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return parents.join(lists, F.col(key) == F.col("__key"), "left").withColumn(name, F.coalesce(name, empty)).drop("__key")


def page(df: DataFrame, order: Sequence[Column], number: int = 1, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_totals(df: DataFrame, limit: int = 50) -> DataFrame:
    """total and total_pages of a filtered base, counted before any join for display."""
    total = F.count("*")
    return df.agg(total.alias("total"), F.ceil(total / limit).cast("long").alias("total_pages"))


def keep_first(df: DataFrame, keys: Sequence[str], id: str) -> DataFrame:
    """Drops all but the lowest id of equal keys; rows with a null key stay, as null equals nothing."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # a grouped minimum combines before the shuffle, and a hot key of the join can be split
    first = df.where(known).groupBy(*keys).agg(F.min(id).alias("__first"))
    return df.join(first, list(keys), "left").where(~known | (F.col(id) == F.col("__first"))).select(df.columns)


def running_number(df: DataFrame, key: str, bucket: str, order: Sequence[Column], name: str = "number") -> DataFrame:
    """Numbers the rows of each key from 1; bucket must rise with the order.

    Only buckets are sorted as a whole, and a running sum over their counts puts
    them behind each other, so no task sorts all rows of a key.
    """
    counts = df.groupBy(key, bucket).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy(F.col(bucket).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(key).alias("__key"), F.col(bucket).alias("__bucket"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = df.withColumn("__row", F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order)))
    met = F.col(key).eqNullSafe(F.col("__key")) & F.col(bucket).eqNullSafe(F.col("__bucket"))
    return inside.join(starts, met).withColumn(name, F.col("__before") + F.col("__row")).select(*df.columns, name)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Old rows, replaced or joined by new ones of the same key; of several new ones the first in order."""
    last = latest_per_key(new, keys, order)
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows and those new ones whose key isn't there yet."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def patch_merge(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Base rows with the patch's values where those aren't null; at most one patch row for each key."""
    changed = [c for c in patch.columns if c != key and c in base.columns]
    joined = base.alias("b").join(patch.alias("p"), key, "left")
    return joined.select(*[F.coalesce(f"p.{c}", f"b.{c}").alias(c) if c in changed else F.col(key if c == key else f"b.{c}") for c in base.columns])


def delete_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def soft_delete(df: DataFrame, gone: DataFrame, key: str, flag: str = "is_active") -> DataFrame:
    """All rows stay; those with a key in gone are marked inactive, the others keep their flag or are active."""
    keys = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    old = F.coalesce(F.col(flag), F.lit(True)) if flag in df.columns else F.lit(True)
    return df.join(keys, key, "left").withColumn(flag, F.when(F.col("__gone"), F.lit(False)).otherwise(old)).drop("__gone")


def flip(df: DataFrame, where: Column, **values: Column) -> tuple[DataFrame, Column]:
    """Sets values where the condition holds, and the aggregate that counts those rows of df."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}), F.count_if(hit)


def apply_payments(invoices: DataFrame, payments: DataFrame, key: str) -> DataFrame:
    """Invoices with amount_paid raised by their payments' amounts, balance_due left of total_amount, and n_payments."""
    sums = payments.groupBy(key).agg(F.sum("amount").alias("__paid"), F.count("*").alias("__n"))
    paid = F.coalesce("amount_paid", F.lit(0)) + F.coalesce("__paid", F.lit(0))
    changed = invoices.join(sums, key, "left").withColumns({"amount_paid": paid, "balance_due": F.col("total_amount") - paid, "n_payments": F.coalesce("__n", F.lit(0))})
    return changed.drop("__paid", "__n")


def unpivoted(row: DataFrame, label: str, value: str, **columns: str) -> DataFrame:
    """Columns as rows: the label of each and its value."""
    pairs = F.array(*[F.struct(F.lit(text).alias(label), F.col(c).cast("long").alias(value)) for c, text in columns.items()])
    others = [c for c in row.columns if c not in columns]
    return row.select(*others, F.explode(pairs).alias("__pair")).select(*others, f"__pair.{label}", f"__pair.{value}")


def first_by_affix(asked: DataFrame, forms: Column, table: DataFrame, text: str, value: str, name: str, starts: bool = True, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds the least value of the rows whose text ends (or, with starts, begins) with a form, for the first form that has one.

    forms is an array of texts in the order in which they are tried. Every text of
    the table becomes its beginnings and ends, a few rows each, so forms meet them
    by equality and no pairs are compared; signs like % have no special meaning. That
    takes space with the square of a text's length: it is for numbers and names, and
    latest_containing for longer texts. Texts are dealt out before they become pieces, so
    a task has those of about task_rows / 8 texts, and what was found is grouped in parts
    of about task_rows of asked, which must have a unique column id.
    """
    n = F.length(F.col(text))
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.right(F.col(text), i))
    heads = F.transform(F.sequence(F.lit(1), n), lambda i: F.left(F.col(text), i))
    affixes = F.array_distinct(F.concat(ends, heads)) if starts else ends
    many, found = parts_of(table, max(1, task_rows // 8)), parts_of(asked, task_rows)
    pieces = table.where(n > 0).select(text, value).repartition(many, text).select(F.explode(affixes).alias("__form"), F.col(value).alias("__value"))
    least = pieces.groupBy("__form").agg(F.min("__value").alias("__value")).repartition(many + found, "__form")
    tried = asked.select("id", F.posexplode(forms).alias("__turn", "__form")).repartition(many + found, "__form")
    # their sizes are estimated before texts become pieces, far too small for a broadcast
    hits = tried.join(least.hint("merge"), "__form").repartition(found, "id")
    return asked.join(hits.groupBy("id").agg(F.min_by("__value", "__turn").alias(name)), "id", "left")


def child_replace(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new give way to new's rows."""
    return delete_keys(children, new, parent).unionByName(new)


def exclusive_flag(df: DataFrame, flag: str, chosen: Column) -> DataFrame:
    """Sets the flag on the chosen row only."""
    return df.withColumn(flag, F.coalesce(chosen, F.lit(False)))


def update_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], where: Column, **values: Column) -> DataFrame:
    """Sets values on the first row in order of each key, among those that meet the condition."""
    rank = F.row_number().over(Window.partitionBy(*keys, where).orderBy(*order))
    hit = where & (F.col("__rank") == 1)
    return df.withColumn("__rank", rank).withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).drop("__rank")


def days(spark, first: str, last: str) -> DataFrame:
    """A calendar: one row for each day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def on_spine(calendar: DataFrame, counts: DataFrame, *measures: str) -> DataFrame:
    """Counts by day for every day of the calendar, 0 where there are none."""
    return calendar.join(counts, "day", "left").fillna(0, list(measures))


def covered_range(start: Column, end: Column, first: str, last: str) -> tuple[Column, Column]:
    """The first and last day of a range on which the interval [start, end] stands; an end of null is open."""
    last_day = F.lit(last).cast("date")
    return F.greatest(start, F.lit(first).cast("date")), F.least(F.coalesce(end, last_day), last_day)


def covered_days(df: DataFrame, start: Column, end: Column, first: str, last: str) -> DataFrame:
    """A row for each day of the range on which the interval [start, end] stands; an end of null is open.

    Rows become their days, so counting joins by equality and needs no range join.
    """
    low, high = covered_range(start, end, first, last)
    return df.where(low <= high).withColumn("day", F.explode(F.sequence(low, high)))


def with_fallback(df: DataFrame, table: DataFrame, wanted: str, key: str, usable: Column, default: Column, fields: Sequence[str]) -> DataFrame:
    """Adds fields of the wanted row if it is usable, else of the lowest usable default, else null."""
    spare = table.where(usable & default).agg(F.min_by(F.struct(*fields), F.col(key)).alias("__spare"))
    own = table.where(usable).select(F.col(key).alias("__key"), F.struct(*fields).alias("__own"))
    joined = df.join(own, F.col(wanted) == F.col("__key"), "left").withColumn("__one", F.lit(1))
    joined = joined.join(F.broadcast(spare.withColumn("__one", F.lit(1))), "__one", "left")  # spare is one row
    return joined.select(*df.columns, *[F.coalesce(f"__own.{c}", f"__spare.{c}").alias(f"{c}") if c not in df.columns else F.coalesce(f"__own.{c}", f"__spare.{c}").alias(f"found_{c}") for c in fields])
