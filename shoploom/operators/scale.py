"""Operators that keep the work of one task bounded where a key, a page or a text could grow without end."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a histogram, and rows that one task may sort.
BOUNDS, TASK_ROWS = 200, 200_000


# --- rows dealt out ---


def parts_of(df: DataFrame, task_rows: int = TASK_ROWS) -> int:
    """How many parts of about task_rows rows df has: one count, and a number of partitions that is not merged again."""
    return max(1, math.ceil(df.count() / task_rows))


def join_spread(df: DataFrame, table: DataFrame, key: Column, id: Column, row: Column) -> DataFrame:
    """df left-joined to the rows of the table whose id is its key, both of one type.

    Rows without a key meet nothing, so they are dealt out by row, a column that differs
    between them, and don't come together in one task.
    """
    dealt = df.withColumn("__spread", F.coalesce(F.when(key.isNotNull(), F.xxhash64(key)), F.xxhash64(row)))
    met = table.withColumn("__at", F.xxhash64(id))
    return dealt.join(met, (F.col("__spread") == F.col("__at")) & (key == id), "left").drop("__spread", "__at")


# --- histograms ---


def bounds_of(df: DataFrame, column: str, n: int = BOUNDS) -> list:
    """Some values of a column of numbers, dates or times that part its rows about equally, ascending and distinct.

    They come from a sketch: one pass, and a bounded result. A value that more than
    one in n rows has is among them.
    """
    found = df.agg(F.percentile_approx(column, [k / n for k in range(n + 1)], 10_000).alias("b")).first().b or []
    return sorted(set(found))


def _literal(value, kind: str) -> Column:
    return F.lit(str(value) if kind in ("timestamp_ntz", "date") else value).cast(kind)


def segment_of(column: str, bounds: Sequence, kind: str) -> Column:
    """Where a value stands: 2k + 1 at the k-th bound, 2k between the bounds around it; null for null. Found by halving."""
    c = F.col(column)

    def among(low: int, high: int) -> Column:  # bounds before low are less than the value, from high on greater
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        at = _literal(bounds[middle], kind)
        return F.when(c < at, among(low, middle)).when(c == at, F.lit(2 * middle + 1)).otherwise(among(middle + 1, high))

    return F.when(c.isNotNull(), among(0, len(bounds)))


def _segment(column: str, bounds: Sequence, kind: str, first: int, last: int) -> Column:
    """The rows of the segments from first to last."""
    c, parts = F.col(column), [F.col(column).isNotNull()]
    if first > 0:
        low = _literal(bounds[(first - 1) // 2], kind)
        parts.append(c >= low if first % 2 else c > low)
    if last < 2 * len(bounds):
        high = _literal(bounds[last // 2], kind)
        parts.append(c <= high if last % 2 else c < high)
    return reduce(lambda a, b: a & b, parts)


# --- deep pages ---


@dataclass(frozen=True)
class By:
    """A sort key: a column of numbers, dates or times, its direction, and where nulls stand (by default as in PostgreSQL)."""

    column: str
    descending: bool = False
    nulls_first: bool | None = None

    def begins_with_nulls(self) -> bool:
        return self.descending if self.nulls_first is None else self.nulls_first

    def order(self) -> Column:
        c, first = F.col(self.column), self.begins_with_nulls()
        if self.descending:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()


def deep_page(df: DataFrame, keys: Sequence[By], number: int, limit: int = 50, task_rows: int = TASK_ROWS, bounds: int = BOUNDS) -> DataFrame:
    """Page number (from 1) of df in the order of keys, without sorting what stands before it.

    A histogram of the first key counts the rows of each segment, and running counts say
    in which one the page lies. A segment of over task_rows rows gets a histogram of its
    own; one of a single value is parted by the next key. Each step is one grouped count
    behind a filter that the scan can take; then the segment of the page is sorted and
    no other. Rows that all keys leave equal stand in any order. Beyond the last row
    a page is empty.
    """
    return _rows_from(df, list(keys), (number - 1) * limit, limit, task_rows, bounds, None)


def _rows_from(df: DataFrame, keys: list[By], skip: int, limit: int, task_rows: int, n_bounds: int, rows: int | None) -> DataFrame:
    order = [k.order() for k in keys]
    if not keys:
        return df.offset(skip).limit(limit)
    if rows is None:
        rows = df.count()
    if rows <= task_rows:
        return df.orderBy(*order).offset(skip).limit(limit)
    key = keys[0]
    kind, bounds = dict(df.dtypes)[key.column], bounds_of(df, key.column, n_bounds)
    counts = {r.at: r.n for r in df.groupBy(segment_of(key.column, bounds, kind).alias("at")).agg(F.count("*").alias("n")).collect()}  # a row for each segment
    at = sorted((s for s in counts if s is not None), reverse=key.descending)
    at = ([None, *at] if key.begins_with_nulls() else [*at, None]) if None in counts else at
    # neighbouring segments that are small together are one
    runs: list[tuple[list, int]] = []
    for s in at:
        if runs and None not in (s, runs[-1][0][-1]) and runs[-1][1] + counts[s] <= task_rows:
            runs[-1] = ([*runs[-1][0], s], runs[-1][1] + counts[s])
        else:
            runs.append(([s], counts[s]))
    found, before = [], 0
    for own, n in runs:
        first, last = max(skip - before, 0), min(skip + limit - before, n)
        if first < last:
            part = df.where(F.col(key.column).isNull() if own == [None] else _segment(key.column, bounds, kind, min(own), max(own)))
            single = len(own) == 1 and (own[0] is None or own[0] % 2)
            found.append(_rows_from(part, keys[1:] if single else keys, first, last - first, task_rows, n_bounds, n))
        before += n
    return reduce(DataFrame.unionByName, found).orderBy(*order) if found else df.limit(0)


# --- children of hot parents ---


def numbered(df: DataFrame, key: str, by: str, order: Sequence[Column], name: str = "number", bounds: int = BOUNDS) -> DataFrame:
    """Numbers the rows of each key from 1, by the column by and then in order, however many rows a key has.

    The column's segments are sorted each on its own; running sums over their counts put
    them behind each other. Nulls come first. A segment holds about one in bounds of all
    rows at most, unless these have one value.
    """
    at = segment_of(by, bounds_of(df, by, bounds), dict(df.dtypes)[by])
    dealt = df.withColumn("__at", F.coalesce(at, F.lit(-1)))
    counts = dealt.groupBy(key, "__at").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(key).alias("__key"), F.col("__at").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = dealt.withColumn("__row", F.row_number().over(Window.partitionBy(key, "__at").orderBy(F.col(by).asc_nulls_first(), *order)))
    met = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__at") == F.col("__of"))
    return inside.join(starts, met).withColumn(name, F.col("__before") + F.col("__row")).select(*df.columns, name)


def nest_in_parts(children: DataFrame, key: str, by: str, fields: Sequence[str], name: str, per_row: int = 10_000, bounds: int = BOUNDS) -> DataFrame:
    """(key, part, name): the children of each key in order of by and then fields, as lists of at most per_row.

    A key of few children has one row, part 0; a hot one has as many as it takes, so no
    row and no sort is larger than that.
    """
    ranked = numbered(children, key, by, [F.col(f).asc_nulls_first() for f in fields], "__number", bounds)
    part = F.expr(f"(__number - 1) div {per_row}").alias("part")
    lists = ranked.groupBy(key, part).agg(F.sort_array(F.collect_list(F.struct("__number", F.struct(*fields).alias("__child")))).alias("__own"))
    return lists.select(key, "part", F.transform("__own", lambda c: c["__child"]).alias(name))


# --- the value before ---


def changed_rows(df: DataFrame, key: str, value: str, order: Sequence[str], bucket: Column, old: str = "old", task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows whose value differs from that of the row before of their key, which is added as old; the first row of a key has null before it.

    bucket must rise with the order. Keys of over task_rows rows are dealt out by it: their
    rows look at the one before within their bucket, and the last value of each bucket
    is carried to the first row of the key's next one, however many empty ones lie
    between. So a task sorts a bucket of such a key, not the key.
    """
    hot = df.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n")).where(F.col("__n") > task_rows)
    marked = df.join(hot, F.col(key).eqNullSafe(F.col("__hot")), "left")
    dealt = marked.withColumn("__bucket", F.when(F.col("__n").isNotNull(), bucket)).drop("__hot")
    sort = [F.col(c).asc_nulls_first() for c in order]
    own = Window.partitionBy(key, "__bucket").orderBy(*sort)
    last = dealt.where(F.col("__n").isNotNull()).groupBy(key, "__bucket").agg(F.max_by(F.struct(value), F.struct(*order)).alias("__last"))
    carried = last.select(F.col(key).alias("__key"), F.col("__bucket").alias("__of"), F.lag("__last").over(Window.partitionBy(key).orderBy(F.col("__bucket").asc_nulls_first()))[value].alias("__carried"))
    inside = dealt.withColumns({"__row": F.row_number().over(own), "__before": F.lag(value).over(own)})
    first = inside.join(carried, (F.col("__row") == 1) & F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__of")), "left")
    before = first.withColumn(old, F.when(F.col("__row") == 1, F.col("__carried")).otherwise(F.col("__before")))
    return before.where(~F.col(old).eqNullSafe(F.col(value))).select(*df.columns, old)


# --- texts that contain a text ---


def _grams(text: Column, lengths: Sequence[int]) -> Column:
    one = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[one(n) for n in lengths])))


def latest_containing(asked: DataFrame, pattern: str, table: DataFrame, text: str, order: Column, value: Column, name: str, n: int = 3) -> DataFrame:
    """Adds, as name, the value of the last row in order whose text contains the pattern.

    The texts' grams of n letters are an inverted index. A pattern looks under the rarest
    of its own grams (a shorter one under itself), then candidates are verified; signs
    like % have no special meaning. Equal texts and patterns are looked at once. An empty
    pattern is in every text; a null one, and one that no text contains, gives null.
    """
    texts = table.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("__text")).agg(F.max(F.struct(order.alias("at"), value.alias("value"))).alias("__hit"))
    patterns = asked.where(F.length(F.col(pattern)) > 0).select(F.col(pattern).alias("__pattern")).distinct()
    lengths = range(1, n + 1)
    own = patterns.select("__pattern", F.explode(F.when(F.length("__pattern") < n, F.array("__pattern")).otherwise(_grams(F.col("__pattern"), [n]))).alias("__gram"))
    index = texts.select("__text", "__hit", F.explode(_grams(F.col("__text"), lengths)).alias("__gram"))
    sizes = index.join(own.select("__gram").distinct(), "__gram", "left_semi").groupBy("__gram").agg(F.count("*").alias("__n"))
    ranked = own.join(sizes, "__gram", "left").groupBy("__pattern").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("gram"))).alias("__rarest"))
    rarest = ranked.where("__rarest.n > 0").select("__pattern", F.col("__rarest.gram").alias("__gram"))
    hits = index.join(rarest, "__gram").where(F.contains("__text", "__pattern")).groupBy("__pattern").agg(F.max("__hit").alias("__hit"))
    newest = texts.agg(F.max("__hit").alias("__hit")).select(F.lit("").alias("__pattern"), "__hit")
    found = hits.unionByName(newest).select("__pattern", F.col("__hit.value").alias(name))
    return asked.join(found, F.col(pattern) == F.col("__pattern"), "left").drop("__pattern")


# --- how many stand ---


def standing_counts(df: DataFrame, start: Column, end: Column, calendar: DataFrame, first: str, last: str, name: str = "standing") -> DataFrame:
    """Adds to each day of a calendar how many intervals [start, end] stand on it; an end of null is open, a start of null is none.

    An interval is two events at most, however long it is: +1 on its first day of the
    calendar and -1 behind its last one; a running sum over the days gives the counts.
    """
    changes = change_events(df, start, end, first, last).groupBy("day").agg(F.sum("change").alias(name))
    return running(calendar.join(changes, "day", "left").fillna(0, [name]), name)


def change_events(df: DataFrame, start: Column, end: Column, first: str, last: str) -> DataFrame:
    """df's rows as events (day, change): at most two for each row, none for one that never stands from first to last."""
    low, high = F.greatest(start, F.lit(first).cast("date")), F.coalesce(end, F.lit(last).cast("date"))
    stands = start.isNotNull() & (low <= high) & (low <= F.lit(last).cast("date"))
    event = lambda day, change: F.struct(day.alias("day"), F.lit(change).cast("long").alias("change"))
    both = F.array(event(low, 1), event(F.date_add(high, 1), -1))
    return df.where(stands).select("*", F.explode(F.filter(both, lambda e: e.day <= F.lit(last).cast("date"))).alias("__e")).select(*df.columns, "__e.day", "__e.change")


def running(calendar: DataFrame, *names: str) -> DataFrame:
    """Running sums of columns over the days of a calendar: as many rows as days, whatever was counted."""
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calendar.withColumns({n: F.sum(n).over(so_far) for n in names})


# --- numbers that are given out ---


def high_marks(stored: DataFrame, number: str, name: str = "high") -> DataFrame:
    """(prefix, high): the highest number given for each prefix of stored texts like ORD-2026-JUL-0009; others count for nothing."""
    text = F.col(number)
    parts = stored.select(F.regexp_extract(text, r"^(.*-)([0-9]+)$", 1).alias("prefix"), F.expr(f"try_cast(regexp_extract({number}, '^(.*-)([0-9]+)$', 2) as bigint)").alias("n"))
    return parts.where("prefix <> '' and n is not null").groupBy("prefix").agg(F.max("n").alias(name))


def give_numbers(rows: DataFrame, prefix: str, by: str, order: Sequence[Column], marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with the next numbers of their prefix, gap-free behind its high-water mark in the order of by and then order, and the new marks.

    marks is (prefix, high) and outlives the rows it came from: a number that was given is
    not given again, whatever is deleted. A prefix without a mark begins at 1.
    """
    fresh = numbered(rows, prefix, by, order, "__number")
    joined = fresh.join(marks.select(F.col("prefix").alias("__prefix"), F.col("high").alias("__high")), F.col(prefix) == F.col("__prefix"), "left")
    given = joined.withColumn("number", F.coalesce("__high", F.lit(0)) + F.col("__number")).drop("__prefix", "__high", "__number")
    counts = rows.groupBy(F.col(prefix).alias("prefix")).agg(F.count("*").alias("high"))
    return given, marks.select("prefix", "high").unionByName(counts).groupBy("prefix").agg(F.sum("high").alias("high"))


# --- copies that are compared ---


def _digests(df: DataFrame, key: str, columns: Sequence[str], segment: Column) -> DataFrame:
    """The number of rows of each segment, and two order-free digests of them."""
    h = lambda seed: F.xxhash64(F.lit(seed), key, *columns)
    return df.groupBy(segment.alias("at")).agg(F.count("*").alias("n"), F.sum(h(1).cast("decimal(38,0)")).alias("a"), F.bit_xor(h(2)).alias("b"))


def differences(source: DataFrame, target: DataFrame, key: str, leaf_rows: int = 10_000, bounds: int = 32) -> DataFrame:
    """(key, column, source_value, target_value): what of a source isn't so in its copy; column is null for a row that only one side has.

    Both sides give a count and order-free digests for each range of the key; only ranges
    that differ are parted and read again, behind a filter that the scan can take, until
    they are small. Their rows are then compared cell by cell. Columns that both have
    count. The key is a unique number, date or time; a row without one differs from all.
    Equal rows that the digests would take for different don't exist; the reverse asks for
    a collision of 128 bits.
    """
    columns = [c for c in source.columns if c in target.columns and c != key]
    a, b = source.select(key, *columns), target.select(key, *[F.col(c).cast(dict(source.dtypes)[c]).alias(c) for c in columns])
    kind, leaves, todo = dict(a.dtypes)[key], [], [F.col(key).isNotNull()]
    while todo:
        where = todo.pop()
        parts = bounds_of(a.where(where), key, bounds)
        segment = segment_of(key, parts, kind)
        own, other = ({r.at: (r.n, r.a, r.b) for r in _digests(df.where(where), key, columns, segment).collect()} for df in (a, b))  # a row for each segment
        for at in sorted(s for s in own.keys() | other.keys() if own.get(s) != other.get(s)):
            part = where & _segment(key, parts, kind, at, at)
            rows = max(d.get(at, (0,))[0] for d in (own, other))
            (leaves if rows <= leaf_rows or at % 2 or not parts else todo).append(part)
    pick = reduce(lambda x, y: x | y, leaves) if leaves else F.lit(False)
    pick = pick | F.col(key).isNull()
    left = a.where(pick).select(F.col(key).alias("__a"), F.struct(*columns).alias("__x")).withColumn("__l", F.lit(True))
    right = b.where(pick).select(F.col(key).alias("__b"), F.struct(*columns).alias("__y")).withColumn("__r", F.lit(True))
    met = left.join(right, F.col("__a") == F.col("__b"), "full")
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    cell = lambda c: F.when(~F.col(f"__x.{c}").eqNullSafe(F.col(f"__y.{c}")), F.struct(F.lit(c).alias("column"), text("__x", c).alias("source_value"), text("__y", c).alias("target_value")))
    lone = F.struct(F.lit(None).cast("string").alias("column"), F.when(F.col("__l"), "row").alias("source_value"), F.when(F.col("__r"), "row").alias("target_value"))
    cells = F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.array(lone)).otherwise(F.filter(F.array(*[cell(c) for c in columns]), lambda x: x.isNotNull()) if columns else F.array().cast("array<struct<column:string,source_value:string,target_value:string>>"))
    return met.select(F.coalesce("__a", "__b").alias(key), F.explode(cells).alias("__c")).select(key, "__c.*")
