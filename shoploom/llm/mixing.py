"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

The rows of each source, in a fixed pseudo-random order, are cut into blocks.
With weight w of all weights W, a source should have placed w * t / W blocks among
the first t. Its j-th block (from 0) is therefore released at floor(j * W / w)
and due at ceil((j + 1) * W / w), in whole numbers, and serving the released block
with the earliest deadline in each slot keeps every source within less than one
block of its share after every slot.

All shares are whole after W / g slots, g being the greatest common divisor of
the weights, so the schedule repeats after that period. Only one period is worked
out; a block looks up its turn in it. The slots of a source that is used up stay
empty: the others keep theirs, and no row is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in one block; what the default weights add up to, about. Both fix the result.
BLOCK_ROWS, SHARES = 64, 1000
#: Rows that share a leading part of the shuffling key; fixes the work of one sort, not the result.
BUCKET_ROWS = 512
#: Buckets, as a power of two, whose rows the upper level of the running sum takes together.
STRETCH_BITS = 10
#: Slots of a period at most.
MOST_SLOTS = 10_000_000
#: Copies of an equal row that are written out together.
COPIES = 4096

_GCD = "aggregate(sequence(1, 190), named_struct('a', {0}, 'b', {1}), (s, _) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"

#: Slots of a stretch; the order of each stretch is put together on its own, so appending stays cheap.
_STRETCH = 512
_EDF = f"""
flatten(aggregate(
  sequence(0L, (slots - 1) div {_STRETCH}),
  named_struct('done', transform(parts, p -> 0L), 'order', cast(array() as array<array<int>>)),
  (whole, stretch) -> transform(array(aggregate(
    sequence(stretch * {_STRETCH}, least(slots, (stretch + 1) * {_STRETCH}) - 1),
    named_struct('done', whole.done, 'order', cast(array() as array<int>)),
    (state, t) -> transform(
      array(array_min(filter(
        transform(parts, (p, i) -> if(
          state.done[i] < p.c and (state.done[i] * slots) div p.c <= t,
          named_struct('due', ((state.done[i] + 1) * slots + p.c - 1) div p.c, 'i', i),
          null)),
        x -> x is not null)).i),
      pick -> named_struct(
        'done', transform(state.done, (d, i) -> if(i = pick, d + 1, d)),
        'order', concat(state.order, array(pick))))[0])),
    part -> named_struct('done', part.done, 'order', concat(whole.order, array(part.order))))[0],
  whole -> whole.order))
"""


def _shares(weights: DataFrame, zero: str) -> DataFrame:
    """(src, x): weights as whole numbers in the proportion in which they are written."""
    text = F.col("weight").cast("string")
    x = F.expr("try_cast(weight as decimal(38, 18))") if dict(weights.dtypes)["weight"] != "double" and dict(weights.dtypes)["weight"] != "float" else F.expr("try_cast(cast(weight as string) as decimal(38, 18))")
    wrong = F.raise_error(F.concat(F.lit("not a weight from 0 to 10 ** 14: "), F.coalesce(text, F.lit("null"))))
    fine = F.col("weight").isNull() | (x.isNotNull() & (x >= 0) & (x < F.lit(10**14).cast("decimal(38,18)")) & ((x > 0) | (text.cast("double") == 0)))
    whole = F.when(fine, (x * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)")).otherwise(wrong.cast("decimal(38,0)"))
    given = weights.select(F.coalesce("source", F.lit("")).alias("src"), whole.alias("x")).groupBy("src").agg(F.max("x").alias("x"))
    return given if zero == "leave out" else given.where("x > 0")


def weighted(docs: DataFrame, weights: DataFrame | None = None, zero: str = "least") -> DataFrame:
    """(src, n, w): the rows and the whole weight of each source of docs.

    Given weights are numbers of any type, fractions too, and are scaled to whole ones
    in exactly the proportion in which they are written, up to 18 decimal places: 0.7,
    0.2 and 0.1 are 7, 2 and 1. A source without a weight has the least one given. So
    does one of weight 0, or with zero="leave out" it isn't in the result, and its rows
    aren't in the mix. What is no number, is negative, or not below 10 ** 14, raises.

    By default a source weighs the square root of its rows, as for language
    sampling with temperature 2, in thousandths of the sum of those roots and 1 at
    least.
    """
    if zero not in ("least", "leave out"):
        raise ValueError('zero is "least" or "leave out"')
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("src")).agg(F.count("*").alias("n"))
    if weights is not None:
        joined = sizes.join(_shares(weights, zero), "src", "left").withColumn("one", F.lit(1))
        # what the weights of all sources are measured by: the least one, and the greatest divisor of all, in one row
        unit = joined.where("x > 0").groupBy("one").agg(F.min("x").alias("least"), F.collect_set("x").alias("xs"))
        unit = unit.withColumn("unit", F.expr(f"aggregate(xs, cast(0 as decimal(38,0)), (a, b) -> {_GCD.format('b', 'a')})")).drop("xs")
        scaled = joined.join(unit, "one", "left").withColumn("w", F.expr("coalesce(cast(coalesce(x, least) div unit as bigint), 1L)"))
        return scaled.where("w > 0").select("src", "n", "w")
    roots = sizes.withColumn("root", F.greatest(F.floor(F.sqrt("n")), F.lit(1)))
    total = roots.agg(F.sum("root").alias("total")).withColumn("one", F.lit(1))
    shared = roots.withColumn("one", F.lit(1)).join(total, "one")
    return shared.select("src", "n", F.expr(f"greatest(1L, ({2 * SHARES} * root + total) div (2 * total))").cast("long").alias("w"))


def schedule(sources: DataFrame) -> DataFrame:
    """(src, turn, slot, turns, period): the slot of each of a source's blocks in one period of the mix.

    One row holds all sources: their number is bounded by the table of weights. It
    takes (sum of weights / their divisor) x sources steps; more slots than MOST_SLOTS
    raise.
    """
    all_of = sources.agg(F.sort_array(F.collect_list(F.struct("src", "w"))).alias("all"))
    divisor = f"aggregate(all, 0L, (x, s) -> {_GCD.format('s.w', 'x')})"
    shape = all_of.withColumn("g", F.expr(divisor)).where("g > 0").select(
        F.expr("transform(all, s -> named_struct('src', s.src, 'c', s.w div g))").alias("parts"),
        F.expr("aggregate(all, 0L, (x, s) -> x + s.w) div g").alias("slots"),
    )
    long = F.raise_error(F.concat(F.lit("round the weights: the mix would repeat only after this many blocks: "), F.col("slots").cast("string")))
    shape = shape.withColumn("slots", F.when(F.col("slots") <= MOST_SLOTS, F.col("slots")).otherwise(long.cast("long")))
    placed = shape.select("slots", "parts", F.posexplode(F.expr(_EDF)).alias("slot", "pick")).select("slots", F.col("slot").cast("long").alias("slot"), F.expr("parts[pick]").alias("p"))
    turn = F.row_number().over(Window.partitionBy("p.src").orderBy("slot")) - 1
    return placed.select(F.col("p.src").alias("src"), turn.cast("long").alias("turn"), "slot", F.col("p.c").alias("turns"), F.col("slots").alias("period"))


def _ranked(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(row, src, rank): a place for every row among those of its source, from 0.

    The order is that of a hash of doc_id (of the whole row, where it is null), then
    of doc_id, then of a hash of the row. Equal rows are counted first and written
    out last, and the rows of a doc_id that many rows share are dealt out by the
    hash of the row, so no bucket holds more than a few thousand rows.
    """
    row, bits60 = F.struct(*columns), lambda text: F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    row_hash = F.xxhash64("row")
    keyed = (
        docs.select(row.alias("row"), F.coalesce("source", F.lit("")).alias("src"), "doc_id")
        .withColumn("rh", row_hash)
        .withColumn("h", bits60(F.coalesce(F.col("doc_id").cast("string"), F.col("rh").cast("string"))))
        .groupBy("src", "h", "rh", "row")
        .agg(F.count("*").alias("copies"))
    )
    n = docs.count()
    bits = max(1, math.ceil(math.log2(n / BUCKET_ROWS))) if n > BUCKET_ROWS else 1
    keyed = keyed.withColumn("bucket", F.shiftright("h", 60 - bits))
    crowded = keyed.groupBy("src", "bucket", "h").agg(F.count("*").alias("rows")).where(F.col("rows") > BUCKET_ROWS)
    crowded = crowded.groupBy("src", "bucket").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    placed = keyed.join(crowded, ["src", "bucket"], "left").withColumn("hs", F.coalesce("hs", F.array().cast("array<bigint>")))
    # rows between two crowded hashes, then the rows of the next one by their own hash
    own = F.array_contains("hs", F.col("h"))
    piece = F.struct(F.size(F.filter("hs", lambda x: x < F.col("h"))).alias("a"), own.alias("b"), F.when(own, F.shiftright("rh", 52)).otherwise(0).alias("c"))
    placed = placed.withColumn("piece", piece).drop("hs")

    sizes = placed.groupBy("src", "bucket", "piece").agg(F.sum("copies").alias("rows"))
    sizes = sizes.withColumn("stretch", F.shiftright("bucket", STRETCH_BITS))
    upper = Window.partitionBy("src").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    above = sizes.groupBy("src", "stretch").agg(F.sum("rows").alias("rows")).select("src", "stretch", F.coalesce(F.sum("rows").over(upper), F.lit(0)).alias("above"))
    lower = Window.partitionBy("src", "stretch").orderBy("bucket", "piece").rowsBetween(Window.unboundedPreceding, -1)
    below = sizes.select("src", "stretch", "bucket", "piece", F.coalesce(F.sum("rows").over(lower), F.lit(0)).alias("below"))
    first = below.join(above, ["src", "stretch"]).select("src", "bucket", "piece", (F.col("above") + F.col("below")).alias("first"))
    within = Window.partitionBy("src", "bucket", "piece").orderBy("h", F.col("row.doc_id"), "rh").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.withColumn("i", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(first, ["src", "bucket", "piece"])
    counted = counted.select("row", "src", (F.col("first") + F.col("i")).alias("from"), "copies")
    single = counted.where("copies = 1").select("row", "src", F.col("from").alias("rank"))
    lots = counted.where("copies > 1").select("row", "src", F.explode(F.expr(f"transform(sequence(0L, (copies - 1) div {COPIES}), k -> named_struct('at', from + k * {COPIES}, 'n', least({COPIES}, copies - k * {COPIES})))")).alias("lot"))
    written = lots.repartition("src", "lot.at").select("row", "src", F.explode(F.expr("sequence(lot.at, lot.at + lot.n - 1)")).alias("rank"))
    return single.unionByName(written)


def mix(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, zero: str = "least") -> DataFrame:
    """Adds block (of its source), slot (of the block in the mix) and position to every row.

    docs needs doc_id and source; weights has source and weight, as weighted() takes
    them, which also gives the default and says what zero does. A null
    source counts as the empty name. Rows with equal or null doc_id keep one place
    each, in an order fixed by their columns. Input columns named block, slot or
    position are replaced. An empty table gives an empty result.

    Slots follow the weights exactly; those of a source that is used up stay empty.
    position is slot * block_rows + the place within the block: unique and ascending
    through the mix, with gaps at empty slots and after the short last block of a source.
    """
    extra = [c for c in docs.columns if c not in ("block", "slot", "position")]
    plan = schedule(weighted(docs, weights, zero))
    turns = plan.groupBy("src").agg(F.max("turns").alias("turns"), F.max("period").alias("period"))
    ranked = (
        _ranked(docs, extra)
        .withColumn("block", F.expr(f"rank div {block_rows}"))
        .join(turns, "src")
        .withColumn("turn", F.expr("block % turns"))
    )
    placed = ranked.join(plan.select("src", "turn", F.col("slot").alias("at")), ["src", "turn"])
    slot = F.expr("block div turns * period + at")
    return placed.select("row.*", "block", slot.alias("slot"), (slot * block_rows + F.expr(f"rank % {block_rows}")).alias("position"))


def parted(mixed: DataFrame, rows: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """mixed with part, which rises with position and holds about that many rows each, and the number of parts.

    Rows are counted for each stretch of slots that has room for that many, and a
    running sum over the counts says where a stretch stands: no rows are sorted for
    it, and the number of sources doesn't matter. A column n counts a row that often.
    mixed should be stored: it is read twice.
    """
    own = F.col("n") if "n" in mixed.columns else F.lit(1)
    stretch = F.floor(F.col("slot") / max(1, rows // block_rows))
    counts = mixed.groupBy(stretch.alias("stretch")).agg(F.sum(own).alias("rows")).withColumn("upper", F.shiftright("stretch", STRETCH_BITS))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    above = counts.groupBy("upper").agg(F.sum("rows").alias("rows")).select("upper", F.coalesce(F.sum("rows").over(before.orderBy("upper")), F.lit(0)).alias("above"))
    below = F.coalesce(F.sum("rows").over(before.partitionBy("upper").orderBy("stretch")), F.lit(0))
    placed = counts.select("upper", F.col("stretch").alias("at"), below.alias("below")).join(above, "upper")
    part = placed.select("at", F.floor((F.col("above") + F.col("below")) / rows).cast("int").alias("part"))
    total = counts.agg(F.sum("rows").alias("n")).first().n or 0
    return mixed.join(part, stretch == F.col("at")).drop("at"), max(1, -(-total // rows))
