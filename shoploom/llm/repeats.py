"""Removal of repeated 100-byte strings by suffix arrays, built by the difference-cover algorithm.

A suffix array of the whole corpus would sort every byte, over and over. Only
strings that could repeat are sorted instead, and Spark brings those together that
could be equal. Each 100-byte window belongs to its anchor: of the 24-byte strings
in it, the one with the least hash. Equal windows have equal anchors, so only
windows of anchors that occur twice can repeat. Consecutive windows of one anchor
form a segment, and the segments of an anchor meet as one group.

The segments of a group are laid end to end, and their suffix array is built:
triples at two of three places, with the symbols after them that a key can hold,
are sorted and named, the names' suffix array follows by recursion until names tell
all apart or are longer than a window, the remaining places where windows begin are
merged in. Neighbours in it with
100 equal bytes are equal windows, and all but the first are removed. Hashes only
say what meets what; every window that is removed has been compared byte by byte.

A group beyond a size is dealt out into several. Each leaves the windows that are
the first of their kind in it, and these meet again, under longer anchors, which
tell contexts apart that share a common line, until every group is small; with
anchors as long as windows only equal windows still meet.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Bytes of a window; bytes of its anchor, and of the anchors of groups that stay too large.
LENGTH, ANCHORS = 100, (24, 64, 100)
#: Bytes of a text that are searched at once; bytes of segments that are sorted at once.
PIECE, SORTED_BYTES = 1 << 16, 1 << 17
#: Segments that one group has on average, at most.
GROUP = 1000
BATCH_ROWS = 256
#: Segments of a task that are looked through for repeated anchors before the shuffle.
TOGETHER = 200_000

_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.full(n, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 2**64)))


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A mixed hash of the bytes, so many, from each place on."""
    up, down = _powers(PIECE + LENGTH)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row."""
    have = 1
    while have < w:
        more = min(have, w - have)
        v, have = np.minimum(v[:-more], v[more:]), have + more
    return v


def segments(data: bytes, anchor: int = ANCHORS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of the anchor, first window and number of windows of each segment of a text."""
    keys, first, count = [], [], []
    last = len(data) - LENGTH  # the last window
    low = np.uint64((1 << 17) - 1)
    for at in range(0, last + 1, PIECE):
        part = np.frombuffer(data, np.uint8, min(PIECE + LENGTH - 1, len(data) - at), at)
        h = _hashes(part, anchor)
        own = _least((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - anchor + 1) & low  # ties: the first place
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        keys.append(h[own[edge].astype(np.int64)].view(np.int64))
        first.append(edge + at)
        count.append(np.diff(np.append(edge, len(own))))
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(keys), np.concatenate(first), np.concatenate(count)


# --- suffix arrays ---------------------------------------------------------


def suffix_array(s: np.ndarray, wanted: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
    """Of positive whole numbers, by the difference cover {1, 2} modulo 3.

    With a mask of wanted places, of these alone; with a depth, places whose next
    numbers are the same, so many or more, stand together in any order.
    """
    return _ordered(s, np.ones(len(s), bool) if wanted is None else wanted, 1, 1, np.inf if depth is None else depth)


def _ordered(s: np.ndarray, wanted: np.ndarray, reach: int, step: int, depth: float) -> np.ndarray:
    """suffix_array of names that stand for so many numbers (reach) each, and begin so many apart (step)."""
    n = len(s)
    if n < 3:
        return np.array(sorted(np.flatnonzero(wanted).tolist(), key=lambda i: s[i:].tolist()), np.int64)
    size = int(s.max()) + 1
    bits = (size - 1).bit_length()
    t = np.zeros(n + 64, np.int64)
    t[:n] = s
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a one past the end keeps the halves apart
    sample = np.concatenate([ones, twos])
    low = len(sample).bit_length()
    if bits <= 21:  # a key holds three numbers, and all others that fit; where it can, its place in the sample too
        with_place = 3 * bits <= 64 - low
        taken = (64 - low if with_place else 64) // bits
        key, u = np.empty(len(sample), np.uint64), t.view(np.uint64)
        for part, at in ((key[: len(ones)], 1), (key[len(ones) :], 2)):
            part[:] = u[at : at + 3 * len(part) : 3]
            for k in range(at + 1, at + taken):
                part <<= np.uint64(bits)
                part |= u[k : k + 3 * len(part) : 3]
        if with_place:
            key <<= np.uint64(low)
            key |= np.arange(len(key), dtype=np.uint64)
            key.sort()
            order = (key & np.uint64((1 << low) - 1)).view(np.int64)
            key >>= np.uint64(low)
        else:
            order = np.argsort(key)
            key = key[order]
        new = np.append(True, key[1:] != key[:-1])
    else:
        taken = 3
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        rows = np.stack([t[sample + k][order] for k in range(3)])
        new = np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)])
    among = np.zeros(n + 3, bool)
    among[:n] = wanted
    need = among.copy()  # a wanted place is compared by the ranks of the next two
    need[1:] |= among[:-1]
    need[2:] |= among[:-2]
    need = need[sample]
    reach += (taken - 1) * step
    if reach < depth and not new.all():
        names = np.empty(len(sample), np.int32)
        names[order] = np.cumsum(new, dtype=np.int32)
        order = _ordered(names, need, reach, 3 * step, depth)
    else:
        order = order[need[order]]
    sorted12 = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted12] = np.arange(1, len(sorted12) + 1)

    rest = 3 * np.flatnonzero(among[:n:3])
    many = len(sorted12) + 1
    zero_key = np.sort(t[rest] * many + rank[rest + 1])
    rest = sorted12[zero_key % many - 1] - 1
    sorted12 = sorted12[among[sorted12]]
    is_one = sorted12 % 3 == 1
    a, b = sorted12[is_one], sorted12[~is_one]
    below = np.searchsorted(t[a] * many + rank[a + 1], zero_key)
    if size * size * many < 1 << 62:
        two = lambda i: (t[i] * size + t[i + 1]) * many + rank[i + 2]
    else:  # name the pairs first
        pair = t[np.concatenate([rest, b])] * size + t[np.concatenate([rest, b]) + 1]
        name = np.empty(n + 3, np.int64)
        name[np.concatenate([rest, b])] = np.unique(pair, return_inverse=True)[1]
        two = lambda i: name[i] * many + rank[i + 2]
    below += np.searchsorted(two(b), two(rest))
    out = np.empty(len(rest) + len(sorted12), np.int64)
    place = np.maximum.accumulate(below) + np.arange(len(rest))  # among places that are the same to the depth, keys may fall
    out[place] = rest
    free = np.ones(len(out), bool)
    free[place] = False
    out[free] = sorted12
    return out


def later_windows(data: np.ndarray, size: np.ndarray, doc: np.ndarray, sub: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window of it), in order, of every window that equals an earlier one of these segments, laid end to end in data.

    Segments of one (doc, sub) share no window.
    """
    start = np.cumsum(size) - size
    windows = np.maximum(size - LENGTH + 1, 0)
    base = np.cumsum(windows) - windows
    segment = np.repeat(np.arange(len(size)), windows)
    place = np.arange(len(segment)) + np.repeat(start - base, windows)
    wanted = np.zeros(len(data), bool)
    wanted[place] = True
    order = suffix_array(data.astype(np.int64) + 1, wanted, LENGTH)  # a window ends within its segment, so no separators
    eight = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,)).copy()  # the eight bytes from each place on
    same = np.ones(len(order), bool)
    same[:1] = False
    for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        word = eight[at:].take(order)
        same[1:] &= word[1:] == word[:-1]
    # only windows with an equal neighbour need an order of their own
    some = np.flatnonzero(same | np.append(same[1:], False))
    if not len(some):
        return some, some
    order, head = order[some], np.flatnonzero(~same[some])
    turn = np.lexsort((first, sub, doc))
    age = np.empty(len(size), np.int64)
    age[turn] = np.cumsum(windows[turn]) - windows[turn]
    of_place = np.empty(len(data), np.int64)
    of_place[place] = np.arange(len(segment)) + np.repeat(age - base, windows)
    age = of_place[order]
    least = np.repeat(np.minimum.reduceat(age, head), np.diff(np.append(head, len(age))))
    gone = np.zeros(len(data), bool)
    gone[order[age != least]] = True
    found = np.flatnonzero(gone[place])
    return segment[found], found - base[segment[found]]


# --- stages ----------------------------------------------------------------


def _placed(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc, sub, data) of all rows, whose order is (doc, sub), and of one row of each (doc, sub).

    sub tells rows apart that share a doc_id, or have none, by some bits of a SHA-256
    of the text and a salt; it is 0 for all where there are no such rows. Where two
    texts of a doc_id have the same bits but not the same SHA-256, another salt is taken.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    if again.isEmpty():
        rows = docs.select("doc_id", doc.alias("doc"), F.lit(0).cast("long").alias("sub"), data.alias("data"))
        return rows, rows
    for salt in count():
        salted = data if salt == 0 else F.concat(data, F.lit(f"\0{salt}").cast("binary"))
        sub = F.conv(F.substring(F.sha2(salted, 256), 1, SUB_DIGITS), 16, 10).cast("long")
        whole = docs.join(again.select(F.col("doc_id").alias("again")), F.col("doc_id").eqNullSafe(F.col("again")), "left_semi")
        known = whole.select(doc.alias("doc"), sub.alias("sub"), F.sha2(data, 256).alias("whole")).groupBy("doc", "sub")
        if known.agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").isEmpty():
            break
    rows = docs.select("doc_id", doc.alias("doc"), sub.alias("sub"), data.alias("data"))
    return rows, rows.dropDuplicates(["doc", "sub"])


#: Hexadecimal digits of a sub.
SUB_DIGITS = 15
_SEGMENT = ("key", "doc", "sub", "first", "count")


def _asking(docs: DataFrame) -> DataFrame:
    """The segments of all texts, as (to, known, key, doc, sub, first, count).

    A segment whose anchor occurs again among those that are looked through with it
    is known to be wanted and goes anywhere; one of them, and the others, go to
    where their anchors meet.
    """
    names = ["to", "known", *_SEGMENT]

    def dealt(held):
        key, doc, sub, first, count = map(np.concatenate, held)
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        again = np.zeros(len(key), bool)
        again[by[1:]] |= same
        again[by[:-1]] |= same
        lead = np.zeros(len(key), bool)
        lead[by[1:]] = ~same
        lead[by[:1]] = True
        witness = again & lead
        spread = (doc * 31 + (first >> 12)) * -7046029254386353131
        known = np.concatenate([again.astype(np.int8), np.full(witness.sum(), 2, np.int8)])
        to = np.concatenate([np.where(again, spread, key), key[witness]])
        columns = [np.concatenate([c, c[witness]]) for c in (key, doc, sub, first, count)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (to, known, *columns)], names=names)

    def run(batches):
        none = [[np.zeros(0, np.int64)] for _ in _SEGMENT]
        held, size = [list(c) for c in none], 0
        for batch in batches:
            for doc, sub, data in zip(batch.column("doc").to_pylist(), batch.column("sub").to_pylist(), batch.column("data"), strict=True):
                key, first, count = segments(data.as_py())
                for column, new in zip(held, (key, np.full(len(key), doc), np.full(len(key), sub), first, count), strict=True):
                    column.append(new)
                size += len(key)
                if size >= TOGETHER:
                    yield dealt(held)
                    held, size = [list(c) for c in none], 0
        yield dealt(held)

    return docs.select("doc", "sub", "data").mapInArrow(run, "to long, known tinyint, key long, doc long, sub long, first long, count long")


def _wanted(rows: DataFrame) -> DataFrame:
    """The segments of anchors that occur twice. Rows stream by in the order of their anchors; one is kept between batches."""

    def run(batches):
        held, before = None, None  # the last asking row so far, and the anchor before it
        for batch in batches:
            known = batch.column("known").to_numpy()
            out = [c[known == 1] for c in (batch.column(n).to_numpy() for n in _SEGMENT)]
            asks = [batch.column(n).to_numpy()[known != 1] for n in ("known", *_SEGMENT)]
            if len(asks[0]):
                if held is not None:
                    asks = [np.concatenate([[h], c]) for h, c in zip(held, asks, strict=True)]
                key = asks[1]
                same = key[1:] == key[:-1]
                found = np.concatenate([[before is not None and before == key[0]], same]) | np.append(same, False)
                found &= asks[0] == 0
                found[-1] = False  # decided with the next batch
                held, before = [c[-1] for c in asks], (key[-2] if len(key) > 1 else before)
                out = [np.concatenate([a, c[found]]) for a, c in zip(out, asks[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=list(_SEGMENT))
        if held is not None and held[0] == 0 and before is not None and before == held[1]:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in held[1:]], names=list(_SEGMENT))

    met = rows.repartition("to").sortWithinPartitions("to")  # one number, which Spark sorts by its digits
    return met.mapInArrow(run, ", ".join(f"{n} long" for n in _SEGMENT))


def _in_groups(rows: DataFrame) -> tuple[DataFrame, bool]:
    """rows with group, a part of their anchor's rows, and crowded, where there are several; and whether there are any such."""
    crowded = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP))
    if crowded.isEmpty():
        return rows.withColumns({"group": F.lit(0).cast("long"), "crowded": F.lit(False)}), False
    joined = rows.join(crowded, "key", "left")  # a table of known size: few rows go to all, many are dealt out
    group = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("doc", "sub", "first"), F.ceil(F.col("n") / GROUP))).otherwise(0)
    return joined.withColumns({"group": group.cast("long"), "crowded": F.col("n").isNotNull()}).drop("n"), True


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted segments."""
    kept = ("key", "group", "crowded", "first")
    lists = wanted.groupBy("doc", "sub").agg(F.collect_list(F.struct(*kept, "count")).alias("parts"))
    bytes_of = lambda p: F.substring(F.col("data"), p["first"].cast("int") + 1, (p["count"] + LENGTH - 1).cast("int"))
    cut_out = lambda p: F.struct(*[p[c].alias(c) for c in kept], bytes_of(p).alias("data"))
    joined = docs.select("doc", "sub", "data").join(lists, ["doc", "sub"])
    return joined.select("doc", "sub", F.explode(F.transform("parts", cut_out)).alias("p")).select("p.key", "p.group", "p.crowded", "doc", "sub", "p.first", "p.data")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one behind the other, and where each value ends, with 0 first."""
    whole = pa.concat_arrays([c.cast(pa.binary()) for c in column.chunks])
    ends = np.frombuffer(whole.buffers()[1], np.int32)[: len(whole) + 1].astype(np.int64)
    return np.frombuffer(whole.buffers()[2] or b"", np.uint8)[: ends[-1]], ends


def _grouped(batches):
    """Whole groups of equal (key, group) from sorted batches, as many as arrive together: a table, and where groups begin."""
    held: list[pa.RecordBatch] = []

    def whole(parts):
        table = pa.Table.from_batches(parts)
        key, group = (table.column(c).to_numpy() for c in ("key", "group"))
        return table, np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))

    for batch in batches:
        if not batch.num_rows:
            continue
        key, group = batch.column("key").to_numpy(), batch.column("group").to_numpy()
        other = np.flatnonzero((key != key[-1]) | (group != group[-1]))
        at = int(other[-1]) + 1 if len(other) else 0
        if at or (held and (held[-1].column("key")[-1].as_py(), held[-1].column("group")[-1].as_py()) != (key[0], group[0])):
            yield whole([*held, batch.slice(0, at)])
            held = []
        held.append(batch.slice(at))
    if held:
        yield whole(held)


def _edges(*columns: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Where runs begin in sorted rows: another value in a column, or a step that isn't one."""
    new = np.ones(len(step), bool)
    new[1:] = step[1:] != step[:-1] + 1
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_COMPARED = "key long, doc long, sub long, start long, size long, data binary"


def _compared(rows: DataFrame) -> DataFrame:
    """What the groups' suffix arrays show, as (key, doc, sub, start, size, data).

    With data null, a run of bytes that begins with repeated windows; else, of
    crowded anchors, bytes whose windows are the first in their group.
    """

    def sort(data, ends, key, crowded, doc, sub, first):
        size = np.diff(ends)
        own, offset = later_windows(data, size, doc, sub, first)
        at = _edges(own, step=offset)
        last = np.append(at, len(own))[1:] - 1
        columns = [np.zeros(len(at), np.int64), doc[own[at]], sub[own[at]], first[own[at]] + offset[at], offset[last] - offset[at] + LENGTH]
        lengths, bytes_left = np.zeros(len(at), np.int64), np.zeros(0, np.uint8)
        if crowded.any():
            windows = np.where(crowded, size - LENGTH + 1, 0)
            base = np.cumsum(windows) - windows
            free = np.ones(int(windows.sum()), bool)
            gone = crowded[own]
            free[base[own[gone]] + offset[gone]] = False
            place = np.flatnonzero(free)
            owner = np.repeat(np.arange(len(size)), windows)[place]
            step = place - base[owner]
            run = _edges(owner, step=step)
            end = np.append(run, len(place))[1:] - 1
            who, begin, long = owner[run], step[run], step[end] - step[run] + LENGTH
            left = [key[who], doc[who], sub[who], first[who] + begin, long]
            columns = [np.concatenate(pair) for pair in zip(columns, left, strict=True)]
            starts = ends[who] + begin
            bytes_left = data[np.repeat(starts - np.cumsum(long) + long, long) + np.arange(long.sum())]
            lengths = np.concatenate([lengths, long])
        n, none = len(lengths), len(at)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        valid = pa.array(np.arange(n) >= none).buffers()[1]
        parts = pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer(offsets), pa.py_buffer(bytes_left)])
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), parts], names=["key", "doc", "sub", "start", "size", "data"])

    def run(batches):
        for table, edges in _grouped(batches):
            data, ends = _flat(table.column("data"))
            columns = [table.column(c).to_numpy() for c in ("key", "crowded", "doc", "sub", "first")]
            edges = np.append(edges, table.num_rows)
            k = 0
            while k < len(edges) - 1:  # as many groups as SORTED_BYTES holds, one at least
                to = max(k + 1, int(np.searchsorted(ends[edges], ends[edges[k]] + SORTED_BYTES, side="right")) - 1)
                a, b, k = edges[k], edges[to], to
                yield sort(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], *(c[a:b] for c in columns))

    met = rows.select("key", "group", "crowded", "doc", "sub", "first", "data").repartition("key", "group").sortWithinPartitions("key", "group")
    return met.mapInArrow(run, _COMPARED)


def _anchored_again(rows: DataFrame, anchor: int) -> DataFrame:
    """Segments (key, doc, sub, first, data) under longer anchors, of bytes (doc, sub, start, data)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                out: list[list] = [[np.zeros(0, np.int64)] for _ in range(4)]
                parts = []
                for doc, sub, start, data in zip(*(part.column(c).to_pylist() for c in ("doc", "sub", "start", "data")), strict=True):
                    key, first, count = segments(data, anchor)
                    for column, new in zip(out, (key, np.full(len(key), doc), np.full(len(key), sub), first + start), strict=True):
                        column.append(new)
                    parts += [data[a : a + n + LENGTH - 1] for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out), pa.array(parts, pa.binary())], names=["key", "doc", "sub", "first", "data"])

    return rows.mapInArrow(run, "key long, doc long, sub long, first long, data binary")


def _runs(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows, in any order, as maximal runs: those that overlap or touch are one."""
    width = int(end.max(initial=0)) + 2
    by = np.argsort(row * width + start)
    row, start = row[by], start[by]
    last = np.maximum.accumulate(row * width + end[by])
    new = np.ones(len(by), bool)
    new[1:] = (row * width + start)[1:] > last[:-1]
    at = np.flatnonzero(new)
    return row[at], start[at], last[np.append(at[1:], len(by))[: len(at)] - 1] - row[at] * width


def _repeated(docs: DataFrame) -> DataFrame:
    """(doc, sub, start, end) of runs of bytes that begin with repeated windows, of documents (doc, sub, data)."""
    rows, any_crowded = _in_groups(stored(_wanted(_asking(docs))))
    rows, spans, level = _texts(docs, rows), None, 0
    while True:
        compared = stored(_compared(rows)) if any_crowded else _compared(rows)
        found = compared.where("data is null").select("doc", "sub", "start", (F.col("start") + F.col("size")).alias("end"))
        spans = found if spans is None else spans.unionAll(found)
        if not any_crowded:
            return spans
        level = min(level + 1, len(ANCHORS) - 1)
        rows, any_crowded = _in_groups(stored(_anchored_again(compared.where("data is not null"), ANCHORS[level])))


def remove_repeats(docs: DataFrame, text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept): one row for each document.

    removed holds the maximal removed runs as (start, end) in bytes of the UTF-8
    text, kept (left out unless asked for) the bytes that stay. A byte goes if a
    100-byte string that covers it also starts earlier: in a document of smaller
    doc_id, or earlier in the same one. doc_id must be a whole number or null; null
    comes before all others. A null text is empty. Rows that repeat doc_id and text
    count as one document, and each gets its result; rows that share only doc_id
    are documents in an order of their own. Other columns are not kept. An empty
    table gives an empty result.
    """
    placed, single = _placed(docs, text)
    lists = _repeated(single).groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>" + (", kept binary" if keep_bytes else "")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                data, lists = part.column("data").to_pylist(), part.column("spans")
                spans = [c.to_numpy() for c in lists.flatten().flatten()]
                row, start, end = _runs(np.repeat(np.arange(len(data)), lists.value_lengths().fill_null(0).to_numpy()), *spans)
                edges = np.searchsorted(row, np.arange(len(data) + 1))
                starts, ends, kept = start.tolist(), end.tolist(), []
                for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
                    free = zip([0, *ends[a:b]], [*starts[a:b], len(data[k])], strict=True)
                    kept.append(b"".join(data[k][x:y] for x, y in free) if a < b else data[k])
                n_bytes, n_kept = (np.array([len(x) for x in texts], np.int64) for texts in (data, kept))
                removed = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
                out = {"doc_id": part.column("doc_id"), "n_bytes": n_bytes, "n_removed": n_bytes - n_kept, "n_spans": np.diff(edges), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "removed": removed}
                if keep_bytes:
                    out["kept"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    joined = placed.join(lists, ["doc", "sub"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "data", "spans")
    return joined.mapInArrow(run, schema)
