"""Vector codes by product quantisation, with codebooks fitted exactly through metric trees.

Vectors are taken in whole numbers and cut into equal parts; every part position
has a codebook of a few entries. Lloyd's rounds ask for the nearest entry of every
part. Instead of comparing each part with each entry, the parts of a chunk of
vectors are put into a metric tree once for each position, by the anchors hierarchy
of Moore (UAI 2000): about the square root of n anchors are set, each the point that
is furthest from its own anchor, and take the points that are nearer to them; points
further than half the way between two anchors are the only ones that are looked at.
The groups of the anchors are balls from which the tree goes down by the same rule
and up by merging the two balls that fit into the smallest one. Every ball caches the
sum and the count of its points.

A round walks each tree from its root with a list of candidate entries. A ball hands
its list down without the entries that another one beats in all of the ball; once a
single entry is left the ball is wholly its own, and its cached sum and count are
added without looking at a point. Only in leaves with more candidates are points
compared. The lists are cut with a margin for rounding, and points are compared in
whole numbers, so results are those of comparing everything, ties included.

Trees are built where the vectors are and stored; a round reads the trees, gives back
sums for each task and shuffles nothing else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored, with_fields

PARTS, ENTRIES, ROUNDS, STEP = 16, 64, 2, 256
#: Vectors of one chunk, points of a leaf at most, and points that are compared at once.
CHUNK, LEAF, ABREAST = 4096, 32, 512
#: Whole numbers must be below this, so that distances and sums of them fit 64 bits.
LIMIT = 2**27
_TREE = ("place", "points", "copies", "centres", "radii", "ends", "kin", "sums", "counts")


def finite(column: str):
    """Neither null nor with null or non-finite parts."""
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


# --- the tree of a chunk's parts ---


def _anchors(x: np.ndarray, k: int) -> np.ndarray:
    """The anchor (0 to k - 1 at most) of each of some distinct points."""
    owner, far = np.zeros(len(x), np.int64), np.sqrt(((x - x[0]) ** 2).sum(1))
    at, reach = [0], [far.max()]
    while len(at) < k:
        widest = int(np.argmax(reach))
        if reach[widest] == 0:
            break
        new = int(np.where(owner == widest, far, -1).argmax())
        apart = np.sqrt(((x[at] - x[new]) ** 2).sum(1))
        asked = np.flatnonzero(2 * far > apart[owner])  # the others are surely nearer to their own
        d = np.sqrt(((x[asked] - x[new]) ** 2).sum(1))
        near = d < far[asked]
        robbed = np.unique(owner[asked[near]])
        owner[asked[near]], far[asked[near]] = len(at), d[near]
        at.append(new)
        for a in robbed:
            reach[a] = far[owner == a].max(initial=0.0)
        reach.append(far[owner == len(at) - 1].max(initial=0.0))
    return owner


def _merged(nodes: list, centres: np.ndarray, radii: np.ndarray) -> object:
    """One binary tree over balls: the two that fit into the smallest ball are merged, and so on."""
    nodes, centres, radii = list(nodes), centres.copy(), radii.copy()

    def sizes(i):
        d = np.sqrt(((centres - centres[i]) ** 2).sum(1))
        both = np.maximum((d + radii + radii[i]) / 2, np.maximum(radii, radii[i]))
        both[i] = np.inf
        return both

    table = np.stack([sizes(i) for i in range(len(nodes))])
    for _ in range(len(nodes) - 1):
        i, j = sorted(divmod(int(table.argmin()), len(nodes)))
        d, size = np.sqrt(((centres[j] - centres[i]) ** 2).sum()), table[i, j]
        centres[i] += (centres[j] - centres[i]) * (min(1.0, max(0.0, (size - radii[i]) / d)) if d else 0.0)
        radii[i], nodes[i] = size, (nodes[i], nodes[j])
        gone = ~np.isfinite(table[i]) & (np.arange(len(nodes)) != i)
        gone[j] = True
        table[i] = sizes(i)
        table[i, gone] = np.inf
        table[:, i] = table[i]
        table[j], table[:, j] = np.inf, np.inf
    return nodes[i] if len(nodes) > 1 else nodes[0]


def _grown(x: np.ndarray, points: np.ndarray) -> object:
    """A nested pair of pairs, whose leaves are arrays of points."""
    if len(points) <= LEAF:
        return points
    owner = _anchors(x[points], int(np.sqrt(len(points))) + 1)
    groups = [points[owner == a] for a in range(owner.max() + 1)]
    centres = np.stack([x[g].mean(0) for g in groups])
    radii = np.array([np.sqrt(((x[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centres, strict=True)])
    return _merged([_grown(x, g) for g in groups], centres, radii)


def tree(parts: np.ndarray) -> dict[str, np.ndarray]:
    """The metric tree of whole-numbered parts; equal parts are one point with copies.

    points stand in the order of the leaves, place is the point of each part, and a
    ball has its points from ends[:, 0] to ends[:, 1] and its two halves in kin (-1: a leaf).
    """
    points, place, copies = np.unique(parts, axis=0, return_inverse=True, return_counts=True)
    order, ends, kin = [], [], []
    todo = [(_grown(points.astype(np.float64), np.arange(len(points))), -1, 0)]
    done = 0
    while todo:
        what, parent, side = todo.pop()
        if parent >= 0:
            kin[parent][side] = len(kin)
        kin.append([-1, -1])
        if isinstance(what, tuple):
            ends.append([done, -1])
            todo += [(what[1], len(kin) - 1, 1), (what[0], len(kin) - 1, 0)]
        else:
            ends.append([done, done + len(what)])
            order.append(what)
            done += len(what)
    kin, ends = np.array(kin), np.array(ends)
    for ball in range(len(kin) - 1, -1, -1):  # halves come after their ball
        if kin[ball, 0] >= 0:
            ends[ball, 1] = ends[kin[ball, 1], 1]
    order = np.concatenate(order)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    points, copies = points[order], copies[order]
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points * copies[:, None], axis=0)])
    so_far = np.concatenate([[0], np.cumsum(copies)])
    sums, counts = total[ends[:, 1]] - total[ends[:, 0]], so_far[ends[:, 1]] - so_far[ends[:, 0]]
    centres = (sums / counts[:, None]).astype(np.float32)
    radii = np.array([((points[a:b] - c.astype(np.float64)) ** 2).sum(1).max() for (a, b), c in zip(ends, centres, strict=True)])
    radii = np.nextafter(np.sqrt(radii).astype(np.float32), np.float32(np.inf))
    return dict(zip(_TREE, (at[place.reshape(-1)], points, copies, centres, radii, ends, kin, sums, counts), strict=True))


def _packed(a: np.ndarray) -> bytes:
    """An array as bytes, whole numbers as narrow as they can be."""
    if a.dtype.kind == "i":
        low, high = int(a.min(initial=0)), int(a.max(initial=0))
        a = a.astype(next(t for t in "bhiq" if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
    return a.dtype.char.encode() + np.ascontiguousarray(a).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, raw[:1].decode(), offset=1)


def _opened(packed: dict[str, bytes], width: int) -> dict[str, np.ndarray]:
    shapes = {"points": width, "centres": width, "sums": width, "ends": 2, "kin": 2}
    found = {n: _unpacked(packed[n]) for n in _TREE}
    found = {n: (a.reshape(-1, shapes[n]) if n in shapes else a) for n, a in found.items()}
    return {n: a.astype(np.float64 if a.dtype.kind == "f" else np.int64) for n, a in found.items()}


# --- the walk ---


def _nearest(points: np.ndarray, book: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """The nearest candidate entry of each point, of equally near ones the first."""
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), ABREAST):
        part = slice(at, at + ABREAST)
        lists = np.argsort(~fit[part], axis=1, kind="stable")[:, : fit[part].sum(1).max()]
        d = ((points[part, None, :] - book[lists]) ** 2).sum(2)
        first = np.where(np.take_along_axis(fit[part], lists, 1), d, np.iinfo(np.int64).max).argmin(1)
        out[part] = lists[np.arange(len(lists)), first]
    return out


def walk(t: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(balls, their entries, points, their entries): the balls that one entry owns, and the points outside of them."""
    apart = np.sqrt(((book[:, None, :] - book[None]) ** 2).sum(2).astype(np.float64))
    balls, fit = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    owned, single = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    while len(balls):
        d = ((t["centres"][balls][:, None, :] - book[None]) ** 2).sum(2)
        best = np.where(fit, d, np.inf).argmin(1)
        row = np.arange(len(balls))
        # over a ball, the lead of the best entry shrinks by at most twice its radius times the entries' distance
        shrink = 2 * t["radii"][balls][:, None] * apart[best]
        fit &= d - d[row, best][:, None] <= shrink + 1e-6 * (1 + d + shrink)
        whole = fit.sum(1) == 1
        owned.append(np.stack([balls[whole], best[whole]]))
        leaf = ~whole & (t["kin"][balls, 0] < 0)
        if leaf.any():
            (start, end), lists = t["ends"][balls[leaf]].T, fit[leaf]
            n = end - start
            points = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            single.append(np.stack([points, _nearest(t["points"][points], book, np.repeat(lists, n, axis=0))]))
        down = ~whole & ~leaf
        balls, fit = t["kin"][balls[down]].reshape(-1), np.repeat(fit[down], 2, axis=0)
    return (*np.concatenate(owned, 1), *np.concatenate(single, 1))


def _tally(t: dict[str, np.ndarray], book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    balls, by, points, near = walk(t, book)
    np.add.at(sums, by, t["sums"][balls])
    np.add.at(counts, by, t["counts"][balls])
    copies = t["copies"][points]
    np.add.at(sums, near, t["points"][points] * copies[:, None])
    np.add.at(counts, near, copies)


def _coded(t: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each part, and its squared distance from it."""
    balls, by, points, near = walk(t, book)
    entry = np.empty(len(t["points"]), np.int64)
    entry[points] = near
    for (a, b), e in zip(t["ends"][balls], by, strict=True):
        entry[a:b] = e
    error = ((t["points"] - book[entry]) ** 2).sum(1)
    return entry[t["place"]], error[t["place"]]


# --- over a table ---


def _whole(values: np.ndarray, step: int) -> np.ndarray:
    """floor(step * value); beyond LIMIT distances would not fit 64 bits."""
    x = np.floor(step * values.astype(np.float64))
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a vector has a part of {LIMIT // step} or more")
    return x.astype(np.int64)


def by_length(batch: pa.RecordBatch, vector: str):
    """(length, rows, values) of the vectors of each length; none of them may be null."""
    column = batch.column(vector)
    sizes = pc.list_value_length(column).to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        own = column if len(rows) == len(sizes) else column.take(pa.array(rows))
        yield int(size), rows, own.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)


def _planted(kept: DataFrame, vector: str, parts: int, step: int) -> DataFrame:
    """(size, rows, trees): the rows of a chunk without their vectors, and the tree of each part position."""
    rows = kept.drop(vector).schema
    binaries = T.StructType([T.StructField(n, T.BinaryType()) for n in _TREE])
    schema = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("rows", T.ArrayType(rows)), T.StructField("trees", T.ArrayType(binaries))])
    packed = pa.list_(pa.struct([(n, pa.binary()) for n in _TREE]))

    def chunk(size: int, held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches([b for b, _ in held]).combine_chunks()
        x = np.concatenate([x for _, x in held])
        width = size // parts
        grown = [tree(x[:, p * width : (p + 1) * width]) for p in range(parts)]
        columns = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns], fields=list(table.schema))
        listed = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), columns)
        trees = pa.array([[{n: _packed(t[n]) for n in _TREE} for t in grown]], packed)
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), listed, trees], names=schema.names)

    def run(batches):
        waiting: dict[int, list] = {}
        for batch in batches:
            carried = batch.select(rows.names)
            for size, at, values in by_length(batch, vector):
                x = _whole(values, step)
                for first in range(0, len(at), CHUNK):
                    held = waiting.setdefault(size, [])
                    held.append((carried.take(pa.array(at[first : first + CHUNK])), x[first : first + CHUNK]))
                    if sum(len(part) for _, part in held) >= CHUNK:
                        yield chunk(size, waiting.pop(size))
            if sum(len(part) for held in waiting.values() for _, part in held) >= 4 * CHUNK:  # many lengths
                for size in list(waiting):
                    yield chunk(size, waiting.pop(size))
        for size, held in waiting.items():
            yield chunk(size, held)

    return kept.mapInArrow(run, schema)


def _first(kept: DataFrame, vector: str, order: str, parts: int, entries: int, step: int) -> dict[int, np.ndarray]:
    """By length, the codebooks (position, entry, place) from the first vectors in order."""
    keyed = kept.select(F.size(vector).alias("size"), F.col(order).alias("by"), F.col(vector).alias("vector"))
    rank = F.row_number().over(Window.partitionBy("size").orderBy(F.col("by").asc_nulls_last(), "vector"))
    rows = keyed.withColumn("rank", rank).where(F.col("rank") <= entries).collect()  # a few for each length
    books = {}
    for size in {r.size for r in rows}:
        first = _whole(np.array([r.vector for r in sorted((r for r in rows if r.size == size), key=lambda r: r.rank)], np.float64), step)
        books[size] = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    return books


def _next(trees: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The codebooks after one round: entries become the floored means of their parts, unused ones stay."""

    def run(batches):
        sums = {size: np.zeros_like(b) for size, b in books.items()}
        counts = {size: np.zeros(b.shape[:2], np.int64) for size, b in books.items()}
        for batch in batches:
            for size, packed in zip(batch.column("size").to_pylist(), batch.column("trees"), strict=True):
                for p, t in enumerate(packed):
                    _tally(_opened(t.as_py(), books[size].shape[2]), books[size][p], sums[size][p], counts[size][p])
        for size, total in sums.items():
            p, e, place = (i.reshape(-1) for i in np.indices(total.shape))
            columns = (np.full(total.size, size), p, e, place, total.reshape(-1), counts[size][p, e])
            used = counts[size][p, e] > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], names=["size", "position", "entry", "place", "total", "n"])

    tallied = trees.select("size", "trees").mapInArrow(run, "size long, position long, entry long, place long, total long, n long")
    sums = tallied.groupBy("size", "position", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    new = {size: b.copy() for size, b in books.items()}
    for r in sums.collect():  # as many as codebooks have numbers
        new[r["size"]][r.position, r.entry, r.place] = r.total // r.n
    return new


def fitted(trees: DataFrame, books: dict[int, np.ndarray], rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    for _ in range(rounds):
        books = _next(trees, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers by position, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, step: int = STEP) -> DataFrame:
    """Adds code, error and codebooks_sha256 in place of the vector; the other columns stay.

    Each component x becomes floor(step * x). The codebooks begin with the parts of
    the first vectors by the order column (null last, then by the vector itself) and
    take that many rounds. code has two hex digits for each part, error is the sum of
    the parts' squared distances from their entries. There are at most 256 entries.

    Rows whose vector is null or has null or non-finite components are dropped.
    Vectors of different lengths have codebooks of their own; those that can't be cut
    into that many equal parts, empty ones too, have null results. Components whose
    whole number is LIMIT or more raise. Repeated rows stay, and count as often as
    they stand there. Input columns named like the added ones are replaced. An empty
    table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so there are at most 256 entries")
    added = {"code": "string", "error": "long", "codebooks_sha256": "string"}
    kept = vectors.select(*[c for c in vectors.columns if c not in added]).where(finite(vector))
    whole = (F.size(vector) > 0) & (F.size(vector) % parts == 0)
    able, odd = kept.where(whole), kept.where(~whole).drop(vector)
    books = _first(able, vector, order, parts, entries, step)
    trees = stored(_planted(able, vector, parts, step))
    books = fitted(trees, books, rounds)
    digests = {size: digest(b) for size, b in books.items()}
    schema = with_fields(able.drop(vector), added)

    def run(batches):
        for batch in batches:
            for i, size in enumerate(batch.column("size").to_pylist()):
                found = [_coded(_opened(t.as_py(), books[size].shape[2]), books[size][p]) for p, t in enumerate(batch.column("trees")[i])]
                codes = np.stack([c for c, _ in found], 1).astype(np.uint8).tobytes().hex()
                n = len(codes) // (2 * parts)
                rows = batch.column("rows").slice(i, 1).flatten()
                new = [pa.array([codes[at : at + 2 * parts] for at in range(0, len(codes), 2 * parts)]), pa.array(np.sum([e for _, e in found], 0)), pa.array([digests[size]] * n)]
                yield pa.RecordBatch.from_arrays([*rows.flatten(), *new], names=schema.names)

    nothing = [F.lit(None).cast(kind).alias(n) for n, kind in added.items()]
    return trees.mapInArrow(run, schema).unionByName(odd.select("*", *nothing))


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error, the sum of error over the rows of an equal label; nulls are equal, null errors add nothing.

    The sums are combined before the shuffle, so a label of very many rows is no
    more than a row for each task.
    """
    coded = stored(coded)
    sums = coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.drop("label_error").join(sums, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")
