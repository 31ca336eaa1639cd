"""Embedding whitening on principal components that are found by contour integration.

Spark drops equal vectors, adds up what the covariance needs and projects every row;
what comes to the driver is as large as the covariance, whatever the number of rows.

The components come from FEAST (Polizzi, Physical Review B 79, 2009). The number of
eigenvalues below a shift is the number of negative pivots of the shifted
covariance (Sylvester's law of inertia), so bisection finds intervals that hold the
eigenvalues that are asked for. For each interval, Gauss-Legendre quadrature over a
circle around it adds up solves of complex shifted systems; that sum is a projector
onto the interval's eigenvectors. Rayleigh-Ritz extracts them from the projected
subspace, and again from all intervals together. An interval whose number of Ritz
values isn't that of its inertia counts is done again with a larger subspace, up to
all dimensions, so none is missed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import by_length, finite
from .storage import stored, with_fields

STEP, COMPONENTS = 256, 4
#: Quadrature points on the upper half of a circle, eigenvalues of one interval, refinements of a subspace.
NODES, TOGETHER, REFINED = 8, 4, 12
#: Steps of a bisection; rows of one product.
HALVINGS, ROWS = 40, 8192


# --- eigenvalues of a symmetric matrix in an interval ---


def below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues are below the shift: the negative pivots of a symmetric factorisation.

    Pivots of one or two rows are chosen as by Bunch and Kaufman; a pivot of two
    rows has one positive and one negative eigenvalue.
    """
    a, n, k, count = v - shift * np.eye(len(v)), len(v), 0, 0
    alpha = (1 + np.sqrt(17)) / 8

    def swap(i, j):
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        two = False
        if k + 1 < n:
            column = np.abs(a[k + 1 :, k])
            r = k + 1 + int(column.argmax())
            most = column[r - k - 1]
            if abs(a[k, k]) < alpha * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                widest = row.max()
                if abs(a[k, k]) * widest < alpha * most**2:
                    two = abs(a[r, r]) < alpha * widest
                    swap(k + 1 if two else k, r)
        if two:
            count += 1
            c = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(a[k : k + 2, k : k + 2], c.T)
            k += 2
        else:
            count += int(a[k, k] < 0)
            if a[k, k] != 0:
                c = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(c, c / a[k, k])
            k += 1
    return count


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues within) of neighbouring intervals that hold the k greatest eigenvalues, and ones as great as these."""
    n, top = len(v), float(np.abs(v).sum(1).max()) * 1.01
    above = lambda shift: n - below(v, shift)

    def split(low: float, high: float, want: int) -> float:
        """A shift with at least so many eigenvalues above it, and if bisection finds one, no more."""
        for _ in range(HALVINGS):
            middle = (low + high) / 2
            found = above(middle)
            if found == want:
                return middle
            low, high = (middle, high) if found > want else (low, middle)
        return low

    floor = split(-0.01 * top, top, k)
    low, high = floor, top
    while high - low > 0.02 * top:  # no need for a circle far beyond the greatest one
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) else (low, middle)
    out, todo = [], [(floor, high)]
    while todo:
        low, high = todo.pop()
        inside = above(low) - above(high)
        middle = split(low, high, above(high) + inside // 2) if inside > TOGETHER else low
        if low < middle < high and above(middle) > above(high):
            todo += [(low, middle), (middle, high)]
        elif inside:
            out.append((low, high, inside))
    return out


def projected(v: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """y projected onto the eigenvectors of the interval, by quadrature over the circle on it."""
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(y)
    for t, w in zip(*np.polynomial.legendre.leggauss(NODES), strict=True):
        turn = radius * np.exp(0.5j * np.pi * (1 + t))
        out += 0.5 * w * np.real(turn * np.linalg.solve((centre + turn) * np.eye(len(v)) - v, y.astype(complex)))
    return out


def _ritz(v: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values, falling, and vectors of the space that the columns span."""
    u, s, _ = np.linalg.svd(basis, full_matrices=False)
    q = u[:, s > 1e-13 * s[0]]
    values, turn = np.linalg.eigh(q.T @ v @ q)
    return values[::-1], (q @ turn)[:, ::-1]


def within(v: np.ndarray, low: float, high: float, inside: int) -> np.ndarray:
    """The eigenvectors, as columns, of the interval; as many as inertia says."""
    n, scale = len(v), float(np.abs(v).max())
    size = min(n, inside + max(4, inside // 2))
    while True:
        x = np.random.default_rng(size).standard_normal((n, size))
        before = np.inf
        for _ in range(REFINED):
            values, x = _ritz(v, x if size == n else projected(v, x, low, high))
            own = (values > low) & (values < high)
            off = np.abs(v @ x[:, own] - x[:, own] * values[own]).max(initial=0.0)
            if own.sum() == inside and (off <= 1e-15 * scale or off > before / 4):
                break
            before = off if own.sum() == inside else np.inf
        if own.sum() == inside or size == n:
            return x[:, own] if own.sum() == inside else x[:, np.argsort(-np.minimum(values - low, high - values))[:inside]]
        size = min(n, 2 * size)


def greatest(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a covariance, falling, and their unit eigenvectors as columns; fewer, if fewer are positive.

    The entry of greatest size of each vector is positive.
    """
    trace = float(np.trace(v))
    if not len(v) or not trace > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    noise = len(v) * np.finfo(float).eps * trace
    k = min(k, len(v) - below(v, noise))
    values, x = _ritz(v, np.concatenate([within(v, *i) for i in intervals(v, k)], axis=1))
    values, x = values[:k], x[:, :k]
    return values, x * np.where(x[np.abs(x).argmax(0), np.arange(k)] < 0, -1.0, 1.0)


# --- over a table ---


@dataclass
class Fit:
    """What rows of one length are whitened with: n distinct vectors, their sums, eigenvalues, vectors and trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return ((x - mean) @ self.vectors) / np.sqrt(self.values)


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * value), within the range of a long."""
    x = np.floor(STEP * values.astype(np.float64))
    return np.clip(x, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)


def _distinct(kept: DataFrame, vector: str) -> DataFrame:
    """(x): the distinct whole-numbered vectors."""

    def run(batches):
        for batch in batches:
            for size, _, values in by_length(batch, vector):
                x = _whole(values)
                ends = np.arange(len(x) + 1, dtype=np.int32) * size
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))], names=["x"])

    return kept.select(vector).mapInArrow(run, "x array<long>").distinct()


def _added(rows: DataFrame, parts) -> dict[tuple[int, int], np.ndarray]:
    """The sums of the arrays that parts gives for (length, line) in each task."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for size, _, values in by_length(batch, "x"):
                for at in range(0, len(values), ROWS):
                    for line, total in enumerate(parts(size, values[at : at + ROWS])):
                        sums[size, line] = sums.get((size, line), 0.0) + total
        if sums:
            yield _lines(sums)

    def add(table: pa.Table) -> pa.Table:
        own = (table.column("size")[0].as_py(), table.column("line")[0].as_py())
        total = table.column("total").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
        return pa.Table.from_batches([_lines({own: total})])

    schema = "size int, line int, total array<double>"
    found = rows.mapInArrow(run, schema).groupBy("size", "line").applyInArrow(add, schema)
    return {(r["size"], r.line): np.array(r.total) for r in found.collect()}  # as large as the covariance


def _lines(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    size, line = (pa.array([k[i] for k in sums], pa.int32()) for i in (0, 1))
    return pa.RecordBatch.from_arrays([size, line, pa.array([t.tolist() for t in sums.values()], pa.list_(pa.float64()))], names=["size", "line", "total"])


def _counted(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(n, exact sums) by length."""

    def run(batches):
        n: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for size, _, x in by_length(batch, "x"):
                low, high = (x & 0xFFFFFFFF).sum(0).tolist(), (x >> 32).sum(0).tolist()
                n[size] = n.get(size, 0) + len(x)
                sums[size] = [s + a + (b << 32) for s, a, b in zip(sums.get(size, [0] * size), low, high, strict=True)]
        for size in n:
            total = [str(s) for s in sums[size]]
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n[size]] * size), pa.array(total, pa.string())], names=["size", "place", "n", "total"])

    parts = rows.mapInArrow(run, "size int, place int, n long, total string")
    found = parts.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(found, key=lambda r: r.place):
        by.setdefault(r["size"], (r.n, []))[1].append(int(r.total))
    return by


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A Fit for each length of vectors. Covariances are of centred vectors, divided by n.

    Vectors are centred on whole numbers next to the mean, so products and their sums
    are exact as long as they are below 2**53; what the mean is off is taken out last.
    """
    counted = _counted(distinct)
    middles = {size: np.array([(2 * s + n) // (2 * n) for s in sums], np.int64) for size, (n, sums) in counted.items()}

    def products(size, x):
        y = (x - middles[size]).astype(np.float64)
        return y.T @ y

    lines = _added(distinct, products)
    fits = {}
    for size, (n, sums) in counted.items():
        off = np.array([(s - n * int(m)) / n for s, m in zip(sums, middles[size], strict=True)])
        v = np.stack([lines[size, i] for i in range(size)]) / n - np.outer(off, off)
        values, vectors = greatest((v + v.T) / 2, components)
        fits[size] = Fit(n, sums, values, vectors, float(np.trace(v)))

    def means(size, x):
        return fits[size].project(x).sum(0)[None]

    centre = {size: total / fits[size].n for (size, _), total in _added(distinct, means).items()}

    def squares(size, x):
        w = fits[size].project(x) - centre[size]
        return w.T @ w

    for (size, line), total in _added(distinct, squares).items():
        own = total / fits[size].n
        own[line] -= 1
        fits[size].identity_error = max(fits[size].identity_error, float(np.abs(own).max()))
    return fits


def _deviations(x: np.ndarray, one: Fit) -> list[int | None]:
    """The sum of (n * x - sum) ** 2 of each row, exact; None where it passes a long."""
    most = max(map(abs, (int(x.min(initial=0)), int(x.max(initial=0))))) * one.n + max(map(abs, one.sums), default=0)
    if x.shape[1] * most**2 < 2**63:
        return ((one.n * x - np.array(one.sums, np.int64)) ** 2).sum(1).tolist()
    found = [sum((one.n * a - s) ** 2 for a, s in zip(row, one.sums, strict=True)) for row in x.tolist()]
    return [d if d < 2**63 else None for d in found]


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and principal component: component, n, deviation, whitened, explained, identity_error; the other columns stay.

    Each entry c counts as floor(256 * c). The fit takes each distinct vector once: n
    of them. Components are numbered from 1 by falling variance; whitened is the
    centred vector's share of the component over its standard deviation, explained
    the component's part of all variance, deviation the sum of (n * x - sum) ** 2 over
    the dimensions (null where it passes a long), identity_error the greatest
    difference of the whitened fit's covariance from the identity.

    Rows whose vector is null or has null or non-finite entries are dropped. Vectors
    of different lengths are whitened apart. There are as many components as have a
    variance above rounding: none for empty vectors, one vector, or copies of one, and
    so no rows. Repeated rows stay. Input columns named like the added ones are
    replaced. An empty table gives an empty result.
    """
    added = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
    kept = vectors.select(*[c for c in vectors.columns if c not in added]).where(finite(vector) & (F.size(vector) > 0))
    fits = fit(stored(_distinct(kept, vector)), components)
    schema = with_fields(kept.drop(vector), added)
    carried = [n for n in schema.names if n not in added]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for size, rows, values in by_length(part, vector):
                    one, x = fits[size], _whole(values)
                    k = len(one.values)
                    if not k:
                        continue
                    again = pa.array(np.repeat(rows, k))
                    of_row = pa.array(np.repeat(np.arange(len(x)), k))
                    each = lambda a: pa.array(np.tile(a, len(x)))  # noqa: B023, E731
                    new = [
                        each(np.arange(1, k + 1, dtype=np.int32)),
                        pa.array([one.n] * (len(x) * k)),
                        pa.array(_deviations(x, one), pa.int64()).take(of_row),
                        pa.array(one.project(x).reshape(-1)),
                        each(one.values / one.trace),
                        pa.array([one.identity_error] * (len(x) * k)),
                    ]
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(again) for c in carried), *new], names=schema.names)

    return kept.mapInArrow(run, schema)
