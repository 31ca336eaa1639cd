import numpy as np
import pytest
from pyspark.sql import functions as F

from shoploom.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, n int"


def plain(rows, components=4):
    """(vec_id, component): (n, deviation, |whitened|, explained) by a dense eigensolver."""
    kept = [(i, np.floor(256 * np.array(np.float32(v), np.float64)).astype(np.int64)) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.stack([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(0)
    y = fit - sums / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in kept:
        for k in range(components):
            out[i, k + 1] = (n, int(((n * x - sums) ** 2).sum()), abs((x - sums / n) @ u[:, k]) / np.sqrt(e[k]), e[k] / e.sum())
    return out


def rows(n=300, d=24):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * 0.05 + 3).astype(np.float32)
    x[: n // 3] = x[0]
    bad = [(n + 1, None, 0), (n + 2, [None] * d, 0), (n + 3, [float("nan")] * d, 0), (n + 4, [float("-inf")] * d, 0)]
    return [(i, x[i].tolist(), i) for i in range(n)] + bad


def test_equals_a_dense_solver(spark):
    given = rows()
    want = plain(given)
    got = w.whiten(spark.createDataFrame(given, SCHEMA).repartition(3)).collect()
    assert len(got) == len(want) == 4 * 300
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(whitened, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-10)
        assert 0 <= r.identity_error < 1e-9


def test_inertia_counts():
    rng = np.random.default_rng(0)
    for d in (1, 2, 7, 40):
        a = rng.standard_normal((d, d))
        v = a + a.T
        e = np.linalg.eigvalsh(v)
        for shift in [*rng.uniform(-8, 8, 30), *(e[:-1] + e[1:]) / 2]:
            assert w.below(v, shift) == (e < shift).sum()
    assert w.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize("e", [[9, 4, 3, 2, 1, 0.5], [5, 5, 5, 5, 5, 1], [1e8, 1, 1e-2, 1e-4, 1e-5, 0], [3, 2, 0, 0, 0, 0], list(range(1, 60)), [7, 7 - 1e-9, 7 - 2e-9, 1, 1, 1]])
def test_no_component_is_missed(e):
    e = np.array(e, float)
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((len(e), len(e))))[0]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    for k in (1, 4, 12):
        want = np.sort(e)[::-1][:k]
        want = want[want > len(e) * np.finfo(float).eps * e.sum()]
        values, x = w.greatest(v, k)
        assert len(values) == len(want) and np.allclose(values, want, rtol=1e-12, atol=1e-14 * e.max() * len(e))
        assert np.allclose(x.T @ x, np.eye(len(want)), atol=1e-12) and np.abs(v @ x - x * values).max() < 1e-12 * e.max()


def test_contours_project():
    v = np.diag([10.0, 9, 8, 3, 2, 1])
    part = w.projected(v, np.eye(6), 7.5, 10.5)
    assert np.allclose(part, np.diag([1, 1, 1, 0, 0, 0]), atol=1e-3)
    assert sum(n for _, _, n in w.intervals(np.diag(np.arange(1.0, 41)), 20)) == 20


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert w.whiten(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [], 0)], SCHEMA)
    assert w.whiten(one).count() == 0  # a single distinct vector has no variance
    two = [(1, [1.0, 2.0], 0), (None, [0.0, 2.0], 0), (1, [1.0, 2.0], 0), (4, [1.0], 0), (5, [3.0], 0), (6, [8.0], 0)]
    got = sorted((str(r.vec_id), r.component, r.n, r.deviation, round(r.whitened, 9), r.explained) for r in w.whiten(spark.createDataFrame(two, SCHEMA)).collect())
    assert got[:2] == [("1", 1, 2, 256**2, 1.0, 1.0)] * 2 and got[-1][:4] == ("None", 1, 2, 256**2)
    assert {g[0]: g[2] for g in got} == {"1": 2, "None": 2, "4": 3, "5": 3, "6": 3}


def test_large_and_extra(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 2.0], 0)], SCHEMA)
    out = w.whiten(df.withColumn("component", F.lit("mine")).withColumn("x", F.lit(7)).withColumn("size", F.lit(8)))
    assert out.columns[:3] == ["vec_id", "x", "size"] and out.where("component = 1 and x = 7 and size = 8").count() == 3
    assert all(r.deviation is None for r in out.collect() if r.vec_id == 1)
