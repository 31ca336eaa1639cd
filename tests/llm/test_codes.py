import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoploom.llm import codes

SCHEMA = "vec_id long, label int, embedding array<float>, code int"


def plain(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry."""
    kept = [r for r in rows if r[2] is not None and all(c is not None and np.isfinite(c) for c in r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.floor(256 * np.array([np.float32(r[2]) for r in kept], np.float64)).astype(np.int64).reshape(len(kept), parts, -1)
    book = [x[:entries, p].copy() for p in range(parts)]
    for k in range(rounds + 1):
        d = [((x[:, p, None] - book[p][None]) ** 2).sum(2) for p in range(parts)]
        near = [d[p].argmin(1) for p in range(parts)]
        if k < rounds:
            for p in range(parts):
                for e in set(near[p].tolist()):
                    own = x[near[p] == e, p]
                    book[p][e] = own.sum(0) // len(own)
    code = ["".join(f"{near[p][i]:02x}" for p in range(parts)) for i in range(len(kept))]
    error = sum(d[p].min(1) for p in range(parts)).tolist()
    by = {}
    for r, e in zip(kept, error):
        by[r[1]] = by.get(r[1], 0) + e
    sha = hashlib.sha256(",".join(str(n) for b in book for n in b.reshape(-1)).encode()).hexdigest()
    return sorted(((r[0], c, e, by[r[1]], sha) for r, c, e in zip(kept, code, error)), key=str)


def got(df):
    found = codes.label_errors(codes.compress(df)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in found.collect()), key=str)


def odd_rows(n=400, d=32):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, d)) * 0.1
    x = (centres[rng.integers(0, 12, n)] + rng.standard_normal((n, d)) * 0.02).astype(np.float32)
    x[: n // 3] = x[0]  # a third are copies
    rows = [(i + 1, i % 5 if i % 7 else None, x[i].tolist(), 9) for i in range(n)]
    rows += [(None, 1, x[5].tolist(), 1), rows[8], rows[8], (n + 5, 2, None, 1), (n + 6, 2, [None] * d, 1), (n + 7, 2, [float("nan")] * d, 1), (n + 8, 2, [float("inf")] * d, 1)]
    return rows


def test_equals_comparing_everything(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df) == plain(rows)
    assert got(spark.createDataFrame(rows[100:130], SCHEMA)) == plain(rows[100:130])  # fewer than entries


def test_walk_owns_whole_balls():
    rng = np.random.default_rng(0)
    middles = rng.integers(-500, 500, (20, 4))
    x = (middles[rng.integers(0, 20, 4000)] + rng.integers(-9, 10, (4000, 4))).astype(np.int64)
    t = codes._opened({n: codes._packed(a) for n, a in codes.tree(x).items()}, 4)
    balls, by, points, near = codes.walk(t, middles)
    owned = (t["ends"][balls, 1] - t["ends"][balls, 0]).sum()
    assert owned > 0.8 * len(t["points"]) and owned + len(points) == len(t["points"])
    book = np.concatenate([middles, middles[:3]])  # equal entries: the first has all
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    entry, error = codes._coded(t, book)
    assert (entry == d.argmin(1)).all() and (error == d.min(1)).all()
    sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
    codes._tally(t, book, sums, counts)
    assert (counts == np.bincount(d.argmin(1), minlength=len(book))).all() and sums.sum() == x.sum() and not counts[20:].any()


def test_balls_hold_their_points():
    x = np.random.default_rng(1).integers(-60, 60, (3000, 3)).astype(np.int64)
    t = codes.tree(x)
    for centre, radius, (a, b), total, n in zip(t["centres"].astype(float), t["radii"], t["ends"], t["sums"], t["counts"], strict=True):
        own = t["points"][a:b]
        assert (np.sqrt(((own - centre) ** 2).sum(1)) <= radius).all()
        assert (total == (own * t["copies"][a:b, None]).sum(0)).all() and n == t["copies"][a:b].sum()
    assert t["counts"][0] == 3000 and (t["points"][t["place"]] == x).all()


def test_lengths_and_empty(spark):
    rows = [(1, 0, [1.0] * 16, 1), (2, 0, [0.5] * 16, 1), (3, 0, [0.5] * 32, 1), (4, 1, [1.0] * 5, 1), (5, 1, [], 1)]
    found = {r.vec_id: r for r in codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[2].code == "01" * 16 and found[3].code == "00" * 16 and found[1].codebooks_sha256 != found[3].codebooks_sha256
    assert all(found[i][c] is None for i in (4, 5) for c in ("code", "error", "codebooks_sha256"))
    labelled = {r.vec_id: r.label_error for r in codes.label_errors(codes.compress(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert labelled == {1: 0, 2: 0, 3: 0, 4: None, 5: None}
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame(rows[3:], SCHEMA).where("vec_id < 0")) == []


def test_too_large_raises(spark):
    df = spark.createDataFrame([(1, 0, [3e38] * 16, 1)], SCHEMA)
    with pytest.raises(Exception, match="has a part of"):
        codes.compress(df).collect()


def test_other_columns_stay(spark):
    df = spark.createDataFrame(odd_rows(80), SCHEMA).withColumn("error", F.lit("mine")).withColumn("size", F.lit(1)).withColumn("rank", F.array(F.lit("a")))
    out = codes.compress(df)
    assert out.columns == ["vec_id", "label", "size", "rank", "code", "error", "codebooks_sha256"]
    assert out.where("size = 1 and rank[0] = 'a' and error >= 0").count() == 83
