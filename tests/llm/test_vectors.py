import tracemalloc

import numpy as np
import pytest

from shoploom.llm import queries, vectors


def data(seed=0, base=500, dim=16):
    r = np.random.default_rng(seed)
    x = list(r.normal(size=(base, dim)))
    for i in range(60):
        x += list(x[i] + 0.05 * r.normal(size=(1 + i % 4, dim)))
    x += list(x[7] + 0.1 * r.normal(size=(150, dim)))
    x += [x[3] * 2, x[3], x[3], x[9] * 1e-20, np.full(dim, 1e18)]
    x += [x[11]] * 60
    return [[float(np.float32(v)) for v in row] for row in x]


def brute(rows):
    ok = [i for i, v in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, of = {i: 0 for i in range(len(rows))}, list(range(len(rows)))
    for size in {len(rows[i]) for i in ok}:
        own = [i for i in ok if len(rows[i]) == size]
        x = np.array([rows[i] for i in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.95
        for a, i in enumerate(own):
            links[i] = int(near[a].sum()) - 1
        changed = True
        while changed:
            changed = False
            for a, i in enumerate(own):
                low = min(of[own[b]] for b in np.flatnonzero(near[a]))
                if low < of[i]:
                    of[i], changed = low, True
    return links, of


@pytest.mark.parametrize("chunk", [3000, 60])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    monkeypatch.setattr(vectors, "SHARD", 120)
    monkeypatch.setattr(vectors, "FOR_CENTRE", 8)
    rows = data()
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], []]
    rows += odd
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.op2_embedding_links(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    links, of = brute(rows)
    exact = sum(got[i].n_links == n for i, n in links.items())
    assert all(got[i].n_links <= n for i, n in links.items())
    assert exact >= 0.99 * len(rows)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links.values())
    assert sum(got[i].component_id == c for i, c in enumerate(of)) >= 0.99 * len(rows)
    for i, r in got.items():
        assert r.kept == (r.component_id == i)
        assert r.audit_links == (links[i] if i % 50 == 0 else None)


def test_pruning_keeps_the_nearest():
    x = vectors._unit(np.random.default_rng(2).normal(size=(300, 8)))
    close = x @ x.T
    np.fill_diagonal(close, -2)
    near = np.argsort(-close, axis=1)[:, :30]
    kept = vectors._pruned(x, np.arange(300), np.concatenate([near, near[:, :3], np.full((300, 2), -1)], axis=1))
    for i, row in enumerate(kept):
        row = row[row >= 0]
        assert row[0] == close[i].argmax() and i not in row and len(set(row)) == len(row) <= vectors.DEGREE


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 900])
def test_graph_finds_the_nearest(n):
    x = vectors._unit(np.random.default_rng(n).normal(size=(n, 12)) + 1e-9)
    graph = vectors.built(x) if n else np.zeros((0, vectors.DEGREE), int)
    assert graph.shape == (n, vectors.DEGREE)
    if n < 3:
        assert n < 2 or graph[:, 0].tolist() == [1, 0]
        return
    fresh = vectors._unit(np.random.default_rng(7).normal(size=(100, 12)))
    both = np.concatenate([x, fresh])
    found = vectors._walk(both.astype(np.float32), np.concatenate([graph, np.full((100, vectors.DEGREE), -1)]), np.arange(n, n + 100), int((x @ x.mean(0)).argmax()), vectors.CANDIDATES)
    want = (fresh @ x.T).argmax(1)
    assert np.mean([w in f for w, f in zip(want, found, strict=True)]) >= 0.95


def test_shards_are_clustered_again(spark, monkeypatch):
    """Centres by the number of vectors: with a small bound on one sample, crowded shards get centres of their own."""
    monkeypatch.setattr(vectors, "CHUNK", 150)
    monkeypatch.setattr(vectors, "SHARD", 60)
    monkeypatch.setattr(vectors, "SAMPLE", 64)
    monkeypatch.setattr(vectors, "FOR_CENTRE", 8)
    r = np.random.default_rng(4)
    x = r.normal(size=(1200, 16))
    x = np.concatenate([x, x[:400] + 0.06 * r.normal(size=(400, 16)), np.ones((300, 16)) + 1e-4 * r.normal(size=(300, 16))])
    rows = [[float(np.float32(v)) for v in row] for row in x]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    classes = df.selectExpr("vec_id id", "cast(1 as long) copies", "embedding", "false asked")
    members = vectors.sharded(classes, len(rows)).toPandas()
    sizes = members.groupby("shard").size()
    assert set(members["id"]) == set(range(len(rows))) and len(sizes) > 40
    assert not members.duplicated(["shard", "id"]).any()
    dense = members[members["id"] >= 1600]["shard"]
    assert sizes.drop(dense.unique()).max() <= 150  # only the ball that can't be parted stays crowded
    got = {r.vec_id: r for r in vectors.near_duplicates(df, audit_every=None).collect()}
    links, of = brute(rows)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links.values()) and all(got[i].n_links <= n for i, n in links.items())
    assert sum(got[i].component_id == c for i, c in enumerate(of)) >= 0.98 * len(rows)
    assert all(r.audit_links is None for r in got.values())


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.01])], "vec_id long, embedding array<float>")
    got = sorted(vectors.near_duplicates(df).collect(), key=str)
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, False), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False)]


def test_fitting_takes_blocks(monkeypatch):
    x = np.random.default_rng(0).standard_normal((20_000, 32)).astype(np.float32)
    x[:300] = np.round(x[:300])
    tracemalloc.start()
    got = vectors._fitted(x, 300)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # all products at once are 48 MB
    unit = vectors._unit(x.astype(np.float64))
    want = unit[:300]
    for _ in range(vectors.ROUNDS):
        near = (unit @ want.T).argmax(1)
        sums = np.zeros_like(want)
        np.add.at(sums, near, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        want = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), want)
    assert np.allclose(got, want)
    near = vectors._nearest(unit, want)
    assert (near == np.sort(np.argsort(-(unit @ want.T), axis=1)[:, : vectors.OVERLAP], axis=1)).all()


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE_BYTES", 4 * 16 * 100)
    seen = []
    monkeypatch.setattr(vectors, "_fitted", lambda x, want: seen.append(x.shape) or x[:want])
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(16 if i % 10 else 8).tolist()) for i in range(900)]
    found = vectors.centres(spark.createDataFrame(rows, "id long, embedding array<float>"), 5000)
    assert sorted(found) == [8, 16] and sum(n for n, _ in seen) == 100
