import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shoploom.llm import queries, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["A", "the", "Éa", "ÄÖ", "x y", "\t", "\n", " ", "\x0b", "\x1c", " "]), max_size=40).map(" ".join))
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == plain(text)


def classes(fps):
    n = len(fps)
    of = list(range(n))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    return of


def random_fps(n, seed):
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 2**63, n)]
    for _ in range(3 * n):
        x = out[rng.integers(len(out))]
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return [x - 2**64 if x >= 2**63 else x for x in sorted(set(out))]


def test_every_link_shows_at_a_home():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(-(2**63), 2**63, 1)
        y = x.copy()
        for b in rng.choice(64, 4, replace=False):
            y ^= np.int64(np.uint64(1 << int(b)).astype(np.int64))
        _, kx, hx = simhash.anchors(x)
        _, ky, _ = simhash.anchors(y)
        assert set(kx[hx]) & set(ky)
        assert len(kx) == len(set(kx)) <= 45


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", chunk)
    fps = random_fps(40, 5)
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    from shoploom.llm.components import components

    got = {r.node: r.component for r in components(found).collect()}
    want = classes([x % 2**64 for x in fps])
    root = {}
    for x, c in zip(fps, want, strict=True):
        root.setdefault(c, x)  # fps ascend, so the first is the smallest
    assert [got.get(x, x) for x in fps] == [root[c] for c in want]


def test_large_groups_as_small_ones(monkeypatch):
    fps = np.array(random_fps(60, 9), np.int64)
    key, home = np.zeros(len(fps), np.int64), np.ones(len(fps), bool)

    def roots(a, b):
        of = {int(x): int(x) for x in fps}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = of[x], of[y]
            for k, v in of.items():
                if v in (p, q):
                    of[k] = min(p, q)
        return of

    large = roots(*simhash.group_links(key, fps, home))
    monkeypatch.setattr(simhash, "SMALL", 10_000)
    assert roots(*simhash.group_links(key, fps, home)) == large


def test_query_and_keep_one_on_odd_rows(spark, tmp_path):
    base = " ".join(f"word{i % 97}" for i in range(400))
    texts = [None, "", base, base + " end", base.upper(), "un two", "x" * 50_000, "other words that stand alone here"]
    rows = [(i, t, f"s{i}", "clash") for i, t in enumerate(texts)] + [(7, texts[7], "s7", "clash"), (None, "lonely null id row text", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, fp string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_simhash(spark, str(tmp_path)).collect()
    fps = {i: plain(t) for i, t in enumerate(texts)}
    want = classes([fps[i] for i in range(len(texts))])
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want)) and ids.count(None) == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_with_shared_ids(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, words("a"), 1), (None, words("b"), 2), (None, words("b"), 3), (None, words("c"), 4), (5, words("c"), 5)]
    rows += [(7, words("d"), 6), (7, words("e"), 7), (7, words("e"), 8), (3, words("e"), 9), (9, None, 10), (9, "", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in kept.collect())
    assert got == [("", 9), (words("a"), -1), (words("b"), -1), (words("c"), 5), (words("d"), 7), (words("e"), 3)]
