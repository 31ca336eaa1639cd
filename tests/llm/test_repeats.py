import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shoploom.llm import queries, repeats


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(1, 4))
def test_suffix_array(values, times):
    s = np.array(values * times, np.int64)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert repeats.suffix_array(s).tolist() == want


@pytest.mark.parametrize("anchor", repeats.ANCHORS)
def test_segments_cover_every_window_once(anchor):
    data = np.random.default_rng(anchor).integers(97, 100, 900).astype(np.uint8).tobytes()
    key, first, count = repeats.segments(data, anchor)
    assert [w for a, n in zip(first, count, strict=True) for w in range(a, a + n)] == list(range(len(data) - 99))
    assert len(set(zip(key.tolist(), [data[a : a + 100] for a in first.tolist()], strict=True))) <= len(key)
    again, moved, _ = repeats.segments(b"x" * 40 + data, anchor)
    own = {int(w): int(k) for k, a, n in zip(key, first, count, strict=True) for w in range(a, a + n)}
    shifted = {int(w): int(k) for k, a, n in zip(again, moved, repeats.segments(b"x" * 40 + data, anchor)[2], strict=True) for w in range(a, a + n)}
    assert all(shifted[w + 40] == k for w, k in own.items())  # equal windows, equal anchors


def test_suffix_array_of_large_numbers():
    r = np.random.default_rng(0)
    s = np.tile(r.integers(1, 1 << 22, 500), 3)
    assert repeats.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def plain(docs):
    """docs in order: kept bytes and removed runs of each."""
    seen, out = set(), []
    for data in docs:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out.append((np.frombuffer(data, np.uint8)[~gone].tobytes(), len(edges) // 2))
    return out


def corpus(seed):
    r = np.random.default_rng(seed)
    words = ["the", "of", "tionre", "été", "ä", "heand", "x"]
    make = lambda n: " ".join(r.choice(words, n))
    passages = [make(60) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [make(int(r.integers(0, 60)))]
        for _ in range(int(r.integers(0, 3))):
            p = passages[r.integers(4)]
            a = int(r.integers(0, 60))
            parts += [p[a:], make(int(r.integers(0, 8)))]
        texts.append(" ".join(parts))
    texts += [texts[3], texts[5], None, "", "short", "ab" * 400, "a" * 99, "a" * 100, "a" * 101, "b" * 350, texts[1] + "!", "é" * 70_000]
    return texts


@pytest.mark.parametrize("group", [20_000, 2])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "PIECE", 1 << 12)
    monkeypatch.setattr(repeats, "SORTED_BYTES", 3000)
    monkeypatch.setattr(repeats, "TOGETHER", 60 if group == 2 else 200_000)
    texts = corpus(group)
    rows = [(7 * i % 1000, t, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(rows, key=lambda r: r[0])
    want = plain([(t or "").encode() for _, t, _ in order])
    got = {r.doc_id: r for r in queries.op5_repeated_bytes(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for (i, t, _), (kept, n) in zip(order, want, strict=True):
        data = (t or "").encode()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(data), len(data) - len(kept), n), i
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert sum(r.n_removed for r in got.values()) > 0


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_wanted_in_batches(spark, size):
    """Segments of anchors that occur twice, whatever batches they come in."""
    r = np.random.default_rng(size)
    for _ in range(3):
        keys = r.integers(0, 30, 40)
        rows = [(int(k), int(r.random() < 0.1) * 2, int(k), i, 0, 5, 1) for i, k in enumerate(keys)]
        rows += [(int(r.integers(0, 30)), 1, int(k) + 100, 100 + i, 0, 5, 1) for i, k in enumerate(r.integers(0, 3, 8))]
        df = spark.createDataFrame(rows, "to long, known tinyint, key long, doc long, sub long, first long, count long")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = sorted((x.key, x.doc) for x in repeats._wanted(df).collect())
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        n = np.bincount([x[0] for x in rows if x[1] != 1], minlength=30)
        assert got == sorted((x[2], x[3]) for x in rows if x[1] == 1 or (x[1] == 0 and n[x[0]] > 1))


def test_many_copies_and_a_common_line(spark, monkeypatch):
    """Groups far beyond the size of one: equal documents, and one line in many contexts."""
    monkeypatch.setattr(repeats, "GROUP", 8)
    r = np.random.default_rng(3)
    own = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    copy, line = own(250), own(70)
    texts = [copy] * 60 + [own(60) + line + own(60) for _ in range(80)] + [own(30) + copy[40:200] + line + own(20), copy[:-1]]
    want = plain([t.encode() for t in texts])
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(bytes(x.kept), x.n_spans) for x in got] == want


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text + " more"), (None, "zz " + text), (2, text)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert all(r.n_removed >= len(text) for r in got if r.doc_id is not None)
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_anchor_without_a_repeat(spark):
    shared = "".join(chr(97 + i * i * 7 % 26) for i in range(60))
    rows = [(i, "".join(chr(97 + (i + 3) * (k + 1) ** 2 % 26) for k in range(80)) + shared + "".join(chr(97 + (i + 5) * (k + 2) ** 3 % 26) for k in range(80))) for i in range(8)]
    want = plain([t.encode() for _, t in rows])
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(bytes(r.kept), r.n_spans) for r in got] == want


@pytest.mark.parametrize("group", [20_000, 1])
def test_repeated_row_is_no_copy_of_itself(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    shared = "".join(chr(97 + i * i * 7 % 26) for i in range(40)) + " ".join(f"w{i * 37}" for i in range(40))
    own = lambda k: " ".join(f"{k}{i * i}" for i in range(60))
    texts = [own("p") + shared + own("q"), own("r") + shared + own("s")]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[0]), (2, texts[1])]
    want = plain([t.encode() for t in texts])
    assert want[0] == (texts[0].encode(), 0) and want[1][1] == 1
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(bytes(r.kept), r.n_spans) for r in got] == [want[0]] * 3 + [want[1]]


def test_digests_that_collide(spark, monkeypatch):
    """Five texts of one doc_id and one hexadecimal digit: salts are tried until no two have the same."""
    monkeypatch.setattr(repeats, "SUB_DIGITS", 1)
    texts = [" ".join(f"{k}{i * i}" for i in range(40)) for k in "abcde"]
    rows = [(None, t) for t in texts] + [(7, texts[0]), (None, texts[1])]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_bytes=True).collect()
    assert sorted(bytes(r.kept).decode() for r in got if r.doc_id is None) == sorted([*texts, texts[1]])
    assert [r.n_removed for r in got if r.doc_id == 7] == [len(texts[0])]


def test_suffix_array_of_wanted_places_and_to_a_depth():
    r = np.random.default_rng(5)
    for _ in range(200):
        s = np.tile(r.integers(1, r.integers(2, 300), r.integers(0, 30)), r.integers(1, 5))
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        mask = r.random(len(s)) < 0.4
        assert repeats.suffix_array(s, mask).tolist() == [i for i in want if mask[i]]
        depth = int(r.integers(1, 20))
        got = repeats.suffix_array(s, depth=depth).tolist()
        assert sorted(got) == list(range(len(s)))
        whole = [s[i : i + depth].tolist() for i in got if i + depth <= len(s)]
        assert whole == sorted(whole)


@pytest.mark.parametrize("period", [1, 37, 138])
def test_later_windows_of_copies_take_few_levels(monkeypatch, period):
    """Recursion ends when names are longer than a window, and numbers sorted stay in proportion, whatever repeats."""
    lengths = []
    ordered = repeats._ordered
    monkeypatch.setattr(repeats, "_ordered", lambda s, *rest: lengths.append(len(s)) or ordered(s, *rest))
    r = np.random.default_rng(period)
    text = np.tile(r.integers(0, 256, period).astype(np.uint8), 600)  # byte 0 too
    at, size = r.integers(0, len(text) - 300 if period > 1 else 300, 250), r.integers(99, 180, 250)
    data = np.concatenate([text[a : a + n] for a, n in zip(at, size, strict=True)])
    doc, none = r.permutation(250), np.zeros(250, np.int64)
    own, offset = repeats.later_windows(data, size, doc, none, at)
    assert len(lengths) <= 6 and sum(lengths) < 3 * len(data)
    oldest, windows = {}, []
    starts = np.cumsum(size) - size
    for k in np.argsort(doc):
        for w in range(size[k] - 99):
            b = data[starts[k] + w : starts[k] + w + 100].tobytes()
            if b in oldest:
                windows.append((int(k), w))
            oldest.setdefault(b, k)
    assert list(zip(own.tolist(), offset.tolist(), strict=True)) == sorted(windows)
