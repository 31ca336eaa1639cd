import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoploom.llm import queries, toxicity


def test_windows_cover_every_word():
    for n in range(0, 200):
        starts = toxicity.window_starts(n)
        covered = {int(s) + i for s in starts for i in range(toxicity.WINDOW)}
        assert set(range(n)) <= covered and (n < toxicity.WINDOW or max(covered) == n - 1)
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_gradient_against_differences():
    net, r = toxicity.Network(3), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = r.normal(size=(9, 2 * toxicity.WIDTH))
    ids, y = r.integers(0, 9, (5, toxicity.WINDOW)), np.array([1.0, 0, 1, 0, 0])
    g, d_x, _ = net.gradient(x, ids, y)
    for name in ("attend", "query", "out", "bias", "in_f", "in_bias_b", "state_f", "state_b"):
        w = net.p[name]
        at = tuple(r.integers(0, s) for s in w.shape)
        w[at] += 1e-3
        up = net.gradient(x, ids, y)[2]
        w[at] -= 2e-3
        down = net.gradient(x, ids, y)[2]
        w[at] += 1e-3
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=2e-5)
    x[4, 5] += 1e-3
    up = net.gradient(x, ids, y)[2]
    x[4, 5] -= 2e-3
    assert d_x[4, 5] == pytest.approx((up - net.gradient(x, ids, y)[2]) / 2e-3, rel=0.03, abs=2e-5)


def texts(n, seed):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = [f"w{chr(97 + int(k) % 26)}{chr(97 + int(k) // 26)}" for k in r.integers(0, 600, r.integers(5, 150))]
        bad = bool(r.random() < 0.4)
        if bad:
            words[r.integers(len(words))] = str(r.choice(["vilewort", "vilemus", "Grobian"]))
        out.append((" ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def network():
    sample = texts(300, 1)
    return toxicity.Network().fit([t for t, _ in sample], [y for _, y in sample], steps=300)


def test_held_out_accuracy(network):
    fresh = texts(300, 2)
    got = toxicity.Scorer(network).scores([t for t, _ in fresh]) >= toxicity.THRESHOLD
    assert np.mean(got == np.array([y for _, y in fresh])) > 0.9


def test_scores_do_not_depend_on_the_batch(network, monkeypatch):
    rows = [t for t, _ in texts(40, 5)] + [None, "", "a", "Grobian " * 3000]
    whole = toxicity.Scorer(network).scores(rows)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 50)
    scorer = toxicity.Scorer(network)
    assert np.allclose(whole, [scorer.scores([t])[0] for t in rows], atol=1e-5)
    assert whole[-4] == whole[-3]


def test_query_on_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 5)
    rows = [(i, t, "x", 0.5) for i, (t, _) in enumerate(texts(30, 7))] + [(30, None, "x", 0.1), (31, "", None, 0.1), (31, "", None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, y) for i, (_, y) in enumerate(texts(30, 7))] + [(None, 1, 1), (3, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op3_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert toxicity.score(docs.limit(0), toxicity.Network()).count() == 0


def test_every_character_is_read(network):
    for text in ("w" * 24 + "vilewort", "日本語のとても長い文" * 30, "short words", "x" * 12, "v1lew0rt!!, (2) v.i.l.e@x", "\x00\x7f ~\t-"):
        letters = b"".join(toxicity.words_of(text))
        assert letters == text.replace(" ", "").replace("\t", "").encode()
        read, _ = toxicity.Network.spelled(toxicity.words_of(text))
        assert b"".join(r.tobytes().rstrip(b"\0") or b"\0" for r in read).replace(b"\0", b"") == letters.replace(b"\0", b"")
    glued = ["wab wcd " + "w" * 24 + end + " waa wba" for end in ("vilewort", "wcdwabwc")]
    bad, clean = toxicity.Scorer(network).scores(glued)
    assert bad >= toxicity.THRESHOLD > clean


@pytest.mark.parametrize("together", [12, 48, 50])
def test_parts_have_every_window_once(monkeypatch, together):
    monkeypatch.setattr(toxicity, "TOGETHER", together)
    for n in range(0, 260):
        words = [str(i).encode() for i in range(n)]
        want = [tuple(words[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(n)]
        got = [tuple(p[s : s + toxicity.WINDOW]) for p in toxicity._parts(" ".join(map(str, range(n)))) for s in toxicity.window_starts(len(p))]
        assert got == want, n


def plain_score(network, text):
    """One text, window by window and word by word, in double precision."""
    p = {k: v.astype(np.float64) for k, v in network.p.items()}
    hidden, sigmoid = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))

    def spelled(word):
        x = p["stem"][zlib.crc32(word[: toxicity.STEM]) % toxicity.BUCKETS] + sum(p["letter"][i][b] for i, b in enumerate(word.ljust(toxicity.LETTERS, b"\0")))
        return np.concatenate([x, p["word"][zlib.crc32(word) % toxicity.BUCKETS]])

    def read(window, d):
        h, out = np.zeros(hidden), []
        for x in window:
            g, a = x @ p[f"in_{d}"] + p[f"in_bias_{d}"], h @ p[f"state_{d}"]
            r, z = sigmoid(g[:hidden] + a[:hidden]), sigmoid(g[hidden : 2 * hidden] + a[hidden : 2 * hidden])
            h = (1 - z) * np.tanh(g[2 * hidden :] + r * a[2 * hidden :]) + z * h
            out.append(h)
        return out

    words, best = toxicity.words_of(text), -np.inf
    for start in range(0, max(1, len(words) - toxicity.WINDOW + 1)):
        if start % toxicity.STRIDE and start != len(words) - toxicity.WINDOW:
            continue
        window = words[start : start + toxicity.WINDOW]
        window = [spelled(w) for w in window + [b""] * (toxicity.WINDOW - len(window))]
        states = [np.concatenate(s) for s in zip(read(window, "f"), read(window[::-1], "b")[::-1], strict=True)]
        e = np.array([np.tanh(s @ p["attend"]) @ p["query"] for s in states])
        weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        best = max(best, sum(w * s for w, s in zip(weight, states, strict=True)) @ p["out"] + p["bias"][0])
    return sigmoid(best)


def test_query_against_a_plain_score(spark, tmp_path, monkeypatch):
    """The query's score of every text against a network that reads it word by word; fitted on all labelled rows that are not held out."""
    monkeypatch.setattr(toxicity.Network.fit, "__defaults__", (60, toxicity.SEED))
    monkeypatch.setattr(toxicity, "TOGETHER", 300)
    base = texts(60, 11)
    rows = [(i, t) for i, (t, _) in enumerate(base)] + [(60, None), (61, ""), (62, "v1lew0rt, (vilemus)! " * 40), (63, "one"), (2, base[2][0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(base)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op3_toxicity(spark, str(tmp_path)).collect()
    usable = [(i, y) for i, (_, y) in enumerate(base) if zlib.crc32(str(i).encode()) % 3 != 1]
    order = spark.createDataFrame(usable, "doc_id long, y int").selectExpr("xxhash64(doc_id) h", "doc_id", "y").orderBy("h").collect()
    network = toxicity.Network().fit([base[r.doc_id][0] for r in order], [r.y for r in order])
    text = dict(rows)
    for r in got:
        want = plain_score(network, text[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-4) and r.predicted == int(r.score >= 0.7), r.doc_id
    assert len(got) == len(rows)


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT", 40)
    seen = {}
    monkeypatch.setattr(toxicity.Network, "fit", lambda self, t, y: seen.update(t=t, y=y) or self)
    docs = spark.createDataFrame([(i, "word " * 3) for i in range(12)] * 30 + [(0, "other"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    for label in (0, 1):
        own = [t for t, y in zip(seen["t"], seen["y"], strict=True) if y == label]
        assert 2 <= len(own) <= 6 and sum(map(len, own)) <= 40 and set(own) <= {"word " * 3, "other", ""}


def test_giant_text_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT", 100)
    seen = {}
    monkeypatch.setattr(toxicity.Network, "fit", lambda self, t, y: seen.update(t=t, y=y) or self)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id")).collect()]
    texts = {i: "giant " * 100 if n < 2 else "small text" for n, i in enumerate(order)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    toxicity.train(docs, labels)
    assert seen["t"] == ["small text"] * len(seen["t"]) and {y: seen["y"].count(y) for y in (0, 1)} == {0: 10, 1: 10}
    docs = spark.createDataFrame([(i, "giant " * 100 if k % 2 else "small text") for k, i in enumerate(ids)], "doc_id long, text string")
    with pytest.raises(ValueError, match="no document of label 1"):
        toxicity.train(docs, labels)
