"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word is a run of letters and digits, or of signs. It enters by its characters,
as a sum of embeddings of each byte by its place and of its first bytes together
(hashed), and by an embedding of the word itself (hashed). A word of over LETTERS
bytes goes as consecutive pieces of that many, each a word of its own, so all but
white space is read. Two gated recurrent layers, one in each
direction, read windows of words; attention pools their states and a logistic
unit scores the window. Windows overlap and cover every whole text; a text's
score is that of its highest window.

The network is trained here in numpy, by backpropagation through time, on a
bounded sample of labelled documents and for a fixed number of steps. Labels are
of documents: the windows that score highest stand for theirs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored, with_fields

#: Words in a window, and between the starts of two windows.
WINDOW, STRIDE = 24, 12
LETTERS, STEM, BUCKETS, WIDTH, HIDDEN, ATTENTION = 12, 5, 32_749, 16, 8, 8
#: The bound of the training sample: documents of each label, and the characters that those of one label have together.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_TEXT = 1500, 3000, 20_000_000
STEPS, BATCH, SEED, RATE = 600, 48, 11, 0.06
#: Windows of a document in a step: at random in the first third, then the highest; of a clean document those of as many drawn ones.
EARLY, LATE, DRAWN = 8, 3, 24
THRESHOLD = 0.7
#: Words whose inputs a worker keeps; windows that run side by side; words of texts that are scored together, and of one part of a text.
KEPT_WORDS, ABREAST, TOGETHER = 80_000, 2048, 60_000

_PIECE = re.compile(rb"[0-9a-z\x80-\xff]{1,%d}|[^0-9a-z\x80-\xff\x20\x09-\x0d]{1,%d}" % (LETTERS, LETTERS))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words in UTF-8, longer ones in pieces of LETTERS bytes."""
    return _PIECE.findall((text or "").lower().encode())


def _parts(text: str | None):
    """The words of a text in parts that have all of its windows between them, each once; one part unless the text is long."""
    words, part = _PIECE.finditer((text or "").lower().encode()), []
    step = TOGETHER // STRIDE * STRIDE
    while True:
        part += [m[0] for m in islice(words, step + WINDOW + 1 - len(part))]
        if len(part) <= step + WINDOW:
            yield part
            return
        yield part[: step + WINDOW - STRIDE]
        part = part[step:]


def window_starts(n: int) -> np.ndarray:
    """Where the windows over n words begin; the last ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def _windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of each document's word ids (0 fills up), and each document's first window."""
    rows, first, n = [], [], 0
    for doc in ids:
        starts = window_starts(len(doc))
        if len(doc) < WINDOW:
            doc = np.concatenate([doc, np.zeros(WINDOW - len(doc), doc.dtype)])
        rows.append(doc[starts[:, None] + np.arange(WINDOW)])
        first.append(n)
        n += len(starts)
    return np.concatenate(rows), np.array(first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)

        def some(scale, *shape):
            return (r.normal(size=shape) * scale).astype(np.float32)

        self.p = {"letter": some(0.1, LETTERS, 256, WIDTH), "stem": some(0.1, BUCKETS, WIDTH), "word": some(0.1, BUCKETS, WIDTH), "attend": some(0.3, 2 * HIDDEN, ATTENTION), "query": some(0.3, ATTENTION), "out": some(0.3, 2 * HIDDEN), "bias": np.full(1, -1.0, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": some(0.25, 2 * WIDTH, 3 * HIDDEN), f"in_bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"state_{d}": some(0.25, HIDDEN, 3 * HIDDEN)}

    # inputs

    @staticmethod
    def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Letters by place, and the buckets of each word and of its first letters."""
        letters = np.frombuffer(b"".join([w[:LETTERS].ljust(LETTERS, b"\0") for w in words]), np.uint8).reshape(-1, LETTERS)
        return letters, np.array([(zlib.crc32(w) % BUCKETS, zlib.crc32(w[:STEM]) % BUCKETS) for w in words], np.int64).reshape(-1, 2)

    def inputs(self, letters: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        x = np.zeros((len(letters), 2 * WIDTH), np.float32)
        for i in range(LETTERS):
            x[:, :WIDTH] += self.p["letter"][i][letters[:, i]]
        x[:, :WIDTH] += self.p["stem"][bucket[:, 1]]
        x[:, WIDTH:] = self.p["word"][bucket[:, 0]]
        return x

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What a word adds to the gates: both directions, side by side."""
        return np.concatenate([x @ self.p[f"in_{d}"] + self.p[f"in_bias_{d}"] for d in "fb"], axis=1)

    # windows

    def _read(self, gates: np.ndarray, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """The states (windows, places, hidden) in one direction."""
        n, u, h = len(ids), self.p[f"state_{d}"], np.zeros((len(ids), HIDDEN), np.float32)
        states = np.empty((n, WINDOW, HIDDEN), np.float32)
        own = gates[:, : 3 * HIDDEN] if d == "f" else gates[:, 3 * HIDDEN :]
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            g, a = own[ids[:, t]], h @ u
            rz = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, r, z, c, a[:, 2 * HIDDEN :]))
            h = c + z * (h - c)
            states[:, t] = h
        return states

    def _pool(self, states: np.ndarray) -> tuple[np.ndarray, ...]:
        seen = np.tanh(states @ self.p["attend"])
        e = seen @ self.p["query"]
        weight = np.exp(e - e.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = (weight[:, None, :] @ states)[:, 0]
        return seen, weight, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, gates: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The score of each window, before the logistic function."""
        out = [np.zeros(0, np.float32)]
        for at in range(0, len(ids), ABREAST):
            part = ids[at : at + ABREAST]
            out.append(self._pool(np.concatenate([self._read(gates, part, "f"), self._read(gates, part, "b")], axis=2))[3])
        return np.concatenate(out)

    # training

    def gradient(self, x: np.ndarray, ids: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the mean logistic loss over windows; also by the words' inputs x."""
        p, gates, kept = self.p, self.gates(x), {"f": [], "b": []}
        states = np.concatenate([self._read(gates, ids, d, kept[d]) for d in "fb"], axis=2)
        seen, weight, pooled, logit = self._pool(states)
        n = len(ids)
        d_logit = (_sigmoid(logit) - label) / n
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = (states @ d_pooled[:, :, None])[..., 0]
        d_e = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        d_pre = d_e[..., None] * p["query"] * (1 - seen**2)
        g["query"] = np.einsum("nt,nta->a", d_e, seen)
        g["attend"] = np.einsum("nth,nta->ha", states, d_pre)
        d_states = weight[..., None] * d_pooled[:, None, :] + d_pre @ p["attend"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, d_u, d_h = p[f"state_{d}"], np.zeros_like(p[f"state_{d}"]), np.zeros((n, HIDDEN), np.float32)
            d_gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, h, r, z, c, a in reversed(kept[d]):
                d_h = d_h + d_states[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                d_c = d_h * (1 - z) * (1 - c**2)
                d_z = d_h * (h - c) * z * (1 - z)
                d_r = d_c * a * r * (1 - r)
                d_a = np.concatenate([d_r, d_z, d_c * r], axis=1)
                np.add.at(d_gates, ids[:, t], np.concatenate([d_r, d_z, d_c], axis=1))
                d_u += h.T @ d_a
                d_h = d_h * z + d_a @ u.T
            g[f"state_{d}"], g[f"in_{d}"], g[f"in_bias_{d}"] = d_u, x.T @ d_gates, d_gates.sum(0)
            d_x += d_gates @ p[f"in_{d}"].T
        loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
        return g, d_x, loss

    def fit(self, texts: list[str], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Network:
        """AdaGrad on balanced batches; the same number of steps for any sample."""
        r = np.random.default_rng(seed)
        of: dict[bytes, int] = {}
        docs = [np.array([of.setdefault(w, len(of) + 1) for w in words_of(t)], np.int64) for t in texts]
        letters, bucket = self.spelled([b"", *of])
        by = [[i for i, y in enumerate(labels) if bool(y) == bool(k)] for k in (0, 1)]
        if not by[0] or not by[1]:
            return self
        seen = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}
        for step in range(steps):
            chosen = [int(i) for group in by for i in r.choice(group, BATCH // 2)]
            rows, first = _windows([docs[i] for i in chosen])
            size = np.diff(np.append(first, len(rows)))
            if step >= steps // 3 and size.max() > DRAWN:  # all windows of a clean document are clean, so any may stand for it
                some = [f + (r.choice(s, DRAWN, replace=False) if s > DRAWN and not labels[i] else np.arange(s)) for i, f, s in zip(chosen, first, size, strict=True)]
                rows, size = rows[np.concatenate(some)], np.array([len(x) for x in some])
                first = np.cumsum(size) - size
            used, ids = np.unique(rows, return_inverse=True)
            ids = ids.reshape(rows.shape)
            x = self.inputs(letters[used], bucket[used])
            if step < steps // 3:  # any windows, until the scores mean something
                take = np.concatenate([f + r.choice(s, min(EARLY, s), replace=False) for f, s in zip(first, size, strict=True)])
            else:
                logit = self.logits(self.gates(x), ids)
                take = np.concatenate([f + np.argsort(-logit[f : f + s])[:LATE] for f, s in zip(first, size, strict=True)])
            doc_of = np.repeat(np.arange(len(chosen)), size)
            y = np.array([labels[i] for i in chosen], np.float32)[doc_of[take]]
            own, at = np.unique(ids[take], return_inverse=True)  # only the words of these windows learn
            g, d_x, _ = self.gradient(x[own], at.reshape(len(take), WINDOW), y)
            for k, v in g.items():
                seen[k] += v * v
                self.p[k] -= RATE * v / np.sqrt(seen[k])
            own = used[own]
            places = np.arange(LETTERS) * 256 + letters[own]
            self._learn(seen, "word", bucket[own, 0], d_x[:, WIDTH:])
            self._learn(seen, "stem", bucket[own, 1], d_x[:, :WIDTH])
            self._learn(seen, "letter", places.reshape(-1), np.repeat(d_x[:, :WIDTH], LETTERS, axis=0))
        return self

    def _learn(self, seen: dict[str, np.ndarray], name: str, rows: np.ndarray, change: np.ndarray) -> None:
        """A step of some rows of a table of embeddings, which may be named more than once."""
        some, at = np.unique(rows, return_inverse=True)
        order = np.argsort(at, kind="stable")
        g = np.add.reduceat(change[order], np.searchsorted(at[order], np.arange(len(some))), axis=0)
        table, squares = self.p[name].reshape(-1, WIDTH), seen[name].reshape(-1, WIDTH)
        squares[some] += g * g
        table[some] -= RATE * g / np.sqrt(squares[some])


class Scorer:
    """Scores batches of texts; keeps the gate inputs of words between them."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self._forget()

    def _forget(self) -> None:
        self.of, self.table = {b"": 0}, self.network.gates(self.network.inputs(*self.network.spelled([b""])))

    def scores(self, texts: Iterable[str | None], count: int | None = None) -> np.ndarray:
        """Of each text the score of its highest window; long texts go in parts, short ones together."""
        best, held, size = np.full(len(texts) if count is None else count, -np.inf), [], 0
        for i, text in enumerate(texts):
            for part in _parts(text):
                held.append((i, part))
                size += len(part)
                if size >= TOGETHER:
                    self._into(best, held)
                    held, size = [], 0
        if held:
            self._into(best, held)
        return _sigmoid(best)

    def _into(self, best: np.ndarray, held: list[tuple[int, list[bytes]]]) -> None:
        if len(self.of) > KEPT_WORDS:
            self._forget()
        of = self.of
        new = {w for _, d in held for w in d if w not in of}
        if new:
            of.update(zip(new, range(len(of), len(of) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.network.gates(self.network.inputs(*self.network.spelled(list(new))))])
        rows, first = _windows([np.fromiter(map(of.__getitem__, d), np.int64, len(d)) for _, d in held])
        top = np.maximum.reduceat(self.network.logits(self.table, rows), first).astype(np.float64)
        np.maximum.at(best, [i for i, _ in held], top)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fits a network on a bounded sample of the labelled documents that are not held out.

    The sample has at most SAMPLE_TOXIC and SAMPLE_CLEAN documents, first in the
    order of a hash of doc_id, and of each label at most SAMPLE_TEXT characters: a
    document that doesn't fit into what is left of them is passed over, so it is in the
    sample with its whole text or not at all. Of rows that share a doc_id one counts.
    Without documents of both labels the network stays as it was drawn; documents of a
    label of which none fits raise.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    limits = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    first = [usable.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(n) for k, n in limits.items()]
    wanted = F.broadcast(first[0].unionAll(first[1]))  # bounded by the two limits
    found = docs.select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id", "h", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = stored(found)
    lengths = found.select("h", "doc_id", "toxic", F.length(F.coalesce("text", F.lit(""))).alias("n")).collect()  # no texts yet
    chosen, left = [], {k: SAMPLE_TEXT for k in limits}
    for r in sorted(lengths, key=lambda r: (r.h, r.doc_id)):
        if r.n <= left[r.toxic]:
            left[r.toxic] -= r.n
            chosen.append(r.doc_id)
    for label in limits:
        if any(r.toxic == label for r in lengths) and not any(r.toxic == label and r.n <= SAMPLE_TEXT for r in lengths):
            raise ValueError(f"no document of label {label} has at most {SAMPLE_TEXT} characters")
    rows = found.where(F.col("doc_id").isin(chosen)).select("h", "toxic", "text").collect() if chosen else []
    sample = sorted((r.h, r.toxic, r.text or "") for r in rows)
    return Network().fit([t for _, _, t in sample], [y for _, y, _ in sample])


def score(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """Adds score, from 0 to 1, and predicted (1 from THRESHOLD on); keeps the other columns.

    A null or empty text is one empty window. Repeated rows stay, equal texts
    have equal scores; columns named score or predicted are replaced. An empty
    table gives an empty result.
    """
    schema = with_fields(docs, {"score": "double", "predicted": "int"})
    kept = schema.names[:-2]

    def run(batches):
        scorer = Scorer(network)
        for batch in batches:
            found = np.round(scorer.scores((t.as_py() for t in batch.column(text)), batch.num_rows), 6)
            new = [pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=schema.names)

    return docs.mapInArrow(run, schema)
