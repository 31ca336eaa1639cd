"""SimHash near-duplicates by anchor-point covering.

Fingerprints whose 64 bits differ in at most four places agree but for one bit
in at least one of three parts of 22, 21 and 21 bits. The anchors of a part are
the words of a covering code: the Hamming code of length 15 on its first bits,
all values on the rest, so its covering radius is one. A fingerprint is at home
at its nearest anchor, and also visits every anchor within radius plus threshold
that a fingerprint one bit away can have as its home: at most 15 of them. Any
link then shows at the home of either end, where fingerprints are compared in
full. Anchors with very many fingerprints are split into pairs of chunks, so
memory stays bounded and no pair is missed.

Only distinct fingerprints are compared, and an anchor gives back links to one
member of each group it finds, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import cut, with_fields

SHINGLE_WORDS, SEED, MOST_BITS = 4, 42, 4
#: First bit and width of each part: more parts than MOST_BITS // 2, so one of them differs in a bit at most.
PARTS = ((0, 22), (22, 21), (43, 21))
HAMMING = 15
#: Rows of an anchor that one task compares with one another; beyond it, chunks of that many.
CHUNK_ROWS = 20_000
#: Groups up to this size are compared side by side, larger ones one at a time.
SMALL = 64
BATCH_ROWS = 512


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's shingles of four words, as a signed 64-bit number; zero without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space as in [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    last = ends[SHINGLE_WORDS - 1 :] if len(words) >= SHINGLE_WORDS else ends[-1:]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.fromiter([digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds fp, the signed 64-bit fingerprint of each whole text (null: empty), and drops the text."""
    slim = docs.select(text, *[c for c in docs.columns if c not in (text, "fp")])
    schema = with_fields(slim.drop(text), {"fp": "long"})
    names = schema.names

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = pa.array([fingerprint(t) for t in part.column(text).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), found], names=names)

    return slim.mapInArrow(run, schema)


def _flips() -> list[np.ndarray]:
    """By syndrome of the Hamming code: what to flip for the nearest word, then for those at distance two."""
    out = [np.zeros(1, np.int64)]
    for s in range(1, HAMMING + 1):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, HAMMING + 1) if i < i ^ s]
        out.append(np.array([1 << (s - 1), *pairs], np.int64))
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of each fingerprint: row, anchor (with its part in the upper bits) and whether it is home."""
    bits = fps.view(np.uint64)
    rows, keys, homes = [], [], []
    flips = _flips()
    for number, (first, width) in enumerate(PARTS):
        part = ((bits >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
        syndrome = np.zeros(len(part), np.int64)
        for i in range(HAMMING):
            syndrome ^= np.where((part >> i) & 1, i + 1, 0)
        base = np.int64(number) << 40
        for s in range(HAMMING + 1):
            own = np.flatnonzero(syndrome == s)
            for k, flip in enumerate(flips[s]):
                rows.append(own)
                keys.append(base | (part[own] ^ flip))
                homes.append(np.full(len(own), k == 0))
            for i in range(HAMMING, width):
                rows.append(own)
                keys.append(base | (part[own] ^ flips[s][0] ^ (1 << i)))
                homes.append(np.zeros(len(own), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _visits(fps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            row, key, home = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)) <= most


def _group_links(fp: np.ndarray, home: np.ndarray, most: int):
    """Links of one group: every member that is linked with a home, over any members, to the first such home."""
    left = np.arange(len(fp))
    for pivot in np.flatnonzero(home):
        at = np.searchsorted(left, pivot)
        if at >= len(left) or left[at] != pivot:
            continue
        left, todo, found = np.delete(left, at), np.array([pivot]), []
        while len(todo) and len(left):
            step = max(1, 2_000_000 // len(left))
            near = np.zeros(len(left), bool)
            for i in range(0, len(todo), step):
                near |= _close(fp[todo[i : i + step], None], fp[None, left], most).any(0)
            todo, left = left[near], left[~near]
            found.append(todo)
        hits = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(hits):
            yield fp[hits], np.full(len(hits), fp[pivot])


def group_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys, enough to connect what is connected there."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    a, b = [], []
    group = np.repeat(np.arange(len(start)), size)
    rows = np.flatnonzero(home & (size[group] <= SMALL) & (size[group] > 1))
    for at in range(0, len(rows), 1 << 15):
        own = rows[at : at + (1 << 15)]
        n = size[group[own]]
        left = np.repeat(own, n)
        right = np.repeat(start[group[own]], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = _close(fp[left], fp[right], most) & (left != right)
        a.append(fp[left[near]])
        b.append(fp[right[near]])
    for g in np.flatnonzero(size > SMALL):
        own = slice(start[g], start[g] + size[g])
        for x, y in _group_links(fp[own], home[own], most):
            a.append(x)
            b.append(y)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints fp whose bits differ in at most four places."""
    visits = _visits(fps)
    crowded = cut(visits.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK_ROWS))
    if crowded.isEmpty():
        dealt = visits.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        chunks = F.coalesce(F.ceil(F.col("n") / CHUNK_ROWS), F.lit(1)).cast("int")
        dealt = (
            visits.join(crowded, "anchor", "left")
            .withColumn("chunks", chunks)
            .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("anchor", "fp", "home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        )
    spread = dealt.withColumn("key", F.xxhash64("anchor", "i", "j"))

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("key").to_numpy()
            if not len(key):
                continue
            cut_at = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut_at or (held and held[-1].column("key")[-1].as_py() != key[0]):
                yield compare([*held, batch.slice(0, cut_at)])
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield compare(held)

    def compare(parts):
        table = pa.Table.from_batches(parts)
        a, b = group_links(*(table.column(c).to_numpy() for c in ("key", "fp", "home")))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = spread.select("key", "fp", "home").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long")


def _rooted(marked: DataFrame, value: Column) -> DataFrame:
    """Each distinct fp, the root of its component (never null) and the smallest value of its rows, first."""
    fps = cut(marked.groupBy("fp").agg(F.min(value).alias("first")))
    member = components(links(fps))
    return fps.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds fp and component_id, the smallest doc_id reachable over links, and drops the text.

    docs needs doc_id and the text. A null or empty text has the fingerprint
    zero, linked like any other. Rows with a null doc_id take part; a component
    of nothing else has a null component_id. Repeated rows stay; columns named
    fp or component_id are replaced. An empty table gives an empty result.
    """
    marked = cut(fingerprints(docs.drop("component_id"), text))
    rooted = _rooted(marked, F.col("doc_id"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut(rooted.select("fp", "root").join(smallest.repartition("component_id"), "root").select("fp", "component_id"))
    return marked.join(classes, "fp")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """Keeps one row of each component, with its own columns: that of the smallest doc_id.

    A null doc_id comes after all others; of rows that share doc_id the one whose
    text has the least hash stays. Rows that share a doc_id, null or not, are
    otherwise told apart by their texts, so each component keeps its row.
    """
    digest = lambda c: F.unhex(F.md5(c))
    marked = cut(fingerprints(docs.select("doc_id", text, digest(F.col(text)).alias("mark")), text))
    rooted = _rooted(marked, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark"))
    kept = cut(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.mark"))
    again = marked.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    twice = cut(kept.alias("k").join(again.alias("g"), same("k", "g") & F.col("k.mark").eqNullSafe(F.col("g.mark")), "left_semi"))

    def rows(of: DataFrame) -> DataFrame:
        return docs.alias("d").join(of.alias("k"), same("d", "k") & digest(F.col(f"d.{text}")).eqNullSafe(F.col("k.mark")), "left_semi")

    if twice.isEmpty():
        return rows(kept)
    once = kept.alias("k").join(twice.alias("g"), same("k", "g") & F.col("k.mark").eqNullSafe(F.col("g.mark")), "left_anti")
    return rows(once).unionByName(rows(twice).dropDuplicates(["doc_id", text]))
