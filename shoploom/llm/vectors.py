"""Embedding near-duplicates by robust-pruned flat graphs on overlapping shards.

Equal vectors are taken together. Each distinct vector goes to its nearest few
cluster centres, so shards overlap; shards beyond a size are clustered again in
the same way, so the number of centres grows with the vectors while no more than
a bounded number is fitted at once. On every shard a flat graph is built as in
Subramanya et al., "DiskANN" (NeurIPS 2019): vectors are put in batch by batch,
each finds its candidates by greedy search of the graph so far, keeps a robustly
pruned few of them and is offered to these in turn; a second pass does the same on
the whole graph. The adjacency lists that a vector has in its shards are united.
Every vector is then searched in its shards, over the united lists: greedily from
the shard's medoid and from the vector's own place, and from each vector in range
on to its neighbours in range. Cosines are verified in double precision.

A pair that meets in several shards counts in the first one that they share, so
links are counted without writing pairs; a link that is missed there but found in
a later shard joins the components and isn't counted. For components a shard gives
back one edge for each vector at most. Shards that clustering can't make smaller
are split at random into chunks, and each pair of chunks is built and searched as
a graph of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import cut

COSINE = 0.95
#: Shards of each vector; vectors of a shard on average; vectors of a chunk at most.
OVERLAP, SHARD, CHUNK = 3, 1500, 3000
#: The bound of the sample that centres are fitted on, sample vectors for a centre, and rounds.
SAMPLE, FOR_CENTRE, ROUNDS = 131_072, 64, 8
#: Bytes of a sample's vectors in single precision, and vectors that are compared with all centres at once.
SAMPLE_BYTES, AT_ONCE = 64 << 20, 1024
#: Kept neighbours of a vector, candidates they are chosen from, and how much nearer another neighbour must be to replace one.
DEGREE, CANDIDATES, ALPHA = 24, 40, 1.2
#: Places of the greedy search's beam, and its steps.
BEAM, HOPS = 12, 24
#: Queries that search side by side.
ABREAST = 256
#: A shard is clustered again unless this part of it stays together; and how often at most.
STUCK, DEPTH = 0.7, 4


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that can link: no null id, no null or non-finite part, not zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda x: x != 0)).distinct()


def _fitted(x: np.ndarray, want: int) -> np.ndarray:
    """Cluster centres of vectors, on the sphere; the first vectors are where they begin. Vectors are taken a block at a time."""
    c = _unit(x[:want].astype(np.float64))
    for _ in range(ROUNDS):
        sums = np.zeros_like(c)
        for at in range(0, len(x), AT_ONCE):
            part = _unit(x[at : at + AT_ONCE].astype(np.float64))
            near = (part @ c.T).argmax(1)
            order = np.argsort(near, kind="stable")
            some, first = np.unique(near[order], return_index=True)
            sums[some] += np.add.reduceat(part[order], first, axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    return c


def _wanted(n: int) -> int:
    """Centres for so many vectors, as far as one sample goes."""
    return max(1, min(SAMPLE // FOR_CENTRE, -(-n * OVERLAP // SHARD)))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    k = min(OVERLAP, len(c))
    parts = [np.argpartition(-(x[at : at + AT_ONCE] @ c.T), k - 1, axis=1)[:, :k] for at in range(0, len(x), AT_ONCE)]
    return np.sort(np.concatenate(parts), axis=1)


def centres(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Cluster centres by length of vector, from a sample that is bounded and first in the order of a hash.

    Bounded are its vectors and their bytes: longer vectors make a smaller sample.
    """
    want = _wanted(n)
    longest = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = min(want * FOR_CENTRE, max(1, SAMPLE_BYTES // (4 * max(1, longest))))
    first = classes.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(rows)
    table = first.select(F.col("embedding").cast("array<float>").alias("embedding")).toArrow()
    by_size: dict[int, list[np.ndarray]] = {}
    for column in table.column("embedding").chunks:
        sizes = column.value_lengths().to_numpy()
        for size in np.unique(sizes):
            own = column.filter(pa.array(sizes == size)).flatten().to_numpy(zero_copy_only=False)
            by_size.setdefault(int(size), []).append(own.reshape(-1, size))
    del table
    return {size: _fitted(np.concatenate(parts), want) for size, parts in by_size.items()}


def assign(classes: DataFrame, by_size: dict[int, np.ndarray]) -> DataFrame:
    """(shard, id, copies, vec): a row for each shard of each class."""
    base = {size: k * (SAMPLE + 1) for k, size in enumerate(sorted(by_size))}

    def run(frames):
        for frame in frames:
            out = []
            for size, part in frame.groupby(frame["embedding"].map(len)):
                c = by_size.get(size)
                if c is None:  # no vector of this length in the sample: one shard for them
                    shards = np.full((len(part), 1), -int(size), np.int64)
                else:
                    shards = base[size] + _nearest(_unit(np.stack(part["embedding"].to_numpy()).astype(np.float64)), c)
                for s in range(shards.shape[1]):
                    out.append(pd.DataFrame({"shard": shards[:, s], "id": part["id"].to_numpy(), "copies": part["copies"].to_numpy(), "vec": part["embedding"].to_list()}))
            if out:
                yield pd.concat(out)

    return classes.mapInPandas(run, _MEMBER)


_MEMBER = "shard long, id long, copies long, vec array<double>"


def _clustered_again(members: DataFrame, crowded: DataFrame) -> DataFrame:
    """The members of crowded shards (shard, n) in shards of their own; of those around fewer centres than two, as they are.

    Each shard's centres are fitted on a sample of it; members meet them in parts
    of about CHUNK, so no task holds a shard.
    """
    sized = members.join(crowded, "shard").withColumn("want", F.least(F.lit(SAMPLE // FOR_CENTRE), F.ceil(F.col("n") * OVERLAP / SHARD)).cast("long"))
    rows = F.least(F.col("want") * FOR_CENTRE, F.lit(SAMPLE_BYTES) / (8 * F.greatest(F.size("vec"), F.lit(1))))
    every = F.greatest(F.lit(1), F.floor(F.col("n") / rows)).cast("long")
    sample = sized.where(F.pmod(F.xxhash64("id", "shard"), every) == 0).select("shard", "want", "id", "vec")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        c = _fitted(np.stack(frame["vec"].to_numpy()), int(frame["want"].iloc[0]))
        return pd.DataFrame({"shard": frame["shard"].iloc[0], "centre": np.arange(len(c)), "vec": list(c)})

    found = cut(sample.groupBy("shard").applyInPandas(fit, "shard long, centre long, vec array<double>"))
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = sized.select("shard", "id", "copies", "vec", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    spread = found.join(crowded, "shard").select("shard", "centre", "vec", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

    def place(own: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"shard": [], "id": [], "copies": [], "vec": []})
        c = c.sort_values("centre")
        near = _nearest(_unit(np.stack(own["vec"].to_numpy()).astype(np.float64)), np.stack(c["vec"].to_numpy()))
        shard = own["shard"].to_numpy()[:, None] * (SAMPLE + 1) + 1 + near  # a number of its own up to four levels deep
        return pd.concat([pd.DataFrame({"shard": shard[:, k], "id": own["id"], "copies": own["copies"], "vec": own["vec"]}) for k in range(near.shape[1])])

    return dealt.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInPandas(place, _MEMBER)


def sharded(classes: DataFrame, n: int) -> DataFrame:
    """(shard, id, copies, vec, shards): the members of shards of at most CHUNK, where clustering gets there, beside all shards of each."""
    now, kept, before = cut(assign(classes, centres(classes, n))), [], None
    for _ in range(DEPTH):
        sizes = cut(now.groupBy("shard").agg(F.count("*").alias("n")))
        crowded = sizes.where(F.col("n") > CHUNK)
        if before is not None:  # a shard that has most of what it came from stays as it is
            stuck = F.col("n") > STUCK * F.col("above")
            crowded = crowded.join(before.select(F.col("shard").alias("from"), F.col("n").alias("above")), F.expr(f"(shard - 1) div {SAMPLE + 1}") == F.col("from")).where(~stuck).select("shard", "n")
        crowded = cut(crowded)
        if crowded.isEmpty():
            break
        kept.append(now.join(crowded, "shard", "left_anti"))
        now, before = cut(_clustered_again(now, crowded)), crowded
    for part in kept:
        now = now.unionByName(part)
    shards = now.groupBy("id").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    return cut(now.dropDuplicates(["shard", "id"]).join(shards, "id"))


# --- the graph of a shard ---


def _pruned(x: np.ndarray, own: np.ndarray, near: np.ndarray) -> np.ndarray:
    """At most DEGREE of each own row's candidates (-1 fills up), robustly pruned; (own, DEGREE), filled up with -1.

    The nearest is kept and takes with it those that are much nearer to it than to
    the own row; then the nearest of the rest, and so on.
    """
    fine = (near >= 0) & (near != own[:, None])
    near = np.where(fine, near, 0)
    close = np.where(fine, np.einsum("qd,qmd->qm", x[own], x[near]), -4)
    order = np.argsort(-close, axis=1, kind="stable")[:, :CANDIDATES]
    near, close = np.take_along_axis(near, order, 1), np.take_along_axis(close, order, 1)
    alive, far = close > -3, 1 - close
    alive[:, 1:] &= ~((near[:, 1:] == near[:, :-1]) & alive[:, :-1])  # equal candidates are equally near
    between = 1 - x[near] @ x[near].swapaxes(1, 2)
    out, row = np.full((len(own), DEGREE), -1), np.arange(len(own))
    for k in range(DEGREE):
        left = alive.any(1)
        if not left.any():
            break
        pick = alive.argmax(1)
        out[left, k] = near[row, pick][left]
        alive &= ~(ALPHA * between[row, pick] <= far) | ~left[:, None]
        alive[row, pick] = False
    return out


def _walk(x: np.ndarray, graph: np.ndarray, own: np.ndarray, entry: int, width: int) -> np.ndarray:
    """The beam (own, width) of a greedy search of the graph for each own row, from the entry; -1 fills up."""
    q, row = len(own), np.arange(len(own))[:, None]
    seen = np.zeros((q, len(x) + 1), bool)  # the last place stands for none
    ids, score = np.full((q, width), -1), np.full((q, width), -4, np.float32)
    ids[:, 0], score[:, 0] = entry, x[own] @ x[entry]
    seen[:, entry] = True
    open_ = score > -3
    for _ in range(2 * HOPS):
        going = np.flatnonzero(open_.any(1))
        if not len(going):
            break
        pick = open_[going].argmax(1)  # the beam is sorted
        open_[going, pick] = False
        near = graph[ids[going, pick]]
        fresh = (near >= 0) & ~seen[going[:, None], near]
        seen[going[:, None], np.where(fresh, near, len(x))] = True
        s = np.where(fresh, np.einsum("qd,qmd->qm", x[own[going]], x[near]), -4).astype(np.float32)
        both_ids, both = np.concatenate([ids[going], near], 1), np.concatenate([score[going], s], 1)
        both_open = np.concatenate([open_[going], fresh], 1)
        best = np.argsort(-both, axis=1, kind="stable")[:, :width]
        r = row[: len(going)]
        ids[going], score[going] = np.where(both[r, best] > -3, both_ids[r, best], -1), both[r, best]
        open_[going] = both_open[r, best] & (both[r, best] > -3)
    return ids


def _offer(x: np.ndarray, graph: np.ndarray, own: np.ndarray) -> None:
    """Offers the own rows to the neighbours that they have kept."""
    to, by = graph[own].reshape(-1), np.repeat(own, DEGREE)
    to, by = to[to >= 0], by[to >= 0]
    order = np.lexsort((-np.einsum("id,id->i", x[to], x[by]), to))
    to, by = to[order], by[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    to, by, place = (c[place < CANDIDATES] for c in (to, by, place))  # pruning looks at no more than the nearest
    nodes, at = np.unique(to, return_inverse=True)
    for k in range(0, len(nodes), ABREAST):
        part = slice(*np.searchsorted(at, [k, k + ABREAST]))
        offered = np.full((len(nodes[k : k + ABREAST]), CANDIDATES), -1)
        offered[at[part] - k, place[part]] = by[part]
        some = nodes[k : k + ABREAST]
        graph[some] = _pruned(x, some, np.concatenate([graph[some], offered], axis=1))


def built(x: np.ndarray) -> np.ndarray:
    """The graph of unit vectors: the neighbours of each row, (n, DEGREE), filled up with -1."""
    x, n = np.asarray(x, np.float32), len(x)
    graph, order = np.full((n, DEGREE), -1), np.random.default_rng(n).permutation(n)
    entry = int((x @ x.mean(0)).argmax())
    order = np.concatenate([[entry], order[order != entry]])
    at = min(n, 2)
    graph[order[:at], 0] = order[:at][::-1] if at == 2 else -1
    for first in (at, 0):  # all are put in, then looked at once more
        while first < n:
            own = order[first : first + (min(first, ABREAST) or ABREAST)]
            found = _walk(x, graph, own, entry, CANDIDATES)
            graph[own] = _pruned(x, own, np.concatenate([graph[own], found], axis=1))
            _offer(x, graph, own)
            first += len(own)
    return graph


def _neighbours(start: np.ndarray, flat: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (row, neighbour) of the given (row, node)."""
    n = start[nodes + 1] - start[nodes]
    at = np.repeat(start[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(rows, n), flat[at]


def search(x: np.ndarray, start: np.ndarray, flat: np.ndarray, own: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of unit vectors each of the own rows finds in range: (own, all), by range-expanding greedy search."""
    q, n = len(own), len(x)
    seen, hit = np.zeros((q, n), bool), np.zeros((q, n), bool)
    ids, score = np.zeros((q, BEAM), np.int64), np.full((q, BEAM), -2.0)
    open_ = np.zeros((q, BEAM), bool)

    def visit(rows: np.ndarray, nodes: np.ndarray):
        code = np.unique(rows * n + nodes)
        rows, nodes = np.divmod(code[~seen.reshape(-1)[code]], n)
        seen[rows, nodes] = True
        s = np.einsum("ij,ij->i", x[own[rows]], x[nodes])
        hit[rows, nodes] = s >= cosine
        return rows, nodes, s

    def into_beam(rows, nodes, s):
        order = np.lexsort((-s, rows))
        rows, nodes, s = rows[order], nodes[order], s[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        take = place < BEAM
        new_ids, new_score = np.zeros((q, BEAM), np.int64), np.full((q, BEAM), -2.0)
        new_ids[rows[take], place[take]], new_score[rows[take], place[take]] = nodes[take], s[take]
        both, i, o = np.concatenate([score, new_score], 1), np.concatenate([ids, new_ids], 1), np.concatenate([open_, new_score > -2], 1)
        best = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
        return (np.take_along_axis(a, best, 1) for a in (i, both, o))

    medoid = int((x @ x.mean(0)).argmax())
    everyone = np.arange(q)
    rows, nodes = _neighbours(start, flat, everyone, own)
    ids, score, open_ = into_beam(*visit(np.concatenate([everyone, everyone, rows]), np.concatenate([np.full(q, medoid), own, nodes])))
    for _ in range(HOPS):
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            break
        pick = open_[rows].argmax(1)  # the beam is sorted
        open_[rows, pick] = False
        ids, score, open_ = into_beam(*visit(*_neighbours(start, flat, rows, ids[rows, pick])))
    todo = np.nonzero(hit)
    while len(todo[0]):
        rows, nodes, s = visit(*_neighbours(start, flat, *todo))
        todo = rows[s >= cosine], nodes[s >= cosine]
    return hit


def _both_ways(near: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of neighbours, made mutual, as starts and one flat list."""
    n = len(near)
    a = np.repeat(np.arange(n), [len(v) for v in near])
    b = np.concatenate(near) if n else a
    code = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.searchsorted(code // n, np.arange(n + 1)), code % n


def _roots(hit: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over a symmetric matrix."""
    label = np.arange(len(hit))
    while True:
        new = label.copy()
        for at in range(0, len(hit), ABREAST):
            part = hit[at : at + ABREAST]
            new[at : at + ABREAST] = np.minimum(label[at : at + ABREAST], np.where(part, label, len(hit)).min(1, initial=len(hit)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _dealt(members: DataFrame) -> DataFrame:
    """Members with the pair of chunks (i, j) that they meet in, and their own chunk."""
    crowded = cut(members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK))
    if crowded.isEmpty():
        return members.withColumns({"own": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    chunks = F.coalesce(F.ceil(F.col("n") * 2 / CHUNK), F.lit(1)).cast("int")
    return (
        members.join(crowded, "shard", "left")
        .withColumn("chunks", chunks)
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("n", "chunks", "other")
    )


def adjacency(members: DataFrame) -> DataFrame:
    """(id, near): the united neighbours of each class from the graphs of all its shards and chunks."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        graph = built(_unit(np.stack(table.column("vec").to_pandas().to_numpy())))
        return pa.table({"id": pa.array(ids), "near": pa.array([ids[v[v >= 0]] for v in graph], pa.list_(pa.int64()))})

    lists = members.select("shard", "i", "j", "id", "vec").groupBy("shard", "i", "j").applyInArrow(build, "id long, near array<long>")
    return lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _found(members: DataFrame, cosine: float) -> DataFrame:
    """(id, links, root) from each group: links to count for id here, and a member it is linked with over others."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, copies, own = (table.column(c).to_numpy() for c in ("id", "copies", "own"))
        shard = table.column("shard")[0].as_py()
        lists = table.column("shards").to_pandas()
        shards = np.full((len(ids), lists.map(len).max()), np.iinfo(np.int64).min)
        for row, own_shards in enumerate(lists):
            shards[row, : len(own_shards)] = own_shards
        x = _unit(np.stack(table.column("vec").to_pandas().to_numpy()))
        lists = []
        for v in table.column("near").to_pandas():
            v = np.asarray(v, np.int64)
            at = np.minimum(np.searchsorted(ids, v), len(ids) - 1)
            lists.append(at[ids[at] == v])
        graph = _both_ways(lists)
        hit = np.concatenate([search(x, *graph, np.arange(at, min(len(x), at + ABREAST)), cosine) for at in range(0, len(x), ABREAST)])
        hit |= hit.T
        np.fill_diagonal(hit, False)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            hit &= own[:, None] != own[None, :]  # pairs within a chunk meet in the chunk's own group
        links = np.zeros(len(ids), np.int64)
        for at in range(0, len(ids), ABREAST):
            a, b = np.nonzero(hit[at : at + ABREAST])
            mine = shards[at + a][:, :, None]
            common = np.where((mine == shards[b][:, None, :]) & (mine > np.iinfo(np.int64).min), mine, np.iinfo(np.int64).max)
            here = common.min((1, 2)) == shard
            np.add.at(links, at + a[here], copies[b[here]])
        some = hit.any(1)
        return pa.table({"id": ids[some], "links": links[some], "root": ids[_roots(hit)][some]})

    return members.groupBy("shard", "i", "j").applyInArrow(run, "id long, links long, root long")


def audit(classes: DataFrame, cosine: float = COSINE, every: int = 50, block: int = 4096) -> DataFrame:
    """(id, audit_links) by brute force for the classes that are asked, against all, in blocks; about one in every is asked."""
    n = classes.count()
    parts, sets = max(1, -(-n // block)), max(1, -(-n // (every * block // 4)))
    slim = classes.select("id", "copies", "embedding").withColumn("h", F.xxhash64("id"))
    data = slim.withColumn("p", F.pmod("h", F.lit(parts))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))).drop("h")
    asked = classes.where("asked").select("id", "embedding", F.xxhash64("id").alias("h")).withColumn("s", F.pmod(F.shiftright("h", 20), F.lit(sets)).cast("int"))
    asked = asked.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))).drop("h")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, q in left.groupby(left["embedding"].map(len)):
            d = right[right["embedding"].map(len) == size]
            links = np.zeros(len(q), np.int64)
            if len(d):
                a, b = (_unit(np.stack(f["embedding"].to_numpy()).astype(np.float64)) for f in (q, d))
                near = (a @ b.T >= cosine) & (q["id"].to_numpy()[:, None] != d["id"].to_numpy()[None, :])
                links = near @ d["copies"].to_numpy()
            out.append(pd.DataFrame({"id": q["id"].to_numpy(), "links": links}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "links": []}).astype("int64")

    met = asked.groupBy("p", "s").cogroup(data.groupBy("p", "s")).applyInPandas(run, "id long, links long")
    return met.groupBy("id").agg(F.sum("links").alias("audit_links"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, audit_every: int | None = 50) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_links): one row for each row of vectors.

    vectors needs vec_id and embedding. n_links counts the other vectors at a
    cosine of at least the threshold, component_id is the smallest vec_id
    reachable, kept says whether that is the vector itself. audit_links is the
    count by brute force where vec_id is divisible by audit_every, else null:
    recall is the sum of n_links over that of audit_links where it isn't null. The
    audit takes that part of all pairs' work; without audit_every there is none.
    Vectors that are null, zero, or have null or non-finite parts link with
    nothing, nor do vectors of different lengths; a null vec_id has no links and a
    null component. Rows that repeat vec_id and embedding count as one vector.
    Other columns are not kept. An empty table gives an empty result.
    """
    able = cut(usable(vectors))
    asks = F.lit(False) if audit_every is None else F.col("vec_id") % audit_every == 0
    classes = cut(able.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.bool_or(asks).alias("asked")))
    n = classes.count()
    members = _dealt(sharded(classes, n))
    found = cut(_found(members.join(adjacency(members), "id"), cosine))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    audited = classes.select("id", F.lit(None).cast("long").alias("audit_links")).limit(0) if audit_every is None else audit(classes, cosine, audit_every)
    checked = cut(
        classes.join(counts, "id", "left")
        .join(member.withColumnRenamed("node", "id"), "id", "left")
        .join(audited, "id", "left")
        .select("embedding", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"), (F.col("audit_links") + F.col("copies") - 1).alias("audited"))
    )
    linked = able.alias("a").join(checked.alias("c"), F.col("a.embedding") == F.col("c.embedding")).select("a.vec_id", "a.embedding", "links", "component", "audited")
    return (
        vectors.select("vec_id", "embedding").alias("v")
        .join(linked.alias("l"), (F.col("v.vec_id") == F.col("l.vec_id")) & F.col("v.embedding").eqNullSafe(F.col("l.embedding")), "left")
        .select(
            "v.vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "v.vec_id").alias("component_id"),
            (F.coalesce("component", "v.vec_id").eqNullSafe(F.col("v.vec_id")) & F.col("v.vec_id").isNotNull()).alias("kept"),
            (F.when(F.col("v.vec_id") % audit_every == 0, F.coalesce("audited", F.when(F.col("links").isNull(), F.lit(0)))) if audit_every else F.lit(None)).cast("long").alias("audit_links"),
        )
    )
