import hashlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import isqrt

import duckdb
import pytest
from pyspark.sql import functions as F

from shoploom.llm import mixing, queries, sql


def default_weights(sizes):
    roots = {s: max(1, isqrt(n)) for s, n in sizes.items()}
    total = sum(roots.values())
    return {s: max(1, (2 * mixing.SHARES * r + total) // (2 * total)) for s, r in roots.items()}


def brute(rows, weights=None, block=mixing.BLOCK_ROWS):
    """Source, block and slot of each row, by simulating the schedule slot by slot with the weights as fractions."""
    own = defaultdict(list)
    for i, s in rows:
        own[s or ""].append((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i))
    sizes = {s: len(v) for s, v in own.items()}
    w = default_weights(sizes) if weights is None else {s: Fraction(str(weights.get(s) or min(x for k, x in weights.items() if x and k in own))) for s in own}
    share = {s: Fraction(w[s]) / sum(w.values()) for s in own}
    left = {s: -(-len(v) // block) for s, v in own.items()}
    slots, done, t = {}, Counter(), 0
    while any(done[s] < left[s] for s in own):
        due = [(-(-(done[s] + 1) // share[s]), s) for s in own if done[s] // share[s] <= t]
        s = min(due)[1]
        slots[s, done[s]] = t
        done[s] += 1
        t += 1
    return {i: (s, r // block, slots[s, r // block]) for s, v in own.items() for r, (_, i) in enumerate(sorted(v))}, share


def data():
    return [(i, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None) for i in range(1200)]


@pytest.mark.parametrize("weights", [None, {"hot": 5, "s1": 3, "s2": 0}])
@pytest.mark.parametrize("bucket", [4096, 16])
def test_against_simulation(spark, monkeypatch, weights, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "STRETCH_BITS", 10 if bucket == 4096 else 2)
    df = spark.createDataFrame([(*r, "x") for r in data()], "doc_id long, source string, slot string")
    given = weights and spark.createDataFrame(list(weights.items()), "source string, weight int")
    mixed = mixing.mix(df, given, block_rows=4)
    got = mixed.collect()
    want, _ = brute(data(), weights, 4)
    assert {r.doc_id: (r.source or "", r.block, r.slot) for r in got} == want
    assert len({r.position for r in got}) == len(got) == 1200
    assert all(r.position // 4 == r.slot for r in got)
    parts, n = mixing.parted(mixed, 100, block_rows=4)
    rows = sorted((r.position, r.part) for r in parts.collect())
    assert n == 12 and [p for _, p in rows] == sorted(p for _, p in rows)
    assert max(Counter(p for _, p in rows).values()) <= 100 + 8 * 4 * 2


@pytest.mark.parametrize("weights", [{"a": 10_000, "b": 1}, {"a": 7, "b": 3, "c": 1}, {"a": 1000, "b": 999, "c": 499, "d": 1}])
def test_deviation_from_the_weights_is_below_one_block(spark, weights):
    """Every source that isn't used up is within one block of w / total after every slot."""
    sources = spark.createDataFrame([(s, 1, w) for s, w in weights.items()], "src string, n long, w long")
    plan = mixing.schedule(sources).orderBy("slot").collect()
    total, seen = sum(weights.values()), Counter()
    assert [r.slot for r in plan] == list(range(total)) and {r.period for r in plan} == {total}
    for t, r in enumerate(plan, 1):
        assert r.turn == seen[r.src]
        seen[r.src] += 1
        assert all(abs(seen[s] - Fraction(w * t, total)) < 1 for s, w in weights.items())
    assert seen == weights


def test_deviation_over_many_periods(spark):
    weights = {"a": 100, "b": 1, "c": 22}
    rows = [(i, "abc"[(i % 123 >= 100) + (i % 123 >= 101)]) for i in range(123 * 40)]
    given = spark.createDataFrame(list(weights.items()), "source string, weight int")
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), given, block_rows=1).orderBy("slot").collect()
    seen = Counter()
    for t, r in enumerate(got, 1):
        assert r.slot == t - 1
        seen[r.source] += 1
        assert all(abs(seen[s] - Fraction(w * t, 123)) < 1 for s, w in weights.items())


def test_query_against_sql(spark, tmp_path):
    spark.createDataFrame(data(), "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(sql.ORACLES["op7_mix_sources"])
    got = queries.op7_mix_sources(spark, str(tmp_path)).select(want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_odd_rows(spark, monkeypatch):
    rows = [(None, "a"), (None, "a"), (1, "a"), (1, "a"), (2, None), (3, "")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string")).collect()
    assert len(got) == 6 and len({r.position for r in got}) == 6
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0
    # many rows of one or no id, equal or not
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "COPIES", 10)
    rows = [(7, "a", f"x{i}") for i in range(60)] + [(None, "a", f"y{i % 3}") for i in range(90)] + [(i, "a", "z") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_rows=4).collect()
    assert sorted(r.position for r in got) == list(range(200))
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, _, t in rows)
    own = sorted(r.position for r in got if r.doc_id == 7 and r.text != "z")
    assert own[-1] - own[0] <= 60  # rows of one id stay together


@pytest.mark.parametrize("kind", ["double", "decimal(9,4)", "string", "float"])
def test_fractions(spark, kind):
    rows = [(i, "abc"[i % 3]) for i in range(3000)]
    weights = {"a": 0.7, "b": 0.2, "c": 0.1}
    given = spark.createDataFrame(list(weights.items()), "source string, weight double").withColumn("weight", F.col("weight").cast(kind))
    df = spark.createDataFrame(rows, "doc_id long, source string")
    assert {r.src: r.w for r in mixing.weighted(df, given).collect()} == {"a": 7, "b": 2, "c": 1}
    got = mixing.mix(df, given, block_rows=10).collect()
    assert {r.doc_id: (r.source, r.block, r.slot) for r in got} == brute(rows, weights, 10)[0]
    first = Counter()
    for slot, source in sorted({(r.slot, r.source) for r in got})[:100]:
        first[source] += 1
        assert all(abs(first[s] - w * (slot + 1)) < 1 + 1e-9 for s, w in weights.items())


def test_weights_of_zero_and_none(spark):
    df = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(40)], "doc_id long, source string")
    given = spark.createDataFrame([("a", 2.5), ("b", 0.5), ("c", 0.0), ("e", 0.1)], "source string, weight double")
    assert {r.src: r.w for r in mixing.weighted(df, given).collect()} == {"a": 5, "b": 1, "c": 1, "d": 1}
    assert {r.src: r.w for r in mixing.weighted(df, given, "leave out").collect()} == {"a": 5, "b": 1, "d": 1}
    assert {r.source for r in mixing.mix(df, given, 4, "leave out").collect()} == {"a", "b", "d"} and mixing.mix(df, given, 4).count() == 40
    third = spark.createDataFrame([("a", 1 / 3), ("b", 2 / 3)], "source string, weight double")
    assert {r.src: r.w for r in mixing.weighted(df.where("source in ('a', 'b')"), third).collect()} == {"a": 1, "b": 2}
    for bad in ("x", "-1", "NaN", "1e15"):
        with pytest.raises(Exception, match="not a weight"):
            mixing.weighted(df, spark.createDataFrame([("a", bad)], "source string, weight string")).collect()
    with pytest.raises(Exception, match="round the weights"):
        mixing.mix(df, spark.createDataFrame([("a", 0.123456789), ("b", 0.5)], "source string, weight double")).collect()


def test_many_sources(spark):
    n = 3000
    df = spark.createDataFrame([(i, f"s{i % n}") for i in range(2 * n)], "doc_id long, source string")
    given = spark.createDataFrame([(f"s{i}", 1) for i in range(n)], "source string, weight int")
    mixed = mixing.mix(df, given, block_rows=1).checkpoint()
    assert mixed.groupBy("slot").count().count() == 2 * n
    parts, files = mixing.parted(mixed, 500, block_rows=1)
    assert files == 12 and sorted(r["count"] for r in parts.groupBy("part").count().collect()) == [500] * 12
