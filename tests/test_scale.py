"""The operators that bound a task's work, against plain versions, with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from shoploom.operators import scale as s


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    return [(i, r.choice([None, 5, 5, 5, 5, 9, 1]) if i % 2 else r.randrange(-50, 50), r.choice([None, *map(float, range(40))])) for i in range(3000)]


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("nulls", [None, True, False])
def test_deep_pages(spark, rows, down, nulls):
    df = spark.createDataFrame(rows, "id int, a int, b double")
    keys = [s.By("a", down, nulls), s.By("b", not down), s.By("id")]
    want = [r.id for r in df.orderBy(*[k.order() for k in keys]).collect()]
    for number, limit in ((1, 7), (20, 50), (150, 20), (151, 20), (3, 700), (61, 50), (200, 50)):
        page = s.deep_page(df, keys, number, limit, task_rows=60, bounds=8)
        assert [r.id for r in page.collect()] == want[(number - 1) * limit : number * limit], (number, limit)


def test_a_deep_page_sorts_its_segment_only(spark):
    df = spark.range(200_000).select(F.col("id"), (F.col("id") % 1000).alias("a"))
    page = s.deep_page(df, [s.By("a"), s.By("id")], 3000, 50, task_rows=2000)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and [r.a for r in page.collect()] == [749] * 50
    assert s.deep_page(df.limit(0), [s.By("a")], 1).count() == 0


def test_children_of_a_hot_parent(spark, rows):
    data = [(1 if i % 2 else i % 7, a, i) for i, a, _ in rows] + [(None, 3, -1), (None, None, -2)]
    df = spark.createDataFrame(data, "parent int, at int, id int").repartition(5)
    parts = s.nest_in_parts(df, "parent", "at", ["at", "id"], "children", per_row=100, bounds=10).collect()
    assert all(len(p.children) <= 100 for p in parts)
    got = {}
    for p in sorted(parts, key=lambda p: p.part):
        got.setdefault(p.parent, []).extend((c.at, c.id) for c in p.children)
    want = {}
    for parent, at, i in sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        want.setdefault(parent, []).append((at, i))
    assert got == want


@pytest.mark.parametrize("task_rows", [0, 200, 10**6])
def test_value_before_with_a_hot_key(spark, task_rows):
    r = random.Random(1)
    data = [(1 if r.random() < 0.5 else r.choice([None, 2, 3, 4]), r.randrange(0, 900), i, r.choice([None, "a", "b", "c"])) for i in range(2000)]
    df = spark.createDataFrame(data, "k int, at int, id int, v string").repartition(4)
    got = {x.id: x.old for x in s.changed_rows(df, "k", "v", ["at", "id"], F.floor(F.col("at") / 100), task_rows=task_rows).collect()}
    want, before = {}, {}
    for k, at, i, v in sorted(data, key=lambda x: (x[1], x[2])):
        if before.get(k) != v:
            want[i] = before.get(k)
        before[k] = v
    assert got == want


def test_latest_that_contains(spark):
    r = random.Random(2)
    texts = [("cust_91" + "".join(r.choice("0123456789") for _ in range(10)), i) for i in range(400)] + [("x%y_z", 900), ("ab", 901), ("", 902), (None, 999), ("cust_911111111111", 5), ("cust_911111111111", 950)]
    patterns = [t[k : k + n] for t, _ in texts[:40] for k, n in ((5, 12), (7, 10), (9, 4), (8, 2), (11, 1))] + ["1111", "%", "_", "y_", "zzz", "", None, "cust_91", "abc"]
    asked = spark.createDataFrame(list(enumerate(patterns)), "id int, digits string")
    table = spark.createDataFrame(texts, "conversation string, at int")
    found = s.latest_containing(asked, "digits", table, "conversation", F.col("at"), F.col("at"), "hit")
    want = {i: max((at for t, at in texts if t is not None and p is not None and p in t), default=None) for i, p in enumerate(patterns)}
    assert {r.id: r.hit for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_standing_counts(spark):
    import datetime as dt

    r = random.Random(3)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    data = [(i, None if i % 19 == 0 else day(a := r.randrange(-40, 60)), None if i % 11 == 0 else day(r.randrange(-60, 80) if i % 5 else a + 1)) for i in range(1, 500)]
    df = spark.createDataFrame(data, "id int, a date, b date")
    calendar = spark.range(31).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    got = {x.day: x.standing for x in s.standing_counts(df, F.col("a"), F.col("b"), calendar, "2024-01-01", "2024-01-31").collect()}
    assert got == {day(n): sum(a is not None and a <= day(n) and (b is None or b >= day(n)) for _, a, b in data) for n in range(31)}
    events = s.change_events(df, F.col("a"), F.col("b"), "2024-01-01", "2024-01-31").groupBy("id").count()
    assert events.where("count > 2").count() == 0


def test_numbers_are_given_once(spark):
    stored = spark.createDataFrame([(1, "ORD-2026-JUL-0009"), (2, "ORD-2026-JUL-0004"), (3, "ORD-2026-AUG-12345"), (4, "odd"), (5, None), (6, "ORD-x-")], "id int, number string")
    marks = s.high_marks(stored, "number")
    assert {r.prefix: r.high for r in marks.collect()} == {"ORD-2026-JUL-": 9, "ORD-2026-AUG-": 12345}
    batch = lambda a, b: spark.createDataFrame([(i, ["ORD-2026-JUL-", "ORD-2026-SEP-"][i % 2], -i) for i in range(a, b)], "id int, prefix string, at int")
    first, after = s.give_numbers(batch(0, 11), "prefix", "at", [F.col("id")], marks)
    after = after.checkpoint()  # what stands in the table of marks, whatever happens to the rows
    second, last = s.give_numbers(batch(11, 30), "prefix", "at", [F.col("id")], after)
    given = [(r.prefix, r.number) for r in first.collect() + second.collect()]
    assert len(set(given)) == len(given) == 30
    assert sorted(n for p, n in given if "JUL" in p) == list(range(10, 25)) and sorted(n for p, n in given if "SEP" in p) == list(range(1, 16))
    assert {r.prefix: r.high for r in last.collect()} == {"ORD-2026-JUL-": 24, "ORD-2026-AUG-": 12345, "ORD-2026-SEP-": 15}
    assert [r.id for r in first.where("prefix like '%JUL%'").orderBy("number").collect()] == [10, 8, 6, 4, 2, 0]


def test_differences_are_named(spark, tmp_path):
    data = [(i, f"n{i}", float(i % 7) if i % 5 else None) for i in range(5000)]
    spark.createDataFrame(data, "id int, name string, x double").repartition(6).write.parquet(f"{tmp_path}/a")
    changed = [(i, "other" if i == 1234 else n, 9.0 if i == 4000 else x) for i, n, x in data if i != 77] + [(6000, "new", None), (None, "no key", 1.0)]
    spark.createDataFrame(changed, "id int, name string, x double").write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    got = sorted((tuple(r) for r in s.differences(a, b, "id", leaf_rows=50, bounds=8).collect()), key=str)
    want = [(1234, "name", "n1234", "other"), (4000, "x", None, "9.0"), (77, None, "row", None), (6000, None, None, "row"), (None, None, None, "row")]
    assert got == sorted(want, key=str)
    assert s.differences(a, a, "id", leaf_rows=50).count() == 0
    plan = s.differences(a, b, "id", leaf_rows=50, bounds=8)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan" in plan  # the last comparison reads ranges
    assert s.differences(a.limit(0), b.limit(0), "id").count() == 0


def test_a_parent_of_half_a_million(spark):
    """Every list is whole, in order, and no longer than it may be."""
    n = 500_000
    df = spark.range(n).select(F.lit(7).alias("parent"), ((F.col("id") * 7919) % n).alias("at"), F.col("id").alias("child"))
    parts = s.nest_in_parts(df, "parent", "at", ["at", "child"], "children", per_row=5000)
    checked = parts.select("part", F.size("children").alias("n"), F.expr("children[0].at").alias("first"), F.expr("forall(sequence(1, size(children) - 1), i -> children[i].at = children[i - 1].at + 1)").alias("sorted"))
    assert [tuple(r) for r in checked.orderBy("part").collect()] == [(k, 5000, 5000 * k, True) for k in range(n // 5000)]


@pytest.mark.parametrize("search", [None, "9"])
def test_rows_without_an_id_do_not_come_together_in_the_inbox(spark, search):
    """Messages of no customer, ticket or order, and one conversation of very many: every joined row has its place, none a crowded one."""
    from shoploom.plans.inbox import inbox

    rows = [(i, f"cust_{i % 400 if i % 2 else 1000}", None if i % 400 < 396 else i % 400, i if i % 50 == 0 else None, None, "Customer", "t", f"m{i}", i % 3 == 0, i // 7) for i in range(4000)]
    messages = spark.createDataFrame(rows, "id long, conversation_id string, customer_id long, ticket_id long, order_id long, sender string, type string, text string, is_read boolean, created_at long")
    tickets = spark.createDataFrame([(i, f"name {i}") for i in range(0, 4000, 25)], "id long, customer_name string")
    orders = spark.createDataFrame([(1, "ORD-1")], "id long, order_number string")
    customers = spark.createDataFrame([(i, f"own {i}") for i in range(400)], "id long, name string")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = inbox(messages, tickets, orders, customers, search=search, task_rows=500)
        got = {x.conversation_id: x for x in found.collect()}
        sizes = [x[0] for x in found.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
    names = {i: f"name {i}" for i in range(0, 4000, 25)}
    hit = lambda m: search is None or any(search in (x or "") for x in (m[1], names.get(m[3]), f"own {m[2]}" if m[2] is not None else None))
    want = {}
    for m in sorted(rows, key=lambda m: (m[9], m[0])):
        own = want.setdefault(m[1], [None, None, 0])
        own[0], own[1] = (m if hit(m) else own[0]), m
        own[2] += not m[8]
    want = {k: v for k, v in want.items() if v[0]}
    assert got.keys() == want.keys()
    for k, (found_at, last, unread) in want.items():
        x = got[k]
        assert (x.customer_id, x.ticket_id, x.last_message_at, x.last_text, x.unread_count) == (found_at[2], found_at[3], found_at[9], last[7], unread)
        assert (x.ticket_customer_name, x.saved_customer_name) == (names.get(found_at[3]), f"own {found_at[2]}" if found_at[2] is not None else None)
