from pyspark.sql import functions as F

from shoploom.operators import relational as r


def test_nested_children_and_top5(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    visits = spark.createDataFrame([(1, f"2026-01-0{d}", d) for d in range(1, 8)], "contract int, day string, id_v int")
    order = [F.col("day").desc(), F.col("id_v").desc()]
    nested = r.nest_children(parents, r.top_per_key(visits, ["contract"], order, 5), "id", "contract", ["day", "id_v"], "visits", descending=True)
    got = {row.id: [v.id_v for v in row.visits] for row in nested.collect()}
    assert got == {1: [7, 6, 5, 4, 3], 2: []}


def test_several_lists_do_not_multiply(spark):
    parents = spark.createDataFrame([(1,)], "id int")
    child = lambda n: spark.createDataFrame([(1, i) for i in range(n)], "p int, c int")
    df = parents
    for name, n in (("visits", 2), ("issues", 3), ("timeline", 2)):
        df = r.nest_children(df, child(n), "id", "p", ["c"], name)
    row = df.first()
    assert (len(row.visits), len(row.issues), len(row.timeline)) == (2, 3, 2)


def test_pages_cover_the_whole_in_order(spark):
    df = spark.range(101)
    order = [F.col("id").desc()]
    assert tuple(r.page_totals(df).first()) == (101, 3)
    pages = [[x.id for x in r.page(df, order, n).collect()] for n in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [50, 50, 1, 0]
    assert sum(pages, []) == list(range(100, -1, -1))


def test_keep_first_leaves_null_keys(spark):
    rows = [(5, "a"), (3, "a"), (9, None), (8, None), (1, "b")]
    df = spark.createDataFrame(rows, "id int, conversation string")
    assert sorted(x.id for x in r.keep_first(df, ["conversation"], "id").collect()) == [1, 3, 8, 9]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id int, name string, n int")
    new = spark.createDataFrame([(2, "new", 1), (2, "newer", 2), (3, "c", 3)], "id int, name string, n int")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    assert rows(r.upsert(old, new, ["id"], [F.col("n").desc()]).select("id", "name")) == [(1, "a"), (2, "newer"), (3, "c")]
    assert rows(r.insert_ignore(old, new.where("n > 1"), ["id"]).select("id", "name")) == [(1, "a"), (2, "b"), (3, "c")]
    patch = spark.createDataFrame([(1, None, 7), (2, "B", None)], "id int, name string, n int")
    assert rows(r.patch_merge(old, patch, "id")) == [(1, "a", 7), (2, "B", 5)]
    assert rows(r.child_replace(old, spark.createDataFrame([(1, "z", 0)], old.schema), "id")) == [(1, "z", 0), (2, "b", 5)]
    assert [x.id for x in r.delete_keys(old, new, "id").collect()] == [1]
    updated = r.update_latest(spark.createDataFrame([(1, "k", "x"), (2, "k", "x"), (3, "k", "y")], "id int, k string, s string"), ["k"], [F.col("id").desc()], F.col("s") == "x", s=F.lit("done"))
    assert rows(updated) == [(1, "k", "x"), (2, "k", "done"), (3, "k", "y")]


def test_calendar_and_open_intervals(spark):
    df = spark.createDataFrame([(1, "2026-07-01", None), (2, "2026-06-01", "2026-07-03"), (3, "2026-08-01", None)], "id int, a string, b string").select("id", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    covered = r.covered_days(df, F.col("a"), F.col("b"), "2026-07-01", "2026-07-05").groupBy("day").agg(F.count("*").alias("n"))
    got = [(str(x.day), x.n) for x in r.on_spine(r.days(spark, "2026-06-30", "2026-07-05"), covered, "n").orderBy("day").collect()]
    assert got == [("2026-06-30", 0), ("2026-07-01", 2), ("2026-07-02", 2), ("2026-07-03", 2), ("2026-07-04", 1), ("2026-07-05", 1)]


def test_fallback_chain(spark):
    stores = spark.createDataFrame([(1, "main", True, True), (2, "east", True, False), (3, "shut", False, False)], "sid int, store string, active boolean, main boolean")
    tickets = spark.createDataFrame([(10, 2), (11, 3), (12, None)], "t int, wanted int")
    got = r.with_fallback(tickets, stores, "wanted", "sid", F.col("active"), F.col("main"), ["store"])
    assert {x.t: x.store for x in got.collect()} == {10: "east", 11: "main", 12: "main"}
    none = r.with_fallback(tickets, stores, "wanted", "sid", F.lit(False), F.col("main"), ["store"])
    assert {x.store for x in none.collect()} == {None}


def test_keep_first_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, k string")
    assert sorted(x.id for x in r.keep_first(df, ["k"], "id").collect()) == [1, 3, 4, 5]


def test_marks_and_flips(spark):
    df = spark.createDataFrame([(1, None), (2, False), (3, True), (3, True)], "id int, is_active boolean")
    gone = spark.createDataFrame([(3,), (3,), (9,)], "id int")
    assert sorted((x.id, x.is_active) for x in r.soft_delete(df, gone, "id").collect()) == [(1, True), (2, False), (3, False), (3, False)]
    changed, n = r.flip(df, F.col("is_active"), id=F.lit(0))
    assert sorted(x.id for x in changed.collect()) == [0, 0, 1, 2] and df.agg(n).first()[0] == 2


def test_first_by_affix_tries_forms_in_order(spark):
    table = spark.createDataFrame([(7, "+91555"), (5, "91555x"), (2, "12%"), (1, None), (3, "")], "v int, t string")
    asked = spark.createDataFrame([(1, ["x9", "555"]), (2, ["91555", "555"]), (3, ["%"]), (4, []), (5, None), (6, ["5"])], "id int, f array<string>")
    got = {x.id: x.found for x in r.first_by_affix(asked, F.col("f"), table, "t", "v", "found").collect()}
    assert got == {1: 7, 2: 5, 3: 2, 4: None, 5: None, 6: 7}


def test_first_by_affix_deals_out_its_pieces(spark):
    table = spark.createDataFrame([(i, f"98{i:04d}") for i in range(300)], "v int, t string")
    asked = spark.createDataFrame([(i, [f"x{i}", f"{i:04d}"] if i % 3 else []) for i in range(400)], "id int, f array<string>")
    found = r.first_by_affix(asked, F.col("f"), table, "t", "v", "found", task_rows=80)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "__form" in line]
    assert "hashpartitioning(t#" in plan and "REPARTITION_BY_NUM" in plan
    assert {x.id: x.found for x in found.collect()} == {i: i if i % 3 and i < 300 else None for i in range(400)}


def test_payments_and_unpivot(spark):
    invoices = spark.createDataFrame([(1, 100, 10), (2, 50, None), (3, 5, 5)], "k int, total_amount int, amount_paid int")
    payments = spark.createDataFrame([(1, 20), (1, None), (2, 60), (9, 1)], "k int, amount int")
    rows = {x.k: (x.amount_paid, x.balance_due, x.n_payments) for x in r.apply_payments(invoices, payments, "k").collect()}
    assert rows == {1: (30, 70, 2), 2: (60, -10, 1), 3: (5, 0, 0)}
    wide = spark.createDataFrame([("x", 1, 2)], "who string, a int, b int")
    assert sorted(map(tuple, r.unpivoted(wide, "label", "n", a="A a", b="B").collect())) == [("x", "A a", 1), ("x", "B", 2)]


def test_running_number_over_buckets(spark):
    rows = [(k, b, i) for i, (k, b) in enumerate([("x", 2), ("x", 1), (None, 1), ("x", 1), ("x", None), ("y", 5), (None, None)])]
    df = spark.createDataFrame(rows, "k string, b int, i int")
    got = {x.i: x.number for x in r.running_number(df, "k", "b", [F.col("i")]).collect()}
    assert got == {4: 1, 1: 2, 3: 3, 0: 4, 5: 1, 6: 1, 2: 2}
