import pytest
from pyspark.sql import functions as F

from shoploom.functions import exprs as x


def values(spark, column, *inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.out for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


PHONES = ["98765 43210", "+91-98765-43210", "00919876543210", "12345", "", None, "abc", "0000", "1-202-555-01234", "449876543210", "(022) 2345678901"]


def test_phones(spark):
    good = ["919876543210"] * 3 + [None] * 5
    assert values(spark, x.phone_strict, *PHONES) == [*good, None, None, None]
    assert values(spark, x.phone_lenient, *PHONES) == [*good, "910255501234", "919876543210", "912345678901"]
    assert values(spark, x.phone_plain, "(98765) 43210", "+1 23") == ["919876543210", "123"]


def test_numbers(spark):
    assert values(spark, x.padded, 9, 9999, 10000, kind="int") == ["0009", "9999", "10000"]
    assert values(spark, x.number_suffix, "ORD-2026-JUL-0009", "odd", None) == [9, None, None]
    assert values(spark, x.leading_number, "12abc", " -3.5x", "abc", None) == [12.0, -3.5, 0.0, 0.0]
    assert values(spark, lambda c: x.number_prefix("ORD", c.cast("date")), "2026-07-04") == ["ORD-2026-JUL-"]


@pytest.mark.parametrize("grand, advance, want", [(118, 118, "Paid"), (118, 50, "Partially Paid"), (118, 0, "Unpaid"), (118, 120, "Unpaid"), (0, 0, "Unpaid")])
def test_payment_status(spark, grand, advance, want):
    df = spark.sql(f"select cast({grand} as decimal(15,2)) g, cast({advance} as decimal(15,2)) a")
    assert df.select(x.payment_status(F.col("g"), F.col("a"))).first()[0] == want


def test_percent_and_bar(spark):
    df = spark.createDataFrame([(2, 3), (0, 0), (1, 8)], "a int, b int")
    assert [r[0] for r in df.select(x.percent(F.col("a"), F.col("b"))).collect()] == [67, 0, 13]
    assert values(spark, x.bar, 0, 50, 100, 300, kind="int") == ["░" * 20, "█" * 10 + "░" * 10, "█" * 20, "█" * 20]


def test_weekdays_and_kinds(spark):
    days = [f"2026-07-{d:02}" for d in range(6, 13)]
    assert "".join(values(spark, lambda c: x.weekday_letter(c.cast("date")), *days)) == "MTWTFSS"
    df = spark.createDataFrame([(1, "cust_9"), (None, "cust_9"), (None, "77")], "o int, c string")
    assert [r[0] for r in df.select(x.conversation_kind(F.col("o"), F.col("c"))).collect()] == ["order", "customer", "ticket"]


def test_texts(spark):
    assert values(spark, x.rupees, 0.0, 999.5, 1234.0, 12345678.9, -100000.0, kind="double") == ["₹0.00", "₹999.50", "₹1,234.00", "₹1,23,45,678.90", "-₹1,00,000.00"]
    got = values(spark, x.data_url, "data:image/png;base64,aGk=", "http://x")
    assert (got[0].mime, got[0].extension, bytes(got[0].data)) == ("image/png", "png", b"hi") and got[1] is None
    assert values(spark, lambda c: x.joined(", ", F.lit("a"), c, F.lit(None)), " ", "b", None) == ["a", "a, b", "a"]
    assert values(spark, lambda c: x.or_else(c, F.lit("z")), "", None, "q") == ["z", "z", "q"]
    assert values(spark, x.event_class, "Visit Created", "note modified", "Resolved", "deleted", "x") == ["create", "update", "complete", "cancel", "other"]
    assert [v and v.event for v in values(spark, x.status_event, "Completed", "Collected", "Pending", None)] == ["repair_completed", "collected", None, None]
    assert values(spark, x.rating_label, 0, 1, 5, 6, None, kind="int") == [None, "Poor", "Excellent", None, None]
    assert values(spark, lambda c: x.truthy_or(c, F.lit(9)), 0, None, 3, kind="int") == [9, 9, 3]
    assert values(spark, x.phone_candidates, "+91 9876543210", "9876543210", "44", "") == [["+91 9876543210", "919876543210"], ["9876543210", "919876543210"], ["44", "9144"], []]


def test_errors_in_field_order(spark):
    df = spark.createDataFrame([(None, "x"), ("a", "b")], "brand string, model string")
    found = x.errors(brand__is_required=F.col("brand").isNull(), model__too_short=F.length("model") < 2)
    assert [r[0] for r in df.select(found).collect()] == [["brand: is required", "model: too short"], ["model: too short"]]


def test_every_ignores_missing_conditions(spark):
    df = spark.range(5)
    assert df.where(x.every(None, F.col("id") > 2, None)).count() == 2
    assert df.where(x.every()).count() == 5


def test_validators(spark):
    ticket = lambda **given: x.ticket_errors(*[F.lit(given.get(n)).cast("string") for n in ("customer", "phone", "phone2", "device", "brand", "model", "category", "problem", "issue")])
    row = spark.range(1).select(
        ticket(customer="A", phone2="9", device="d", category="c", issue="i").alias("two"),
        ticket(customer=" \n\t", phone="9", device="d", brand="b", model="m", category="c", problem="p").alias("blank"),
        x.customer_errors(F.lit("A"), F.lit(None).cast("string")).alias("customer"),
        x.invoice_errors(F.lit("A"), F.array().cast("array<int>")).alias("empty"),
        x.invoice_errors(F.lit("A"), F.lit(None).cast("array<int>")).alias("none"),
        x.invoice_errors(F.lit("A"), F.array(F.lit(1))).alias("fine"),
        x.contract_errors(F.lit("A"), F.lit("+91 98-76 (54)"), F.lit("a@b.c"), F.to_date(F.lit("2024-01-02")), F.to_date(F.lit("2024-01-02")), F.lit("NaN"), F.lit("100"), F.lit("Gold"), F.lit(None).cast("string")).alias("contract"),
    ).first()
    assert [(e.field, e.message) for e in row.two] == [("brand", "Brand is required"), ("model", "Model is required")]
    assert [e.field for e in row.blank] == ["customerName"] and [e.message for e in row.customer] == ["Phone number is required"]
    assert [e.field for e in row.empty] == [e.field for e in row.none] == ["items"] and row.fine == []
    assert [e.field for e in row.contract] == ["endDate", "contractValue", "contractType"]
