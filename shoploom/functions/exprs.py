"""Scalar functions as Column expressions; none needs Python at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"


def or_else(a: Column, b: Column, empty=("",)) -> Column:
    """a unless it is null or one of the values that count as empty."""
    return F.when(a.isNull() | a.isin(list(empty)), b).otherwise(a)


def any_ilike(text: str, *columns: str) -> Column:
    """Whether any of the columns contains the text, whatever the case; % and _ stay wildcards."""
    return reduce(lambda a, b: a | b, [F.col(c).cast("string").ilike(f"%{text}%") for c in columns])


def every(*conditions: Column | None) -> Column:
    """The conjunction of those conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d]", "")


def phone_strict(c: Column) -> Column:
    """An Indian number as 91 and ten digits; null for anything else."""
    d = F.regexp_replace(digits(c), "^0+", "")
    return F.when(F.length(d) == 10, F.concat(F.lit("91"), d)).when((F.length(d) == 12) & d.startswith("91"), d)


def phone_lenient(c: Column) -> Column:
    """Like phone_strict, but of a longer number the last ten digits count."""
    d = F.regexp_replace(digits(c), "^0+", "")
    return F.coalesce(phone_strict(c), F.when(F.length(d) > 10, F.concat(F.lit("91"), F.right(d, F.lit(10)))))


def phone_plain(c: Column) -> Column:
    """A number without spaces, signs and parentheses, with 91 before ten digits."""
    d = F.regexp_replace(c, r"[\s\-+()]", "")
    return F.when(F.length(d) == 10, F.concat(F.lit("91"), d)).otherwise(d)


def padded(n: Column, width: int = 4) -> Column:
    """A number with leading zeros; longer numbers stay whole."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def number_prefix(kind: str, day: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.upper(F.date_format(day, "yyyy-MMM")), F.lit("-"))


def number_suffix(number: Column) -> Column:
    return F.element_at(F.split(number, "-"), -1).try_cast("long")


def weekday_letter(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in "MTWTFSS"]), F.weekday(day) + 1)


def percent(part: Column, whole: Column) -> Column:
    """The rounded percentage, half up; 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100 / whole)).otherwise(0).cast("long")


def bar(pct: Column, width: int = 20) -> Column:
    full = F.least(F.lit(width), F.greatest(F.lit(0), F.round(pct * width / 100))).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def joined(sep: str, *parts: Column) -> Column:
    """The parts that are neither null nor blank, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.trim(x) != ""), sep)


def leading_number(c: Column) -> Column:
    """The number that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?(\d+\.?\d*|\.\d+))", 1).try_cast("double"), F.lit(0.0))


def rupees(amount: Column) -> Column:
    """Two decimals, with a comma before the last three digits and then every two."""
    text = F.format_string("%.2f", F.abs(amount).cast("double"))
    whole, rest = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    head = F.when(F.length(whole) > 3, F.concat(F.regexp_replace(F.left(whole, F.length(whole) - 3), r"(?<=\d)(?=(\d\d)+$)", ","), F.lit(","))).otherwise("")
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), head, F.right(whole, F.least(F.lit(3), F.length(whole))), F.lit("."), rest)


def data_url(c: Column) -> Column:
    """Mime type, extension and bytes of a base64 data URL; null for other texts."""
    pattern = r"^data:([\w.+-]+/([\w.+-]+));base64,(.*)$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("mime"), F.regexp_extract(c, pattern, 2).alias("extension"), F.unbase64(F.regexp_extract(c, pattern, 3)).alias("data")))


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9]", "_")


def payment_status(grand: Column, advance: Column) -> Column:
    """Paid only if the advance meets the total exactly; too much counts as unpaid."""
    return F.when((advance > 0) & (grand - advance == 0), "Paid").when((advance > 0) & (grand - advance > 0), "Partially Paid").otherwise("Unpaid")


def conversation_kind(order_id: Column, conversation_id: Column) -> Column:
    return F.when(order_id.isNotNull(), "order").when(conversation_id.startswith("cust_"), "customer").otherwise("ticket")


def conversation_id(given: Column, phone: Column, ticket_id: Column, order_id: Column) -> Column:
    """The given id, else by phone, ticket or order."""
    number = phone_lenient(phone)
    return F.coalesce(
        or_else(given, F.lit(None)),
        F.concat(F.lit("cust_"), number),
        F.concat(F.lit("ticket_"), ticket_id.cast("string")),
        F.concat(F.lit("order_"), order_id.cast("string")),
        F.concat(F.lit("wa_"), phone),
    )


#: Event, text and description of a ticket's new status in its customer's conversation.
STATUS_EVENTS = {
    "New": ("repair_received", "Repair Received", "Device has been received for repair."),
    "Diagnosed": ("device_diagnosed", "Device Diagnosed", "Device has been diagnosed by technician."),
    "Awaiting Approval": ("awaiting_approval", "Awaiting Approval", "Estimate sent. Awaiting customer approval."),
    "In Progress": ("repair_in_progress", "Repair In Progress", "Repair work is in progress."),
    "Waiting For Parts": ("parts_ordered", "Parts Ordered", "Parts have been ordered for the repair."),
    "Completed": ("repair_completed", "Repair Completed", "Repair has been completed."),
    "Ready for Pickup": ("ready_for_pickup", "Ready For Pickup", "Device is ready for pickup."),
    "Delivered": ("delivered", "Delivered", "Device has been delivered to customer."),
    "Collected": ("collected", "Collected", "Device has been collected."),
    "Cancelled": ("cancelled", "Cancelled", "Repair has been cancelled."),
}
#: The template that tells a customer of a status, and the language of each template.
STATUS_TEMPLATES = {
    "Pending": "ticket_pending",
    "In Progress": "ticket_in_progress",
    "Ready for Pickup": "ticket_ready_for_pickup",
    "Completed": "ticket_completed",
    "Cancelled": "ticket_cancelled",
}
TEMPLATE_LANGUAGES = {
    "ticket_created": "en_GB",
    "ticket_pending": "en_GB",
    "ticket_completed": "en_GB",
    "ticket_cancelled": "en",
    "ticket_in_progress": "en",
    "ticket_ready_for_pickup": "en_IN",
    "order_created": "en_GB",
}
#: What the stars of a feedback mean, from one star on.
RATINGS = ("Poor", "Fair", "Good", "Very Good", "Excellent")


def mapped(c: Column, table: dict) -> Column:
    """The value that a constant table has for c, else null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def status_event(status: Column) -> Column:
    """A struct of event, text and description of a status, null for one without an event."""
    field = lambda i: mapped(status, {k: v[i] for k, v in STATUS_EVENTS.items()})
    names = ("event", "text", "description")
    return F.when(field(0).isNotNull(), F.struct(*[field(i).alias(n) for i, n in enumerate(names)]))


def rating_label(rating: Column) -> Column:
    return mapped(rating.cast("int"), dict(enumerate(RATINGS, 1)))


def truthy_or(a: Column, b: Column) -> Column:
    """a unless it is null or zero: the default of a number where zero counts as not given."""
    return F.when(a.isNull() | (a == 0), b).otherwise(a)


def phone_candidates(raw: Column) -> Column:
    """How a number may be written: as given, digits alone, without 91 in front, with it; first come, first tried."""
    clean = F.coalesce(phone_strict(raw), F.regexp_replace(digits(raw), "^0+", ""))
    bare = F.regexp_replace(clean, "^91", "")
    forms = F.array(raw, clean, F.regexp_replace(raw, "^91", ""), F.when(clean != "", F.concat(F.lit("91"), bare)))
    return F.array_distinct(F.filter(forms, lambda f: f.isNotNull() & (f != "")))


def event_class(title: Column) -> Column:
    t = F.lower(title)
    has = lambda *words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    return F.when(has("created", "added"), "create").when(has("updated", "modified"), "update").when(has("completed", "resolved"), "complete").when(has("cancelled", "deleted"), "cancel").otherwise("other")


def errors(**rules: Column) -> Column:
    """The names of the rules that a row breaks, in the order given, as field: message."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(text.replace("__", ": ").replace("_", " "))) for text, bad in rules.items()]), lambda x: x.isNotNull())


def blank(c: Column) -> Column:
    """Null, empty, or white space only."""
    return ~F.coalesce(c.rlike(r"\S"), F.lit(False))


def _broken(*rules: tuple[Column, str, str]) -> Column:
    """(field, message) of each rule whose condition holds, in order; a null condition doesn't."""
    found = [F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for bad, field, message in rules]
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def ticket_errors(customer_name: Column, primary_phone: Column, customer_phone: Column, device_type: Column, brand: Column, model: Column, issue_category: Column, problem_description: Column, issue: Column) -> Column:
    """What a ticket lacks, as an array of (field, message); one of two phones and one of two descriptions is enough."""
    return _broken(
        (blank(customer_name), "customerName", "Customer Name is required"),
        (blank(primary_phone) & blank(customer_phone), "primaryPhone", "Phone Number is required"),
        (blank(device_type), "deviceType", "Device Type is required"),
        (blank(brand), "brand", "Brand is required"),
        (blank(model), "model", "Model is required"),
        (blank(issue_category), "issueCategory", "Issue Category is required"),
        (blank(problem_description) & blank(issue), "problemDescription", "Problem Description is required"),
    )


def customer_errors(name: Column, phone: Column) -> Column:
    return _broken((blank(name), "name", "Customer name is required"), (blank(phone), "phone", "Phone number is required"))


def invoice_errors(customer_name: Column, items: Column) -> Column:
    """items is an array; null and empty ones hold nothing."""
    return _broken((blank(customer_name), "customerName", "Customer name is required"), (F.coalesce(F.size(items), F.lit(0)) <= 0, "items", "At least one invoice item is required"))


#: Kinds of contracts, and how often they are billed.
CONTRACT_TYPES = ("Basic", "Standard", "Premium", "Comprehensive", "Custom")
BILLING_CYCLES = ("Monthly", "Quarterly", "Half-Yearly", "Yearly", "One-Time")


def contract_errors(company: Column, mobile: Column, email: Column, start: Column, end: Column, value: Column, gst: Column, kind: Column, cycle: Column) -> Column:
    """The messages about a contract; start and end are dates, value and gst texts. What isn't given is only checked where it is required."""
    given = lambda c: c.isNotNull() & (c != "")
    number = lambda c: F.trim(c).try_cast("double")
    outside = lambda c, low, high: number(c).isNull() | F.isnan(number(c)) | (number(c) < low) | (number(c) > high)
    found = _broken(
        (blank(company), "companyName", "Company name is required"),
        (given(mobile) & ~mobile.rlike(r"^[+]?[\d\s()-]{7,20}$"), "mobile", "Invalid mobile number format"),
        (given(email) & ~email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "email", "Invalid email format"),
        (start.isNull(), "startDate", "Start date is required"),
        (end.isNull(), "endDate", "End date is required"),
        (end <= start, "endDate", "End date must be after start date"),
        (given(value) & outside(value, 0, float("inf")), "contractValue", "Contract value must be a positive number"),
        (given(gst) & outside(gst, 0, 100), "gstPercentage", "GST percentage must be between 0 and 100"),
        (given(kind) & ~kind.isin(*CONTRACT_TYPES), "contractType", "Invalid contract type. Must be one of: " + ", ".join(CONTRACT_TYPES)),
        (given(cycle) & ~cycle.isin(*BILLING_CYCLES), "billingCycle", "Invalid billing cycle. Must be one of: " + ", ".join(BILLING_CYCLES)),
    )
    return found
