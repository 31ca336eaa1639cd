import duckdb
import pytest

from shoploom.llm import urls
from shoploom.llm.components import components
from shoploom.llm.sql import ORACLES

LINK = '<html><LINK rel="canonical" HREF="{}"></html>'
REFRESH = "<meta http-equiv='refresh' content='0; url={}'>"
PAGES = [
    (1, "http://a.org/x", LINK.format("https://b.net/fr/page")),  # an alias of a blocked page
    (2, "https://b.net/fr/page#top", "plain"),
    (3, "http://c.org/y?utm_source=z&q=1", REFRESH.format("http://a.org/x")),  # over two steps
    (4, "https://c.org/y?q=1", None),
    (5, "http://d.org/1", LINK.format("//www.example.com/en/ok")),  # its class has an allowed page too
    (6, "http://d.org/1", LINK.format("http://b.net/es/bad")),
    (7, "HTTP://WWW.Example.COM/en/ok", ""),
    (8, "http://sub.example.com/en/", None),
    (9, "http://x.com", None),
    (10, "no scheme", LINK.format("http://b.net/fr/page")),
    (11, None, LINK.format("http://b.net/fr/page")),
    (12, "http://e.org/dir/page", LINK.format("other")),
    (13, "http://e.org/dir/other", LINK.format("/fr/")),
    (14, "http://badexample.com/en/x", None),
    (15, "http://net/es/", None),
    (15, "http://net/es/", None),
]


def test_against_sql(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, rule string")
    got = urls.filter_urls(df)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    names = ["page_id", "host", "path", "rule", "verdict", "component"]
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(con.sql(ORACLES["op10_url_filter"]).select(*names).fetchall(), key=key)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == want
    verdict = {r.page_id: r.verdict for r in got.collect()}
    assert [verdict[i] for i in range(1, 16)] == ["block", "block", "block", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow", "block"]
    rules = {r.page_id: r.rule for r in got.collect()}
    assert rules[8] == "example.com/en/" and rules[7] == "www.example.com/en/" and rules[9] is None and rules[14] == "com/" and rules[15] == "net/es/"
    assert urls.filter_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(99, i) for i in range(30)] + [(5, 200), (200, 201), (300, 301), (None, 3)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
            if x is not y:
                x |= y
                of |= {n: x for n in y}
    assert got == {n: min(c) for n, c in of.items()}
