import html as entities
import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoploom.llm import article as a

FOLDER = "/root/testdata/sf0.01"
P = "A paragraph that is long enough to look like the text of an article, with commas, and with more words after them. "
Q = "Another one that goes on for quite a while, so that its ratio of text to tags is high, as those of paragraphs are. "


def test_marked_up_page():
    page = f"""<!DOCTYPE html><html><head><title>T | Site</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
      <header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">{P}</div>
      <main><h1>The   title</h1><article class="post comments-open"><p><b>{P}<br><p>Be.<p>x &lt; y &amp;&nbsp;z <script>no()</script>and <button>Share</button> on
      </p><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><form>Name <input></form><aside>{Q}</aside><blockquote>{Q}</blockquote></article>
      <section id="comments"><article class="comment"><p>{Q}</p></article></section></main>
      <div role="complementary"><p>{Q}</p></div><div class="cookie-notice">{P}</div><footer>&copy; Site</footer></body></html>"""
    assert a.main_text(page).split("\n") == ["The title", P.strip(), "Be.", "x < y & z and on", "one", "two", "a b", "c", Q.strip()]


@pytest.mark.parametrize(
    "body",
    [
        f"<div id='header'><a href=/>Home</a> Site</div><div class='menu'><a href=1>a</a></div><div id='content'><h1>T</h1><p>{P}</p><p>Be.</p><p>{Q}</p></div><div class='sidebar'><p>{P}</p></div>",
        f"<div><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div><h1>T</h1><p>{P}</p><p>Be.</p><p>{Q}</p></div><div>Accept cookies <a href=3>Yes</a></div>",
        f"<main><h1>T</h1><p>{P}<p>Be.<p>{Q}</main><div class='newsletter-form'>{P}</div>",
        f"<h1>T</h1><p>{P}<p>Be.<p>{Q}",
        f"<div class='page'><div class='notice-text'>{P}</div><div><h1>T</h1><p>{P}</p></div><div><p>Be.</p></div><ins class='adsbygoogle'>{P}</ins><div class='elementor-widget-text-editor'>{Q}</div></div><div class='widget'>{P}</div>",
        f"<div class='layout-sidebar-left'></div><div class='no-sidebar'><article><h1>T</h1><div class='entry-content'><p>{P}</p><p>Be.</p></div><p>{Q}</p></article></div><div class='related-posts'><article><p>{P}</p></article></div>",
    ],
)
def test_other_layouts(body):
    assert a.main_text(f"<html><body>{body}</body></html>") == "\n".join(["T", P.strip(), "Be.", Q.strip()])


def test_ratios_make_two_clusters():
    ratios = np.array([1.0, 2, 1, 90, 80, 5, 95, 85, 2, 1])
    values = a.smoothed(ratios)
    assert len(values) == 10 and values[5] > 40  # a short line between long ones is lifted
    assert a.smoothed(np.full(4, 7.0)) == pytest.approx([7.0] * 4)
    assert (values >= a.threshold(values)).tolist() == [False] * 3 + [True] * 5 + [False] * 2
    assert a.threshold(np.array([3.0, 3.0])) == 3.0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
def test_whole_pages_against_their_articles(spark):
    found = a.extract(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    text = {r.page_id: r for r in found.collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(text) == len(pages)
    for page in pages:
        own = re.search("<article>(.*?)</article>", page.html, re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", own)]
        assert text[page.page_id].text == "\n".join(b for b in blocks if b)
        assert text[page.page_id].n_chars == len(text[page.page_id].text) and text[page.page_id].url == page.url


@pytest.mark.parametrize("page", ["<!--" * 100_000, "<a " * 100_000, "<a href='" * 50_000, "<div>" * 30_000 + "x", "<p><b>" * 30_000, "&" * 100_000, "<" * 100_000, "<script>" * 20_000, "<li>" * 30_000, "</p>" * 30_000, "<table><tr><td>" * 10_000])
def test_hostile_pages_end(page):
    began = time.time()
    a.main_text(page)
    assert time.time() - began < 20


def test_pieces_change_nothing(monkeypatch):
    page = f"<body><nav>n</nav><article><p>{P} &amp; &copy; <b>x</b></p><p>{Q}</p></article></body>" * 3
    whole = a.main_text(page)
    monkeypatch.setattr(a, "PIECE", 7)
    assert a.main_text(page) == whole and "& ©" in whole


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", f"<p>{P}"), (5, "u", "<form>Log in</form><nav>n</nav>"), (6, "u", "just <b>text"), (7, "u", f"<article><p>{'word ' * 400_000}</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("lines", F.lit(3))
    out = a.extract(df)
    assert out.columns == ["page_id", "url", "lines", "text", "n_chars"]
    got = sorted((str(r.page_id), r.text[:9], r.n_chars) for r in out.collect())
    assert got == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("5", "", 0), ("6", "just text", 9), ("7", "word word", 1_999_999), ("None", P[:9], len(P.strip()))]
    assert a.extract(df.limit(0)).count() == 0
