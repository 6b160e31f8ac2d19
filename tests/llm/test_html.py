"""Line blocks of pages: against a plain version on generated pages, broken pages, and what the distribution decides."""

import random
import time

import pytest
from pyspark.sql import functions as F

from llm import html_text

LONG = ("Words of the text that go on and on, for a line that is long enough to count. " * 2).strip()


def plain(lines):
    """The stretches between dives that have a surging window, by definition; ``lines`` has text and mass of each."""
    keep = []
    sums = [sum(m for _, m in lines[i : i + 3]) for i in range(len(lines))]
    least = min(80, max(sums, default=0))
    cuts = [i for i, (_, m) in enumerate(lines) if any(all(m2 == 0 for _, m2 in lines[j : j + 3]) and j <= i < j + 3 for j in range(len(lines) - 2))]
    run = []
    for i in [*range(len(lines)), None]:
        if i is None or i in cuts:
            while run and not lines[run[-1]][1]:
                run.pop()
            while run and not lines[run[0]][1]:
                run.pop(0)
            if run and max(sum(lines[j][1] for j in run[at : at + 3]) for at in range(len(run))) >= least:
                keep += run
            run = []
        else:
            run.append(i)
    return "\n".join(lines[i][0] for i in keep)


def test_is_as_a_plain_version_on_generated_pages():
    rnd = random.Random(1)
    cut = 0
    for _ in range(400):
        lines, html = [], []
        for i in range(rnd.randint(0, 25)):
            text = f"line {i} " + "x" * rnd.choice((0, 5, 30, 90))
            text, linked = text.strip(), rnd.random() < 0.5
            lines.append((text, 0 if linked else len(text)))
            html.append(f"<p><a href='/'>{text}</a></p>" if linked else f"<div>{text}</div>")
        want = plain(lines)
        assert html_text.main_text("<body>" + "".join(html)) == want
        cut += want != "\n".join(t for t, m in lines)
    assert cut > 300


def test_surges_and_dives_decide():
    menu = "<ul>" + "<li><a href=/x>Somewhere else</a></li>" * 5 + "</ul>"
    assert html_text.main_text(f"{menu}<div>Short.</div><div>{LONG}</div><p>End.</p>{menu}<div>(c) me</div>") == f"Short.\n{LONG}\nEnd."
    # main elements surge however short they are, and blocks beside them do not, however long
    assert html_text.main_text(f"<article>Brief.</article>{menu}<div>{LONG * 50}</div><p>Copyright text line here</p>") == "Brief."
    assert html_text.main_text(f"<article>{LONG}</article><article>Brief.</article>") == f"{LONG}\nBrief."
    assert html_text.main_text(f"<article><p>Short one.</p></article><p>{LONG}</p><article><p>{LONG}</p></article>") == f"Short one.\n{LONG}"
    assert html_text.main_text(f"<div class=sidebar><article>{LONG}</article></div>") == LONG
    assert html_text.main_text(f"<div class=sidebar><article>{LONG}</article></div><article>A</article>") == "A"
    assert html_text.main_text("<article><h1>To</h1><p>Be.</p></article>") == "To\nBe."
    assert html_text.main_text(f"{menu}<div class=ad>{LONG}</div><footer>{LONG}</footer>") == ""


def test_pages_of_the_table_need_surges_and_dives(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    for html in pages:
        lines = html_text.lines_of(html)
        assert html_text.main_text(html) != "\n".join(x.text for x in lines if x.mass)
        assert html_text.main_text(html) == "\n".join(x.text for x in lines if x.level == html_text.MARKED)
    assert len(pages) == 50


def test_hints_are_whole_names():
    for name in ("content no-sidebar", "has-sidebar", "layout with-comments", "download", "header2"):
        assert html_text.main_text(f"<div class='{name}'><p>{LONG}</p></div>") == LONG
    for name in ("sidebar", "site-header", "cookie_notice", "Comment-List", "ad-slot x", "comments"):
        assert html_text.main_text(f"<p>{LONG}</p><div class='{name}'><p>No. {LONG}</p></div><p>End.</p>") == f"{LONG}\nEnd."
    assert html_text.main_text(f"<article><header><h1>Head</h1></header><p>{LONG}</p><footer>By me</footer></article>") == f"Head\n{LONG}"
    assert html_text.main_text(f"<form id=page><nav>n</nav><main><p>{LONG}</p></main></form>") == LONG
    assert html_text.main_text(f"<p>a <span class=ad>buy</span> b {LONG}</p>") == f"a b {LONG}"
    assert html_text.main_text(f"<nav><div class=ad></nav><p>{LONG}</p>") == LONG


@pytest.mark.parametrize("page", ["<a", "<!", "<", '<a b="', "<a \"'>'\" ", "&#9", "&", "<script></script", "<p>", "<!--", "<nav>", "</p", "<article>", "<li class=ad>"])
def test_broken_pages_of_a_megabyte_end(page):
    began = time.time()
    html_text.main_text(page * (1_000_000 // len(page)))
    html_text.main_text("<div class=ad>" * 20000 + "<div class=menu>" * 20000 + page * 20000 + "</div>" * 40000)
    assert time.time() - began < 10


def test_references_of_any_length():
    assert html_text.main_text("<article>a&#" + "9" * 9000 + ";b&#0000000065;&#x41;&amp;&nope;") == "a\ufffdbAA&&nope;"


def test_ids_beside_null_ones_stay(spark):
    big = 1 << 60
    rows = [(big + 1, "u", f"<p>{LONG}</p>"), (None, None, None), (big + 3, "v", "x" * 2_000_000), (big + 3, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = html_text.extract(pages).select("page_id", "url", F.char_length("text").alias("n"), "n_chars").collect()
    assert [tuple(r) for r in got] == [(big + 1, "u", len(LONG), len(LONG)), (None, None, 0, 0), (big + 3, "v", 2_000_000, 2_000_000), (big + 3, "v", 0, 0)]
