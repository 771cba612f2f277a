"""Pages of several builds, and the whole table against a plain reading of its one build."""

import html
import re

import pytest
from pyspark.sql import functions as F

from braidwork.llm import extraction, queries

LONG = "A paragraph with a good many words in it, long enough that nobody would take it for a menu or a caption of any kind."
MORE = "Another one follows, no shorter than the first, and says what the first has left out about the matter in hand today."


def text_of(spark, page):
    return spark.createDataFrame([(1, page)], "page_id long, html string").transform(extraction.main_text).first()["text"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>Title</h1><p>{LONG}<p>One.</p><p>Two &amp; more.</p></article><footer>&copy; me</footer>", f"Title\n{LONG}\nOne.\nTwo & more."),
        (f"<div class='site'><div id=sidebar><p>{MORE}</p></div><div class='post-content'><h2>T</h2><p>{LONG}</p>tail</div><div class=cookie-notice>We use them.</div></div>", f"T\n{LONG}\ntail"),
        (f"<body><main><p>{LONG}</p><form>Name <input> <button>Send</button></form><section id='comments'><h3>Comments</h3><p>{MORE}</p></section></main></body>", LONG),
        (f"<article><header><h1>T</h1></header><p>{LONG}<br>\n x&nbsp;&nbsp;y</p><aside>{MORE}</aside><footer>By me</footer></article>", f"T\n{LONG} x y"),
        (f"<script>if (a < b) document.write('<p>{LONG}</p>')</script><style>p{{}}</style><!-- <p>{LONG}</p> --><article><p>{MORE}</p></article>", MORE),
        (f"<table><tr><td><a>Home</a><td><a>About us</a></table><h1>A fine title here</h1><p>{LONG}</p><p>{MORE}</p><p><a>Imprint</a></p>", f"A fine title here\n{LONG}\n{MORE}"),
        (f"<article><p>{LONG}</p><div class=advert>{MORE}</div><p>x &lt;b&gt; &#233; &#x2014; &nosuch; &amp;lt;</p><ul><li>a<li>b</ul></article>", f"{LONG}\nx <b> é — &nosuch; &lt;\na\nb"),
        (f"<form id=whole><nav>Menu</nav><main><p>{LONG}</p></main></form>", LONG),
        (f"<article><p>{LONG}</p><script>never ended <p>{MORE}</p>", LONG),
        (f"</div></p><article><p title='a > b'>{LONG}</p></div><p>1 < 2 and <b>open", f"{LONG}\n1 < 2 and open"),
        (None, ""),
        ("", ""),
        ("<html><head><title>T</title></head><body></body></html>", ""),
        ("<nav><a href=/>Home</a></nav>", ""),
    ],
)
def test_builds_of_pages(spark, page, want):
    assert text_of(spark, page) == want


def test_a_very_long_page_is_kept_whole(spark):
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(20_000))
    assert text_of(spark, f"<nav><a>x</a></nav><article>{body}</article><footer>end</footer>") == "\n".join(f"{LONG} {i}" for i in range(20_000))


def test_copies_clashing_columns_and_empty_tables(spark):
    rows = [(1, "u", "<article><p>One two.</p></article>", 5, "mine"), (1, "u", "<article><p>One two.</p></article>", 5, "mine"), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, _page string")
    assert sorted(map(str, extraction.report(pages).collect())) == sorted(map(str, [*[(1, "u", "One two.", 8)] * 2, (None, None, "", 0)])) or [tuple(r) for r in extraction.report(pages).orderBy("page_id").collect()] == [(None, None, "", 0), (1, "u", "One two.", 8), (1, "u", "One two.", 8)]
    kept = extraction.main_text(pages, out="main")
    assert kept.columns == [*pages.columns, "main"] and kept.where("_page = 'mine'").count() == 2
    assert extraction.report(pages.limit(0)).count() == 0


def test_the_tree_holds_out_pages():
    """Each page of the table by a tree that has not seen it."""
    right = total = 0
    x, y = extraction.labelled()
    at = 0
    for page in extraction.BLOCKS:
        own = slice(at, at + len(page))
        at += len(page)
        rest = [i for i in range(len(y)) if not own.start <= i < own.stop]
        tree = extraction.trained(x[rest], y[rest])
        for row, want in zip(x[own], y[own], strict=True):
            t = tree
            while not isinstance(t, int):
                t = t.low if row[extraction.FEATURES.index(t.feature)] <= t.at else t.high
            right += t == want
            total += 1
    assert right / total > 0.9


def test_the_whole_table(spark):
    """The table's articles stand in one element; its blocks are paragraphs and breaks."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op11_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_blocks_are_judged_by_expressions(spark):
    plan = extraction.report(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert spark.range(1).select(F.size(extraction.judged(F.from_json(F.lit("[]"), extraction.BLOCK)))).first()[0] == 0
