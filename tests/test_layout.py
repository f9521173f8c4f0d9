"""Pages of any layout: bodies found by block scores."""

from pyspark.sql import functions as F

from pressline.functions.html import extract_pages
from pressline.operators.layout import containers, block_table, extract_any_layout
from tests.conftest import SF_SMALL

LONG = "This paragraph is long enough, and has a comma, to be taken for a part of the story."


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id int, html string")


def test_div_layouts(spark):
    nav = "<ul>" + "".join(f"<li><a href='/{i}'>{LONG}</a></li>" for i in range(6)) + "</ul>"
    story = f"<div class=story><h1>Head</h1><p>{LONG}</p><p>Short.</p><div class=ad>Buy now</div><p>Second &amp; {LONG}<a href=x>link</a></p></div>"
    got = extract_any_layout(pages(
        spark,
        f"<html><head><title>T &lt;1&gt;</title></head><body><nav>x</nav><div>{nav}</div>{story}<footer>{LONG}</footer></body></html>",
        f"<title>T</title><body><div id=a><div><p>{LONG} one</p></div><div><p>{LONG} two</p></div><div><p>{LONG} three</p><p>x</p></div></div></body>",
        f"<title>T</title><TABLE><tr><TD class='c'>{LONG}<br>after</TD><td>side</td></tr></TABLE>",
        f"<title>T</title></div></div><div><p>{LONG}</p>",
        "<title>T</title><body><p>too short</p></body>",
        None,
        f"<title>A</title><article><p>in the article</p></article><div><p>{LONG}</p></div>",
        f"<title>E</title><article></article><div><p>{LONG}</p></div>",
        f"<title>N</title>{LONG}",
    )).orderBy("page_id").collect()
    assert (got[0].title, got[0].content_text, got[0].error) == ("T <1>", f"{LONG}\n\nShort.\n\nSecond & {LONG}link", False)
    assert got[1].content_text == f"{LONG} one\n\n{LONG} two\n\n{LONG} three"
    assert got[2].content_text == f"{LONG}after"
    assert got[3].content_text == LONG
    assert [(got[k].error, got[k].title, got[k].content_text) for k in (4, 5)] == [(True, None, None)] * 2
    assert got[6].content_text == "in the article"
    assert got[7].content_text == LONG
    assert got[8].content_text == LONG


def test_owners_by_depth(spark):
    p = pages(spark, "<div>a<section>b</section>c<section>d<div>e</div>f</section></div>g<div>h</div>")
    rows = containers(block_table(p, "page_id", "html"), "page_id").where("step = 0").orderBy("at").collect()
    opened = {r.piece: r.owner for r in rows}
    assert [opened[x] for x in "abcdefgh"] == [0, 2, 0, 6, 8, 6, -1, 15]


def test_stored_pages_stay_equal_and_div_copies_give_their_body(spark):
    stored = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html")
    want = {r.page_id: tuple(r)[2:] for r in extract_pages(stored).collect()}
    assert {r.page_id: tuple(r)[2:] for r in extract_any_layout(stored).collect()} == want
    divs = stored.withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit("<div><div class='s'>")), F.lit("</article>"), F.lit("</div></div>")))
    assert extract_pages(divs).where("NOT error").count() == 0
    got = {r.page_id: tuple(r)[2:] for r in extract_any_layout(divs).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.9 * len(want)


def test_repeated_pages_and_no_pages(spark):
    html = f"<title>T</title><div><p>{LONG}</p></div>"
    twice = spark.createDataFrame([(1, html), (1, html), (None, html)], "page_id int, html string")
    assert [r.content_text for r in extract_any_layout(twice).collect()] == [LONG] * 3
    assert extract_any_layout(twice.limit(0)).count() == 0
