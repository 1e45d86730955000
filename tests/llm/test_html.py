import html
import re

import duckdb
import pytest

from riskflow.llm import html_text
from riskflow.llm.entries import QUERIES


def test_query_on_the_given_table(spark, sf):
    rows = {r["page_id"]: r for r in QUERIES["op7_main_text"](spark, sf).collect()}
    pages = duckdb.connect().execute(f"select page_id, url, html from '{sf}/pages.parquet'").fetchall()
    assert len(rows) == len(pages)
    for i, url, page in pages:
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert (rows[i]["url"], rows[i]["text"], rows[i]["n_chars"]) == (url, want, len(want))


LONG = "This is the long text of the article, with many words and few tags in it. " * 3


@pytest.mark.parametrize(("page", "want"), [
    (f"<div class='cookie-notice'>We use cookies, really</div><div class=content><h2>Title</h2><p>{LONG}</p><p>Short.</p></div><div id=comments><p>{LONG}</p></div>", f"Title {LONG.strip()} Short."),
    (f"<header><h1>Site</h1></header><ul class=menu><li>a<li>b</ul><p>{LONG}<br>x &lt;b&gt; &amp; y&nbsp;z</p><aside>{LONG}</aside><form><label>Name</label></form><footer>Us</footer>", f"{LONG.strip()} x <b> & y z"),
    (f"<div class=ad>{LONG}<article><p>One<i>two</i> three</p></article>", "Onetwo three"),
    (f"<article><h1>A</h1><p>{LONG}</p><div class=advert>{LONG}</div><p>B</p></article><p>{LONG}</p>", f"A {LONG.strip()} B"),
    # classes that tell about the page around, or that a page, article or main part carries as a whole
    (f"<body class='has-sidebar'><div class='post has-comments'><h1>Title</h1><p>{LONG}</p></div></body>", f"Title {LONG.strip()}"),
    (f"<body class='comments-open header-fixed'><article class='post-header-big'><p>{LONG}</p></article></body>", LONG.strip()),
    # teasers are articles, the body is none
    (f"<div><h1>Title</h1><p>{LONG}</p><p>Short.</p></div><section><article><h3>Read next</h3></article><article><h3>Other teaser</h3></article></section>", f"Title {LONG.strip()} Short."),
    # a headline before the article, navigation in a plain element before it
    (f"<div><a href=/>Home</a> <a href=/a>About</a></div><h1>Headline</h1><article><p>{LONG}</p><p>End.</p></article>", f"Headline {LONG.strip()} End."),
    (f"<div><a href=/>Home</a> <a href=/a>About</a></div><p>{LONG}</p><p>End with <a href=/x>a link</a>.</p>", f"{LONG.strip()} End with a link."),
    # a main part holds body and teasers
    (f"<main><h1>Title</h1><p>{LONG}</p><article>More</article></main>", f"Title {LONG.strip()}"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- no --><p>yes</p>", "yes"),
    ("plain text only", "plain text only"),
    ("", ""),
    ("<nav>only a menu</nav>", ""),
    ("<p>a<p>b</div></span>c", "a b c"),
    ("<p>" + "x" * 200_000 + "</p>", "x" * 200_000),
])
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "<p>a</p>", "x"), (3, "", None), (4, "<b>" * 5000 + "deep", "x")]
    table = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = html_text.extract(table).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in found) == [(0, "a"), (1, ""), (1, ""), (3, ""), (4, "deep")]
    assert html_text.extract(table.limit(0)).count() == 0
