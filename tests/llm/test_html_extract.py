import html
import re
import time
import tracemalloc

import pytest

from gridtrend.llm import html_extract as X

SCHEMA = "page_id long, url string, html string"
MAIN = "<h1>Title &amp; more</h1><p>First paragraph, long enough to be an article&#39;s.<br>Its\n second line.<p><b>Not closed</b> either"
TEXT = "Title & more\nFirst paragraph, long enough to be an article's. Its second line.\nNot closed either"
NOISE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";if(a<b){}</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice"><p>We use cookies on this site, accept them please.</p></div><form><p>Subscribe now</p><input></form>
%s<aside><p>Side text that is long, long, long, long.</p></aside>
<section id="comments"><h3>Comments</h3><p>A reader has written a very long comment here, longer than the article was, on and on.</p></section>
<div class="sidebar-2 right"><p>More side text.</p></div><footer>&copy; 2000</footer></body></html>"""


def test_templates():
    for body in (
        f"<article>{MAIN}</article>",
        f"<main><article class=a>{MAIN}<div class='share'>Share</div><div class=ad>Buy</div></article></main>",
        f"<div class='page wrap'><div id='content' class='post-17'>{MAIN}<form><p>Leave a reply</form></div><div class='related'><p>See also this</div></div>",
        f"<table><tr><td><a href=/x>Menu</a></td><td>{MAIN}</td></tr></table>",
    ):
        assert X.Page(NOISE % body).extract([]) == TEXT


def test_wrappers_keep_their_text():
    for body in (
        f"<div id=wrapper class='has-sidebar'><div>{MAIN}</div><div class='sidebar'>Side</div></div>",
        f"<form id=aspnetForm><div>{MAIN}</div><div class=comments>One comment</div></form>",
        f"<form><div class='search-page'><div class=x>{MAIN}</div></div></form>",
    ):
        page = f"<html><body><nav>Menu</nav>{body}<footer>End</footer></body></html>"
        assert X.Page(page).extract([]) == TEXT
    talk = f"<body><div>{MAIN}</div><div class=comments><p>{'a comment ' * 30}</p></div></body>"
    assert X.Page(talk).extract([]) == TEXT
    talk = f"<body><article>{MAIN}</article><div class=comments><p>{'a comment ' * 300}</p></div></body>"
    assert X.Page(talk).extract([]) == TEXT


def test_heading_and_lead_above_the_content():
    page = f"<body><div><h1>Head</h1><p>The lead.</p><p><a href=/>Linked only</a></p><div class=content>{MAIN * 3}</div></div></body>"
    got = X.Page(page).extract([])
    assert got.startswith("Head\nThe lead.\nTitle") and "Linked" not in got


def test_host_path_that_holds_a_part_only(spark):
    """The winner of the host holds a third of a longer page's article."""
    story, more = "<p>" + "story " * 40 + "</p>", "<p>" + "more " * 40 + "</p>"
    rows = [(i, f"http://a.example/{i}", f"<body><div class=story>{story}</div></body>") for i in range(5)]
    rows += [(9, "http://a.example/9", f"<body><div class=story>{story}</div><div class=next>{more}</div><div class=last>{more}</div></body>")]
    got = {r["page_id"]: r["text"] for r in X.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[9].count("story") == 40 and got[9].count("more") == 80


def test_no_more_than_six_paths_meet(spark):
    rows = [("h", f"body>div.{i:03d}", 1) for i in range(300)] + [("g", f"p{i}", 10) for i in range(5)] + [("g", "q", 1)]
    counted = spark.createDataFrame(rows, "host string, path string, pages long")
    got = {r["host"]: r["winners"] for r in X.winning_paths(counted).collect()}
    assert got == {"h": ["body>div.000"], "g": ["p0"]}


def test_odd_markup():
    assert X.Page("").extract([]) == ""
    assert X.Page("plain &lt;text&gt;  only").extract([]) == "plain <text> only"
    assert X.Page("<p>a < b && c > d</p><p>&&& &nbsp; ###</p>").extract([]) == "a < b && c > d\n&&& ###"
    assert X.Page("<div><p>one</div></p></b>two<script>").extract([]) == "one\ntwo"
    assert X.Page("<p title='a>b'>x</p><p class=\"unclosed>y</p>").extract([]).startswith("x")
    assert X.Page("<div>" * 3000 + "deep" + "</div>" * 3000).extract([]) == "deep"
    assert X.Page("<ul><li>a<li>b</ul><p>c<p>d").extract([]) == "a\nb\nc\nd"


def test_host_consensus(spark, clash):
    """A page whose longest container is another one follows its host."""
    page = '<body><div class="story">%s</div><div class="extra">%s</div></body>'
    words = lambda n, w: f"<p>{w * n}</p>"
    rows = [(i, f"https://u@News.example:80/{i}", page % (words(40, "story "), words(3, "more "))) for i in range(9)]
    rows += [(10, "http://news.example/x?y", page % (words(30, "story "), words(60, "more ") * 2))]
    rows += [(11, "http://other.example/", page % (words(30, "story "), words(200, "more ") * 2))]
    rows += [(12, None, rows[0][2]), (13, "no url", None), (14, "http://news.example", ""), (0, rows[0][1], rows[0][2])]
    df = clash(spark.createDataFrame(rows, SCHEMA), "host", "winners", "text", "__w")
    out = X.extract(df)
    got = {r["page_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[10]["text"] == ("story " * 30).strip()
    assert got[11]["text"].startswith("more more")
    assert got[12]["text"] == ("story " * 40).strip() and got[0]["text"] == got[12]["text"]
    assert got[13]["text"] == got[14]["text"] == "" and got[13]["n_chars"] == 0
    assert got[10]["host"] == "own" and got[10]["n_chars"] == len(got[10]["text"])


def test_whole_table(spark):
    """Against cutting the one template of the table with regular expressions."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in X.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", body)
        lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in parts)
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)


def test_empty_table(spark):
    assert X.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def words(n, of="word"):
    return " ".join(f"{of}{i}" for i in range(n))


@pytest.mark.parametrize(
    "body",
    [
        "<div class=main><div class=part>{a}</div><div class=more>{b}</div></div>",
        "<div class=main><ul><li>{b}</li></ul><div class=content>{a}</div></div>",
        "<div class=main><div class=content>{a}</div><blockquote>{b}</blockquote></div>",
        "<div class=main>{b}<div class=content>{a}</div></div>",
        "<div class=main><div class=content>{a}</div>{b}</div>",
        "<article><p>{a}</p><p class='share-price'>{b}</p></article>",
        "<article><p>{a}</p><p id='form-of-art'>{b}</p></article>",
        "<article><p>{a}</p><div class='related-facts comment-on-history'>{b}</div></article>",
    ],
)
def test_no_article_text_is_lost(body):
    page = "<html><body><nav>Menu</nav>" + body.format(a=words(400), b=words(20, "more")) + "<footer>End</footer></body></html>"
    assert sorted(X.Page(page).extract([]).split()) == sorted((words(400) + " " + words(20, "more")).split())


def test_marked_parts_still_go():
    for mark in ("share", "share-buttons", "related-posts", "cookie-notice", "nav_bar", "sidebar-2 right", "siteFooter", "ad", "comment-list"):
        page = f"<body><div class=main><div class=content>{words(400)}</div><div class='{mark}'>{words(5, 'gone')}</div></div></body>"
        assert X.Page(page).extract([]) == words(400), mark


def test_every_nested_word_stays():
    page = "<body>" + "".join(f"<div>n{i} " for i in range(2000))
    assert X.Page(page).extract([]).split() == [f"n{i}" for i in range(2000)]


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000, '<a "' * 250_000, "<div>" * 100_000 + "deep", "<div>y " * 100_000, "<div class=a>y" * 20_000,
        "<b>" * 50_000 + "</i>" * 50_000, "<b><div>" * 30_000 + "</b>" * 30_000, "<script>" + "</script " * 50_000,
        "<!" * 300_000, "<!--" * 200_000, "<p class='" * 100_000, "<" * 500_000 + ">" * 500_000,
    ],
    ids=range(12),
)
def test_odd_pages_take_time_and_memory_in_proportion(page):
    start = time.process_time()
    X.Page(page).extract([])
    assert time.process_time() - start < 10
    tracemalloc.start()
    X.Page(page[: len(page) // 4]).extract([])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000


def test_paths_of_a_host_by_brute_force(spark):
    """Votes counted by host, against a count of the pages' own choices."""
    shapes = ["<div class=story9>{}</div>", "<div class='b a'><section>{}</section></div>", "<table><tr><td>{}</td></tr></table>"]
    rows = [(i, f"http://h{i % 3}/x", "<body>" + shapes[i * i % 7 % 3].format(words(30 + i)) + "</body>") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", X.host(X.F.col("url")))
    want = {}
    for _, url, page in rows:
        key = (url[7:9], X.Page(page).vote().path)
        want[key] = want.get(key, 0) + 1
    got = {(r["host"], r["path"]): r["pages"] for r in X.votes(df.select("host", "html")).collect() if r["pages"]}
    assert got == want and len({p for _, p in want}) == 3
    kept = {r["host"]: r["winners"] for r in X.winning_paths(X.votes(df.select("host", "html"))).collect()}
    for h in ("h0", "h1", "h2"):
        mine = {p: n for (g, p), n in want.items() if g == h}
        most, whole = max(mine.values()), sum(mine.values())
        wins = [p for p, n in sorted(mine.items(), key=lambda x: (-x[1], x[0])) if n >= 0.2 * whole or n == most]
        assert kept[h] == wins
