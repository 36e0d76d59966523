"""Article extraction on small pages."""

from gristmill.functions import html as H
from gristmill.operators import pages as P

PARA = "This is the story that he said was in the paper and it is about all of them."
PAGE = f"""<html><head><title>Site | A rather long headline about things</title><meta name="description" content="What it is">
<meta property="article:published_time" content="2024-02-03T10:00:00Z"><meta name="datePublished" content="2024-02-01"><link rel="canonical" href="http://news.example.org/a">
<script>var x = "<p>the of and to in is it</p>";</script></head><body><nav><a href="/x">the menu of all and one</a></nav>
<div class="sidebar-ads"><p>{PARA} advert</p></div><div id="story"><p>{PARA} One.<p>{PARA} Two.</p><p><a href="/b" rel="tag">topic</a></p><p>Short.</p><div>{PARA} <b>Three</b>.</div></div>
<img src="/big.png" width="400" height="300"><img src="/banner.png" width="900" height="60"><iframe src="http://www.youtube.com/embed/1"></iframe></body></html>"""


def test_fields():
    a = H.extract(PAGE, "http://news.example.org/path/a?x=1")
    assert a["title"] == "A rather long headline about things" and a["description"] == "What it is"
    assert a["canonical"] == "http://news.example.org/a" and a["domain"] == "news.example.org" and a["published"] == "2024-02-01"
    assert a["body"] == f"{PARA} One.\n\n{PARA} Two.\n\n{PARA} Three."
    assert a["tags"] == ["topic"] and "http://news.example.org/b" in a["links"] and a["videos"] == ["http://www.youtube.com/embed/1"]
    assert a["image"] == "http://news.example.org/big.png"


def test_edges():
    assert H.extract(None)["title"] is None and H.extract(None)["links"] == []
    assert H.extract("")["body"] == "" and H.extract("<p>")["title"] == ""
    deep = "<div>" * 5000 + PARA + "</div>" * 5000
    assert PARA in H.extract(f"<body>{deep}</body>")["body"]
    assert H.extract("</p></b>< a <!-- x")["body"] == ""
    links = "".join(f'<a href="/{i}">the and of it</a>' for i in range(9))
    assert H.extract(f"<body><p>{links}</p></body>")["body"] == ""


def test_title_pieces():
    assert H.longest_title_piece("Site: the news - of today") == "Site: the news"
    assert H.longest_title_piece("  one \n two ") == "one two"


def test_pages(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", PAGE), (2, "bad url", None), (3, None, "<p>no</p>")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in P.articles(df).collect()}
    assert rows[1].body.count("\n\n") == 2 and rows[2].title is None and rows[3].body == ""
    assert [r.page_id for r in P.articles(df, min_words=20).collect()] == [1]
    got = df.select("page_id", P.raw_title(df.html).alias("t"), P.link_targets(df.html).alias("l")).collect()
    assert got[0].t == "Site | A rather long headline about things" and got[0].l == ["/x", "/b"] and got[2].t is None
    hosts = spark.createDataFrame([("A.org",)], "host string")
    assert P.trusted(df, hosts).count() == 0 and P.trusted(df, hosts.where("false")).count() == 1
