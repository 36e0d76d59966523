"""The enrichment plan on two pages, stems, sentiment and joined streams."""

import datetime

from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.plans import enrichment as N

BODY = "It was said that Mary Jones of the Acme Corp was in Springfield and in Freedonia when all of this was over."


def test_stems_and_sentiment(spark):
    words = ["cities", "running", "stopped", "boxes", "glass", "king", "bed", "bus", "John's", "plays", None]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.stem(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == ["city", "run", "stop", "box", "glass", "king", "bed", "bus", "john", "play", None]
    rows = [("Good great day. Bad.",), ("",), (None,), ("Plain words here.",), ("Hate war crisis fear!",)]
    assert [r.s for r in spark.createDataFrame(rows, "t string").select(T.sentiment(F.col("t")).alias("s")).collect()] == [2.5, 2.0, 2.0, 2.0, 0.0]
    assert spark.range(1).select(T.stems(F.lit("The running foxes and cities")).alias("s")).first().s == ["run", "fox", "city"]


def test_enrich(spark):
    gazetteer = spark.createDataFrame(
        [(1, "Freedonia", None, "FD", "", "PCLI", 9, ["Europe/F"]), (2, "Springfield", None, "FD", "N", "PPL", 1, ["Europe/F"]), (3, "Springfield", None, "SY", "E", "PPL", 99, ["Asia/S"])],
        "geo_id long, name string, names array<string>, country string, admin string, feature string, population long, timezone array<string>",
    )
    pages = spark.createDataFrame([(1, "http://a.org/1", f"<title>One</title><body><div><p>{BODY}</p></div></body>"), (2, "http://a.org/2", None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in N.enrich(pages, gazetteer, ["Mary"], ["Springfield", "Freedonia"]).collect()}
    assert rows[1].person == ["Mary Jones"] and rows[1].organization == ["Acme Corp"] and rows[1].location == ["Freedonia", "Springfield"] and rows[1].sentiment == 2.0
    assert rows[2].person == rows[2].organization == rows[2].location == [] and rows[2].title is None


def test_enrich_parses_each_page_once(spark, monkeypatch):
    """In as many tasks as the pages ask for; the result reads the written articles."""
    monkeypatch.setattr(N, "PAGES_PER_TASK", 2)
    gazetteer = spark.createDataFrame([(1, "Freedonia", None, "FD", "", "PCLI", 9)], "geo_id long, name string, names array<string>, country string, admin string, feature string, population long")
    pages = spark.createDataFrame([(k, f"http://a.org/{k}", f"<title>P{k}</title><body><div><p>{BODY}</p></div></body>") for k in range(7)], "page_id long, url string, html string")
    made = N.enrich(pages, gazetteer, ["Mary"], ["Freedonia"])
    assert "article(" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.page_id, *r.person, *r.organization, *r.location) for r in made.collect()) == [(k, "Mary Jones", "Acme Corp", "Freedonia") for k in range(7)]
    assert sum(1 for f in made.inputFiles() if "/articles-" in f) >= 3


def test_source_urls(spark):
    df = spark.createDataFrame([("1\tx\thttp://a",), ("2\thttp://a",), ("3\tnone",), (None,)], "value string")
    assert [r.url for r in N.source_urls(df).collect()] == ["http://a"]


def test_joined_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    a = spark.createDataFrame([("u1", t, 1), ("u2", t, 2)], "url string, time timestamp, a int")
    b = spark.createDataFrame([("u1", t + datetime.timedelta(minutes=5), 10), ("u2", t + datetime.timedelta(hours=5), 20)], "url string, time timestamp, b int")
    want = [(r.url, r.a, r.b) for r in N.joined_streams(a, b).collect()]
    assert want == [("u1", 1, 10)]
    a.write.parquet(f"{tmp_path}/a")
    b.write.parquet(f"{tmp_path}/b")
    met = N.joined_streams(spark.readStream.schema(a.schema).parquet(f"{tmp_path}/a"), spark.readStream.schema(b.schema).parquet(f"{tmp_path}/b"))
    q = met.writeStream.format("memory").queryName("met").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.url, r.a, r.b) for r in spark.sql("SELECT * FROM met").collect()] == want
