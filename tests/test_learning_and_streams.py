"""Learned operators on separable data, and streams against their batch results."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import learning as L
from gristmill.streaming import stories, trends


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(L.cosine(F.col("a"), F.col("b")).alias("c"), L.euclidean(F.col("a"), F.col("b")).alias("d")).collect()
    assert got[0].c == 0.0 and math.isclose(got[0].d, math.sqrt(5)) and math.isclose(got[1].c, 1.0) and got[1].d == 0.0 and got[2].c is None


def corpus(spark):
    rows = []
    for i in range(60):
        a = ["sport", "game", "goal"] if i % 2 else ["bank", "money", "rates"]
        rows.append((i, " ".join(a[(i + j) % 3] for j in range(12)), ["sports"] if i % 2 else ["finance"]))
    return spark.createDataFrame(rows, "id int, text string, tags array<string>")


def test_tagger(spark):
    docs = corpus(spark)
    for idf in (False, True):
        out = L.predict_tags(L.fit_tagger(docs, idf=idf), docs.drop("tags").unionAll(spark.createDataFrame([(99, None)], "id int, text string"))).collect()
        assert all(r.tag == ("sports" if r.id % 2 else "finance") for r in out if r.id < 99)
        assert all(r.tags[0].tag == r.tag for r in out if r.id < 99)
        assert [(r.tag, r.tags) for r in out if r.id == 99] == [(None, [])]


def test_embedding_and_clusters(spark):
    docs = corpus(spark).unionAll(spark.createDataFrame([(100, None, None), (101, "", None)], "id int, text string, tags array<string>"))
    made = L.embed(docs, "id", "text", 64)
    rows = {r.id: np.array(r.vector) for r in made.collect()}
    assert not rows[100].any() and not rows[101].any() and math.isclose(np.linalg.norm(rows[3]), 1, rel_tol=1e-5)
    assert rows[1] @ rows[3] > 0.8 > rows[1] @ rows[2]
    _, placed = L.cluster(made.where("id < 60"), "vector", 2)
    sides = {(r.id % 2, r.cluster) for r in placed.collect()}
    assert len(sides) == 2
    odd = L.anomalies(spark.createDataFrame([(i, 1.0, 1.0, None) for i in range(20)] + [(i, 9.0, 0.0, 0.0) for i in range(20, 40)] + [(99, 1.0, 1.0, 0.5)], "id int, a double, b double, c double"), ["a", "b", "c"], k=2)
    assert max(odd.collect(), key=lambda r: r.score).id == 99


def test_word_vectors(spark):
    model = L.word_vectors(corpus(spark), size=8, least=1)
    graph = L.synonym_graph(L.vectors_of(model), spark.createDataFrame([("game",), ("bank",)], "word string"), 2).collect()
    for w in ("game", "bank"):
        assert math.isclose(sum(r.weight for r in graph if r.src == w), 1.0)
    assert L.analogy(model, ["game", "bank"], ["money"], 2).count() == 2
    scores = L.anchor_scores(corpus(spark).select("id", F.split("text", " ").alias("w")), "id", "w", L.vectors_of(model), spark.createDataFrame([("game",)], "anchor string"))
    assert scores.count() == 60


def test_decayed_update():
    c, w = L.decayed_update(np.array([[0.0], [5.0]]), np.array([2.0, 1.0]), np.array([[4.0], [0.0]]), np.array([1.0, 0.0]), 1.0)
    assert c.tolist() == [[2.0], [5.0]] and w.tolist() == [2.0, 0.5]


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(base + datetime.timedelta(minutes=7 * i), f"k{i % 3}") for i in range(100)]
    df = spark.createDataFrame(rows, "ts timestamp, key string")
    df.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    counted = trends.trend_counts(stream, "ts", "key", "2 hours", "1 hour")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = trends.trend_counts(df, "ts", "key", "2 hours", "1 hour")
    assert sorted(map(tuple, spark.sql("SELECT * FROM counted").collect())) == sorted(map(tuple, want.collect()))
    assert trends.top_keys(want, 2).count() == 2


def test_tagger_stream(spark, tmp_path):
    tagger = trends.TrendTagger(spark, f"file://{tmp_path}/tagger", least_words=5)
    docs = corpus(spark).select(F.concat(F.lit("u"), "id").alias("url"), F.col("text").alias("body"), "tags", F.lit(datetime.datetime(2024, 1, 1)).alias("time"))
    unseen = docs.select("url", F.repeat(F.concat("body", F.lit(" ")), 6).alias("body"))
    tagger.tag(unseen, 0)
    assert {tuple(r.tags) for r in spark.read.parquet(f"{tmp_path}/tagger/tagged/batch=0").collect()} == {()}
    docs.write.parquet(f"{tmp_path}/in")
    q = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(tagger.learn).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    tagger.tag(unseen, 1)
    got = spark.read.parquet(f"{tmp_path}/tagger/tagged/batch=1").collect()
    assert len(got) == 60 and all(r.tag == ("sports" if int(r.url[1:]) % 2 else "finance") for r in got)


def test_links(spark):
    df = spark.createDataFrame([("see http://x.org #Breaking #ab", ), ("http://x.org #budget", ), (None, )], "body string")
    assert [tuple(r) for r in trends.linked_tags(df).collect()] == [("http://x.org", ["#breaking", "#budget"])]


@pytest.mark.parametrize("again", [False, True])
def test_story_stream(spark, tmp_path, again):
    s = stories.StoryClusters(spark, f"file://{tmp_path}/s", k=2, size=2, entities=("persons",))
    day = datetime.date(2024, 1, 1)
    rows = lambda n: [(f"u{n}-{i}", f"t{i}", day, float(i), [float(i % 2 * 10), 0.1 * i], ["ann", "bob"] if i % 2 else ["cy"]) for i in range(8)]
    schema = "url string, title string, date date, tone double, vector array<double>, persons array<string>"
    for n in range(2 + again):
        n = min(n, 1)
        s.step(spark.createDataFrame(rows(n), schema), n)
    out = {r.story: r for r in spark.read.parquet(f"{tmp_path}/s/stories/batch=1").collect()}
    assert sorted(out) == [2, 3] and all(r.articles == 4 for r in out.values())
    assert {tuple(r.persons) for r in out.values()} == {("ann", "bob"), ("cy",)}
    moved = spark.read.parquet(f"{tmp_path}/s/drift/batch=1").collect()
    assert sum(r.n for r in moved) == 8 and {r.source for r in moved} <= {0, 1} and {r.target for r in moved} == {2, 3}


def test_most_similar_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(f"w{'x' * (i % 20)}{i}", v.tolist()) for i, v in enumerate(x)], "word string, vector array<double>")
    rows = lambda b: sorted((r.src, r.dst, round(r.similarity, 9)) for r in L.most_similar(df, df.where("word LIKE '%7'"), 4, block=b).collect())
    assert rows(8192) == rows(40) and len(rows(40)) == 4 * 30


def test_direction_of_prices(spark):
    rows = [(i, "up gain strong" if i % 3 else "down loss weak", float(i % 3 > 0)) for i in range(200)] + [(900, None, 1.0), (901, "up", None)]
    weeks = spark.createDataFrame(rows, "common_friday int, text string, direction double")
    _, made, accuracy = L.predict_direction(weeks)
    assert accuracy == 1.0 and 50 < made.count() < 110
    a, b = L.split_by_hash(weeks, "common_friday")
    assert a.count() + b.count() == 202 and a.join(b, "common_friday").count() == 0


def test_embedding_of_long_texts_in_parts(spark, monkeypatch):
    """Parts of a batch give the vectors of the whole batch; a long text is a part of its own."""
    docs = spark.createDataFrame([(1, "a b c a"), (2, None), (3, "d"), (4, ""), (5, "a b c d e f g h"), (6, "b a")], "id long, text string").coalesce(1)
    whole = {r.id: r.vector for r in L.embed(docs, "id", "text", 32).collect()}
    monkeypatch.setattr(L, "WORDS_AT_ONCE", 4)
    assert {r.id: r.vector for r in L.embed(docs, "id", "text", 32).collect()} == whole
    assert L._parts([4, 0, 1, 0, 8, 2], 4) == [(0, 2), (2, 4), (4, 5), (5, 6)] and L._parts([], 4) == []
