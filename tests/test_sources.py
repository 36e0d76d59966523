"""Parsers and writers on lines written for the purpose."""

import datetime

from pyspark.sql import functions as F

from gristmill.sources import gkg, readers, sinks


def record(**fields):
    row = [""] * 27
    for name, value in fields.items():
        row[int(name[1:]) - 1] = value
    return "\t".join(row)


def test_gkg_record(spark):
    line = record(
        f1="20240102030405-T17", f2="20240102030405", f3="1", f4="example.org", f5="http://example.org/a", f6="KILL#3##1#Here#FD#FD01#1.5#2.5#99", f8="A;B;", f9="A,12;B,40",
        f10="1#Here#FD#FD01#1.5#2.5#99", f11="1#Here#FD#FD01#ADM2#1.5#2.5#99#77;short#one", f12="ann lee", f13="Ann Lee,5", f16="-1.5,2,3.5,5.5,20,1,300", f17="1,2,3,2024,9", f18="wc:300,c1.2:x",
        f23="10|20|said|hello", f25="5,million dollars,8", f26="srclc:fra;eng:E1", f27="<X/>",
    )
    df = spark.createDataFrame([(line,), ("too\tshort",), (None,), (record(f1="20240102030405-12"),)], "value string")
    good, short, null, plain = gkg.parse(df).collect()
    assert good.valid and tuple(good.record_id) == (20240102030405, True, 17) and good.date == 20240102030405
    assert good.counts[0].type == "KILL" and good.counts[0]["count"] == 3 and good.counts[0].location.name == "Here" and good.counts[0].location.lon == 2.5
    assert good.themes == ["A", "B"] and [tuple(t) for t in good.enhanced_themes] == [("A", 12), ("B", 40)]
    assert good.enhanced_locations[0].adm2 == "ADM2" and good.enhanced_locations[0].offset == 77 and good.enhanced_locations[0].location.lat == 1.5
    assert good.enhanced_locations[1].location.name is None
    assert good.tone.tone == -1.5 and good.tone.words == 300 and tuple(good.dates[0]) == (1, 2, 3, 2024, 9)
    assert [tuple(s) for s in good.gcam] == [("wc", 300.0), ("c1.2", None)]
    assert tuple(good.quotations[0]) == (10, 20, "said", "hello") and tuple(good.amounts[0]) == (5.0, "million dollars", 8)
    assert not short.valid and short.themes == [] and short.record_id.date is None and not null.valid
    assert tuple(plain.record_id) == (20240102030405, False, 12)  # no T: not translingual, whatever the number's length


def test_event_points(spark):
    def line(date, lat, lon, n=45):
        row = [""] * n
        row[1:2] = [date]
        if n > 40:
            row[39], row[40] = lat, lon
        return "\t".join(row)

    rows = [line("20240102", "10", "20"), line("2024", "10", "20"), line("20240102", "100", "20"), line("20240102", "", "20"), line("20240102", "1", "2", 10), None]
    got = readers.event_points(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert [r.status for r in got.collect()] == ["ok", "date", "point", "point", "line", "line"]
    assert readers.points_between(got.where("status = 'ok'"), 0, 50, 0, 50, "2024-01-01", "2024-01-03").count() == 1
    assert readers.points_between(got.where("status = 'ok'"), 0, 50, 30, 50, "2024-01-01", "2024-01-03").count() == 0


def test_fields_posts_and_messages(spark):
    df = spark.createDataFrame([('a,"b,c",,"d ""e"""',), ("x",), (None,)], "value string")
    assert [r.fields for r in readers.split_fields(df).collect()] == [["a", "b,c", "", 'd "e"'], ["x"], None]
    lines = spark.createDataFrame([('  <row Id="5" Body="&lt;p&gt;How to &lt;b&gt;join&lt;/b&gt;?&lt;/p&gt;" Tags="&lt;sql&gt;&lt;spark&gt;" />',), ("<posts>",)], "value string")
    assert [tuple(r) for r in readers.posts(lines).collect()] == [(5, "How to join ?", ["sql", "spark"])]
    tweets = spark.createDataFrame([('{"created_at": "Wed Aug 27 13:08:45 +0000 2008", "text": "one two three four five six", "lang": "en", "user": {"location": "TX"}, "entities": {"hashtags": [{"text": "Big"}]}}',), ("{}",), ("junk",)], "value string")
    parsed = readers.messages(tweets)
    first, empty, junk = parsed.collect()
    assert first.time == datetime.datetime(2008, 8, 27, 13, 8, 45) and first.tags == ["big"] and first.location == "TX"
    assert empty.body == junk.body == "" and empty.tags == [] and empty.time is None
    assert readers.english_messages(parsed).count() == 1


def test_gazetteer_and_actions(spark):
    places = spark.createDataFrame([(1, "Here", "b, a,b,", "PPLC", "FD", "01", 10, "Europe/X", 1.0, 2.0), (2, "Inn", None, "HTL", "FD", "01", 1, "", 1.0, 2.0), (3, "Far", None, "PPL", "XX", "09", 1, None, 1.0, 2.0)], "geo_id long, name string, names string, feature string, country string, admin1 string, population long, timezone string, lat double, lon double")
    got = {r.geo_id: (r.names, r.admin, r.timezone) for r in readers.gazetteer(places, spark.createDataFrame([("FD.01", "North")], "code string, state string")).collect()}
    assert got == {1: (["b", "a"], "North", ["Europe/X"]), 3: ([], "", None)}
    events = spark.createDataFrame([("United States", "010", "Police"), ("A", "999", None)], "actor1 string, code string, actor2 string")
    out = readers.actions(events, spark.createDataFrame([("010", "Make statement")], "code string, text string"))
    assert sorted(r.sentence for r in out.collect()) == ["a 999", "united_states make_statement police"]
    assert readers.nicknames([("William", "Bill")]) == {"PL": {"ALM"}}


def test_visibility(spark):
    df = spark.createDataFrame([("a", "b", 1, ""), ("a", "b", 2, None), ("a", "c", 5, "SECRET"), ("a", "d", 1, "X&Y|SECRET"), ("a", "e", 1, "X&Y")], "src string, dst string, count int, visibility string")
    assert sorted((r.dst, r["count"]) for r in readers.edges_with_labels(df, ["SECRET"]).collect()) == [("b", 3), ("c", 5), ("d", 1)]
    assert sorted(r.dst for r in readers.edges_with_labels(df, []).collect()) == ["b"]
    assert [r.visibility for r in sinks.with_visibility(df.drop("visibility").where("dst = 'c'"), ["c"]).collect()] == ["SECRET"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    sinks.upsert(df, f"{tmp_path}/t", ["id"], 1)
    sinks.upsert(df.withColumn("x", F.upper("x")).where("id = 1"), f"{tmp_path}/t", ["id"], 2)
    assert sorted((r.id, r.x) for r in readers.latest(spark.read.parquet(f"{tmp_path}/t"), ["id"], "version").collect()) == [(1, "A"), (2, "b")]
    key = F.lit(b"0123456789abcdef")
    hidden = sinks.encrypted(df, "x", key)
    assert {r.x for r in hidden.collect()}.isdisjoint({"a", "b"})
    assert sorted(r.x for r in sinks.decrypted(hidden, "x", key).collect()) == ["a", "b"]
    sinks.single_text(df, f"{tmp_path}/one", "x")
    assert spark.read.text(f"{tmp_path}/one").count() == 2
    sinks.write_table(df, f"{tmp_path}/csv", "csv")
    assert readers.delimited(spark, f"{tmp_path}/csv", "id int, x string", header=True).count() == 2
    points = spark.createDataFrame([(10.0, 20.0), (None, 1.0)], "lat double, lon double")
    sinks.by_geohash(points, f"{tmp_path}/geo")
    assert spark.read.parquet(f"{tmp_path}/geo").count() == 1
    stamped = spark.createDataFrame([(datetime.datetime(2024, 1, 1),), (datetime.datetime(2024, 1, 5),)], "t timestamp")
    assert sinks.not_expired(sinks.with_expiry(stamped, "t"), F.lit(datetime.datetime(2024, 1, 4))).count() == 1
    (tmp_path / "in").mkdir()
    for n in ("20240102030405.export.CSV", "other.CSV"):
        (tmp_path / "in" / n).write_text("x")
    assert [r.time for r in readers.timed_files(spark, f"{tmp_path}/in").collect()] == [datetime.datetime(2024, 1, 2, 3, 4, 5)]
