"""Column functions on single values, with their conventions for null and odd ones."""

import datetime

import pytest
from pyspark.sql import functions as F

from gristmill.functions import geo, masks, protect, simhash
from gristmill.functions import text as T
from gristmill.operators import profile
from gristmill.operators import timeseries as ts
from gristmill.storage import shared_root


@pytest.fixture(scope="module")
def one(spark):
    base = spark.range(1)
    return lambda column: base.select(column.alias("x")).first().x


def test_masks(one):
    assert one(masks.low_grain(F.lit("ABC-12 de\t\t"))) == "A-9 aT" and one(masks.high_grain(F.lit("ABC-12"))) == "AAA-99"
    assert [one(masks.pop_check(F.lit(v))) for v in (None, "", "  ", "x")] == ["0", "0", "0", "1"]
    assert one(masks.class_masks(F.lit("aB7 漢\x01-"))) == ["a", "A", "9", "T", "J", "^", "U"]
    assert one(masks.hex_mask(F.lit("aé"))) == ["61", "C3A9"] and one(masks.unicode_mask(F.lit("a"))) == ["U+0061"]
    assert one(masks.class_masks(F.lit(None).cast("string"))) == []


def test_geohash(one):
    assert one(geo.geohash(F.lit(57.64911), F.lit(10.40744), 11)) == "u4pruydqqvj" and one(geo.geohash(F.lit(42.6), F.lit(-5.6), 5)) == "ezs42"
    assert one(geo.geohash(F.lit(None).cast("double"), F.lit(1.0))) is None and one(geo.geohash(F.lit(90.0), F.lit(180.0), 4)) == "zzzz"
    p = one(geo.decode_geohash(F.lit("ezs42")))
    assert abs(p.lat - 42.605) < 0.001 and abs(p.lon + 5.603) < 0.001
    with pytest.raises(Exception, match="out of range"):
        one(geo.geohash(F.lit(91.0), F.lit(0.0)))


def test_protection(one):
    hide = lambda v, rule: one(protect.obfuscate(F.lit(v), rule))
    assert hide("12 High St", "0,1") == "#2 High St" and hide("abcdef", "2,len") == "ab####" and hide("ab", "5,9") == "ab" and hide("SW1 4AB", "prefix") == "####4AB"
    assert hide("SW14AB", "prefix") == "SW14AB" and hide("a b c", "suffix") == "a b##" and hide("abc", "all") == "###" and hide("abc", "none") == "abc" and hide("", "all") == ""
    assert one(protect.obfuscate(F.lit(None).cast("string"), "all")) is None
    assert one(protect.pick(F.lit("x"), ["a", "b"], "s")) == one(protect.pick(F.lit("x"), ["a", "b"], "s")) and one(protect.pick(F.lit(None).cast("string"), ["a"])) is None
    card = one(protect.digits(F.lit("x"), "9999-99"))
    assert card[4] == "-" and card.replace("-", "").isdigit() and len(card) == 7


def test_mixed_policy(spark):
    df = spark.createDataFrame([("Ann", "Lee", "1 St", "Town", "AB1 2CD", "01 234", "1 2 3")], "first_name string, surname string, address string, city string, postcode string, phone string, card string")
    hidden = protect.apply_policy(df, protect.OBFUSCATE_ALL).first()
    assert tuple(hidden) == ("Ann", "###", "# St", "Town", "####2CD", "###234", "####3")
    mixed = protect.mix_policy(df, ["Bo"], ["2 Rd"], ["ZZ9"]).first()
    assert (mixed.first_name, mixed.surname, mixed.address, mixed.city, mixed.postcode, mixed.phone) == ("Bo", "###", "2 Rd", "####", "ZZ9", "###234")


def test_text(one):
    assert one(T.clean_place(F.lit("São  Tomé-St. X"))) == "sao tome st x" and one(T.clean_name(F.lit("Dr JohnÖ O'Neil"))) == "john o o neil"
    assert one(T.initials(F.lit("World Trade Forum"))) == "WTF" and one(T.initials(F.lit("Acme"))) == "Acme"
    assert one(T.clean_tweet(F.lit("RT @bob: Sooooo GOOD!! :smile: http://x.y/z #Fün"))) == "soo good fun"
    assert one(T.hashtags(F.lit("#Économie #ab #x1 ok"))) == ["#economie"] and one(T.emoji_codes(F.lit("a :joy: b :sad_face:"))) == ["joy", "sad_face"]
    assert one(T.emoji_tone(F.array(F.lit("joy"), F.lit("rage"), F.lit("zzz")))) == 0.5 and one(T.emoji_tone(F.array(F.lit("zzz")))) is None
    assert one(T.clean_url(F.lit("http://a.b/#!x"))) == "http://a.b/?_escaped_fragment_=x" and one(T.clean_url(F.lit("http://a.b/?q#f"))) == "http://a.b/?q"
    assert one(T.host(F.lit("http://a.b:8/c"))) == "a.b" and one(T.host(F.lit("::nonsense"))) is None
    assert one(T.day_month_year(F.lit("31/12/2015"))) == datetime.date(2015, 12, 31) and one(T.day_month_year(F.lit("2015"))) is None
    assert one(T.lenient_time(F.lit("2015-01-02T03:04:05Z"))) is not None and one(T.lenient_time(F.lit("2015-01-02"))) is not None and one(T.lenient_time(F.lit("x"))) is None
    assert one(T.tokens(F.lit("The quick Brown-fox this 1234"))) == ["quick", "brown"]


def test_simhash(spark, one):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "word"), (4, ""), (5, None)]
    got = {r.id: r.simhash for r in simhash.simhash(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got[1] == got[2] and set(got) == {1, 2, 3, 4} and all(0 <= v < 2**32 for v in got.values())
    assert len(simhash.masks()) == 529 == len(set(simhash.masks())) and one(simhash.bit_string(F.lit(5))) == "0" * 29 + "101"
    hashes = spark.createDataFrame([(i, h) for i, h in enumerate([0, 1, 0b11, 0b11111, 0xFFFFFFFF, 0])], "id long, simhash long")
    pairs = {(r.a, r.b): r.distance for r in simhash.near_pairs(hashes, 4).collect()}
    assert pairs == {(0, 1): 1, (0, 2): 2, (0, 5): 0, (1, 2): 1, (1, 3): 4, (1, 5): 1, (2, 3): 3, (2, 5): 2}


def test_bars_with_ties(spark):
    d = lambda n: datetime.date(2024, 1, n)
    rows = [(d(1), 5.0), (d(2), 9.0), (d(3), 9.0), (d(4), 1.0), (d(5), 1.0), (d(8), 4.0), (d(9), None)]
    bars = ts.weekly_high_low(spark.createDataFrame(rows, "date date, price double")).orderBy("week").collect()
    assert (bars[0].high_date, bars[0].low_date, bars[0].first_price, bars[0].second_price) == (d(2), d(5), 9.0, 1.0)
    assert (bars[1].high, bars[1].low, bars[1].first_price) == (4.0, 4.0, 4.0) and len(bars) == 2
    trended = ts.trend(ts.weekly_high_low(spark.createDataFrame(rows, "date date, price double"))).orderBy("week").collect()
    assert [r.sign for r in trended] == [None, 0]


def test_profiles(spark):
    df = spark.createDataFrame([("1", "x", "", "a"), ("2", "x", None, "a"), ("3", "x", "", "b"), ("4", "x", "", None)], "id string, c string, e string, g string")
    cells = profile.cells(df)
    assert sorted((r.idx, r.ratio) for r in profile.emptiness(cells).collect()) == [(0, 0.0), (1, 0.0), (2, 1.0), (3, 0.25)]
    assert sorted((r.idx, r.ratio) for r in profile.cardinality(cells).collect()) == [(0, 1.0), (1, 0.25), (2, 0.25), (3, 0.75)]
    lines = spark.createDataFrame([("a,b,c,d",), ("x,y",), ("p,q,r,s",)], "value string")
    assert sorted(tuple(r) for r in profile.field_counts(lines).collect()) == [(2, 1, "x,y"), (4, 2, "a,b,c,d")]


def test_shared_root_is_the_sessions(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is None:
        assert shared_root(spark) == shared_root(spark)


def test_weighted_simhash_and_stars(spark):
    from gristmill.functions import simhash as S
    from gristmill.operators.components import connected_components

    texts = ["a b c d e f"] * 5 + ["a b c d e g", "z y x w", "one", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    h = S.simhash(df, "id", "t")
    assert h.count() == 9 and h.where("id < 5").select("simhash").distinct().count() == 1
    groups = lambda **k: sorted((r.id, r.component) for r in connected_components(S.near_pairs(h, 4, **k), "a", "b").collect())
    assert groups() == groups(stars=True) == groups(agree=5)
    assert {r.id for r in S.near_hash(h, h.where("id = 0").first().simhash, 0).collect()} >= {0, 1, 2, 3, 4}


def test_report_reads_its_table_once(spark, tmp_path):
    from gristmill.operators import profile

    spark.range(3).selectExpr("id", "concat('v', id) AS t").write.parquet(f"{tmp_path}/t")
    counted = []
    own, profile.written = profile.written, lambda df, purpose: counted.append(df) or own(df, purpose)
    try:
        made = profile.report(spark.read.parquet(f"{tmp_path}/t"), "t", "2024-01-01")
    finally:
        profile.written = own
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert len(counted) == 1 and f"{tmp_path}/t" not in plan and made.where("metric = 'row.count'").first().value == 3
    empty = profile.report(spark.createDataFrame([], "a string"), "t", "2024-01-01")
    assert [(r.metric, r.value) for r in empty.collect()] == [("row.count", 0.0)]


@pytest.mark.parametrize("stars", [False, True])
def test_near_pairs_broadcasts_no_buckets(spark, tmp_path, stars):
    """Small files of hashes make 35 rows and more of each: broadcast, they filled the driver."""
    rows = [(0, 0b1010), (1, 0b1011), (2, 0b1010)]
    spark.createDataFrame(rows, "id long, simhash long").write.parquet(f"{tmp_path}/hashes")
    pairs = simhash.near_pairs(spark.read.parquet(f"{tmp_path}/hashes"), 4, stars=stars)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b) for r in pairs.collect()} == ({(0, 1), (0, 2)} if stars else {(0, 1), (0, 2), (1, 2)})


def test_profiles_in_bounded_tasks(spark, monkeypatch):
    """Rows are spread before they are exploded; a frequent mask's values aren't sorted in one task."""
    from gristmill import storage

    df = spark.createDataFrame([(f"a{i % 37:03}", f"b{i % 5}") for i in range(400)], "x string, y string")
    spread, whole = [], [profile.mask_histogram(profile.cells(df), "field.ascii.low").collect(), profile.report(df, "t", "2024-01-01").collect(), profile.cardinality(profile.cells(df)).collect()]
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 100)
    own, profile.written = profile.written, lambda df, purpose: spread.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, purpose)
    try:
        masks_made = profile.mask_histogram(profile.cells(df), "field.ascii.low")
        made = [masks_made, profile.report(df, "t", "2024-01-01"), profile.cardinality(profile.cells(df))]
    finally:
        profile.written = own
    assert "64), REPARTITION_BY_NUM" in spread[0] and "64), REPARTITION_BY_NUM" in spread[1]
    assert "WindowGroupLimit" in masks_made._jdf.queryExecution().executedPlan().toString()
    for got, want in zip(made, whole):
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want)) and want
