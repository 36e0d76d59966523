"""Queries over records: names, places, protection, joins and tops."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import geo, protect
from gristmill.functions import text as T
from gristmill.operators import entities as E
from gristmill.operators.timeseries import top_per_group
from gristmill.plans.registry import query, table
from gristmill.sources import gkg, readers

POINT = "(event_id * 7919 % 18001) / 100.0 - 90 AS lat, (user_id * 104729 % 36001) / 100.0 - 180 AS lon"


def _points(spark, sf_dir):
    lat, lon = (F.col("event_id") * 7919 % 18001) / 100.0 - 90, (F.col("user_id") * 104729 % 36001) / 100.0 - 180
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", lat.alias("lat"), lon.alias("lon"))


@query(f"SELECT event_id, lat, lon FROM (SELECT event_id, {POINT} FROM events) WHERE lat > 34.986544 AND lat < 71.424593 AND lon > -13.165017 AND lon < 33.633585")
def bbox_filter(spark, sf_dir):
    return _points(spark, sf_dir).where(geo.any_in_box(F.array(F.struct("lat", "lon")))).select("event_id", "lat", "lon")


@query(f"SELECT event_id, lat, lon, date FROM (SELECT event_id, CAST(ts AS DATE) AS date, {POINT} FROM events) WHERE lat > 0 AND lat < 45 AND lon > -90 AND lon < 90 AND date BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'", dates="date")
def bbox_time_filter(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("date", F.to_date("ts"))
    return readers.points_between(points, 0, 45, -90, 90, "2024-01-02", "2024-01-20").select("event_id", "lat", "lon", "date")


_LETTER = "substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({0} AS INTEGER) + 1, 1)"
_BITS = "(((x >> {0}) & 1) * {1})"


def _geohash_sql(precision: int) -> str:
    """Letters from the bits of the two cells: longitude first."""
    bits = 5 * precision
    lat, lon = bits // 2, (bits + 1) // 2
    order = [("x", lon - 1 - i // 2) if i % 2 == 0 else ("y", lat - 1 - i // 2) for i in range(bits)]
    letters = [_LETTER.format(" + ".join(f"(({n} >> {s}) & 1) * {16 >> k}" for k, (n, s) in enumerate(order[5 * j : 5 * j + 5]))) for j in range(precision)]
    cells = f"CAST(least(floor((lon + 180) / 360.0 * {1 << lon}), {(1 << lon) - 1}) AS BIGINT) AS x, CAST(least(floor((lat + 90) / 180.0 * {1 << lat}), {(1 << lat) - 1}) AS BIGINT) AS y"
    return f"SELECT event_id, {' || '.join(letters)} AS geohash FROM (SELECT event_id, {cells} FROM (SELECT event_id, {POINT} FROM events))"


@query(_geohash_sql(7))
def geohash_encode(spark, sf_dir):
    return _points(spark, sf_dir).select("event_id", geo.geohash(F.col("lat"), F.col("lon"), 7).alias("geohash"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'line' WHEN event_id % 7 = 0 THEN 'date' WHEN event_id % 3 = 0 THEN 'point' ELSE 'ok' END AS status FROM events")
def event_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    date = F.when(F.col("event_id") % 7 == 0, "2024").otherwise(F.date_format("ts", "yyyyMMdd"))
    lat = F.when(F.col("event_id") % 3 == 0, "100").otherwise("10")
    fields = F.concat_ws("\t", F.col("event_id").cast("string"), date, F.lit("\t" * 36), lat, F.lit("20"))
    lines = e.select(F.when(F.col("event_id") % 5 == 0, "short").otherwise(fields).alias("value"))
    made = readers.event_points(lines)
    return made.join(e.select("event_id"), F.col("event_id").cast("string") == F.get("fields", F.lit(0)), "right").select("event_id", F.coalesce("status", F.lit("line")).alias("status"))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S')::BIGINT AS date, event_id % 2 = 1 AS translingual, value AS tone, CAST(user_id AS INTEGER) AS words, event_type AS first_theme, 2 AS themes FROM events")
def gkg_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    blank = F.lit("")
    fields = [F.concat(stamp, F.lit("-"), F.when(F.col("event_id") % 2 == 1, "T").otherwise(""), F.lit("12")), stamp, F.lit("1"), F.lit("source"), F.col("event_id").cast("string"), blank, blank, F.concat("event_type", F.lit(";B;"))]
    fields += [blank] * 7 + [F.concat_ws(",", F.col("value").cast("string"), *[F.lit("1")] * 5, F.col("user_id").cast("string"))] + [blank] * 11
    parsed = gkg.parse(e.select(F.array_join(F.array(*fields), "\t").alias("value")))
    return parsed.select(F.col("document").cast("bigint").alias("event_id"), "record_id.date", "record_id.translingual", "tone.tone", "tone.words", F.col("themes")[0].alias("first_theme"), F.size("themes").alias("themes"))


PLACES = "SELECT c_custkey AS geo_id, c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS country, CASE c_custkey % 4 WHEN 0 THEN 'PCLI' WHEN 1 THEN 'PPLA' WHEN 2 THEN 'PPL' ELSE 'HTL' END AS feature, CAST(round(c_acctbal) AS BIGINT) AS population FROM customer"


@query(f"""WITH g AS (SELECT *, CASE feature WHEN 'PCLI' THEN 2 WHEN 'PPLA' THEN 3 ELSE 12 END AS rank FROM ({PLACES}) WHERE feature <> 'HTL')
SELECT name, geo_id, name AS place, country FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, population DESC, geo_id) AS r FROM g) WHERE r = 1""")
def geo_best(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    feature = F.element_at(F.array(*map(F.lit, ("PCLI", "PPLA", "PPL", "HTL"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    gazetteer = c.select(F.col("c_custkey").alias("geo_id"), F.col("c_mktsegment").alias("name"), F.lit(None).cast("array<string>").alias("names"), F.col("c_nationkey").cast("string").alias("country"), F.lit("").alias("admin"), feature.alias("feature"), F.round("c_acctbal").cast("bigint").alias("population"))
    return E.geo_best(c.select(F.col("c_mktsegment").alias("place")), gazetteer).drop("state")


CLEAN = "trim(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT p_name AS name, {CLEAN} AS clean, list_aggregate(list_transform(string_split({CLEAN}, ' '), lambda w: substr(w, 1, 1)), 'string_agg', '') AS short, count(*) AS n FROM part GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY short ORDER BY n DESC, name) AS r FROM n)
SELECT n.name, r.name AS preferred FROM n JOIN r ON r.short = n.short AND r.r = 1""")
def org_initials(spark, sf_dir):
    return E.dedup_organisations(table(spark, sf_dir, "part"), "p_name")


@query()
def dedup_names(spark, sf_dir):
    return E.dedup_names(table(spark, sf_dir, "part"), "p_name")


@query("""WITH own AS (SELECT DISTINCT p_brand AS doc, p_name AS name FROM part),
w AS (SELECT DISTINCT doc, name, part FROM (SELECT doc, name, unnest(string_split(name, ' ')) AS part FROM own) WHERE length(part) > 3),
s AS (SELECT doc, part, min((-length(name), name))[2] AS preferred FROM w GROUP BY 1, 2 HAVING count(*) = 2),
m AS (SELECT w.doc, w.name, min((-length(s.preferred), s.preferred))[2] AS preferred FROM w JOIN s USING (doc, part) GROUP BY 1, 2)
SELECT own.doc AS p_brand, own.name AS p_name, coalesce(m.preferred, own.name) AS preferred FROM own LEFT JOIN m USING (doc, name)""")
def context_dedup(spark, sf_dir):
    return E.context_dedup(table(spark, sf_dir, "part"), "p_brand", "p_name")


@query("""SELECT c_custkey, repeat('#', length(c_name)) AS c_name, '#' || substr(c_mktsegment, 2) AS c_mktsegment, c_nationkey, c_acctbal FROM customer""")
def obfuscate_policy(spark, sf_dir):
    return protect.apply_policy(table(spark, sf_dir, "customer"), {"c_name": "all", "c_mktsegment": "0,1"})


@query("SELECT p_partkey, repeat('#', length(p_name) - length(split_part(p_name, ' ', 2))) || split_part(p_name, ' ', 2) AS hidden_first, split_part(p_name, ' ', 1) || repeat('#', length(p_name) - length(split_part(p_name, ' ', 1))) AS hidden_last FROM part WHERE p_name LIKE '% %'")
def obfuscate_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_name").contains(" "))
    return p.select("p_partkey", protect.obfuscate(F.col("p_name"), "prefix").alias("hidden_first"), protect.obfuscate(F.col("p_name"), "suffix").alias("hidden_last"))


@query("SELECT c_custkey, ['Ann', 'Bob', 'Cy', 'Di', 'Ed'][CAST('0x' || substr(md5('salt|' || c_name), 1, 8) AS BIGINT) % 5 + 1] AS name FROM customer")
def mask_dictionary(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", protect.pick(F.col("c_name"), ["Ann", "Bob", "Cy", "Di", "Ed"], "salt").alias("name"))


@query("SELECT c_custkey, c_name, 16 + 16 * (octet_length(encode(c_name)) // 16 + 1) AS bytes, true AS fresh, true AS refused FROM customer")
def aes_roundtrip(spark, sf_dir):
    """Decrypted names; bytes has a start block and padding; each value has a start block of its own; another key doesn't give the name."""
    key, other = (F.substring(F.md5(F.lit(k)), 1, 16).cast("binary") for k in ("only for this check", "another"))
    again = protect.encrypt(F.concat("c_name", F.lit("!")), key)
    made = table(spark, sf_dir, "customer").withColumns({"hidden": protect.encrypt(F.col("c_name"), key), "again": again})
    wrong = F.try_aes_decrypt("hidden", other, F.lit("CBC"), F.lit("PKCS"))
    return made.select(
        "c_custkey", protect.decrypt(F.col("hidden"), key).alias("c_name"), F.octet_length("hidden").cast("bigint").alias("bytes"),
        F.expr("left(hidden, 16) <> left(again, 16)").alias("fresh"), (wrong.isNull() | (wrong != F.col("c_name").cast("binary"))).alias("refused"),
    )


@query("""SELECT c_custkey, n_name, r_name, coalesce(o.orders, 0) AS orders, coalesce(o.priorities, '') AS priorities FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS orders, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def left_joins_merge(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))
    out = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    out = out.join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("priorities", F.lit("")).alias("priorities"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 5")
def topk_per_group(spark, sf_dir):
    top = top_per_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 5)
    return top.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT o_custkey, max(o_totalprice) AS most, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def argbest_group(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("SELECT CAST(props::JSON->>'k' AS INTEGER) AS k, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1")
def json_fields(spark, sf_dir):
    k = F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1))
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query(f"SELECT p_partkey, {CLEAN} AS clean, substr(split_part(p_name, ' ', 1), 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1) AS initials FROM part WHERE p_name LIKE '% %'")
def name_clean(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_name").contains(" "))
    return p.select("p_partkey", T.clean_name(F.col("p_name")).alias("clean"), T.initials(F.col("p_name")).alias("initials"))
