"""Queries that write a table in some form, read it again with a reader, and give what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import geo, protect
from gristmill.operators import timeseries as ts
from gristmill.plans.registry import query, table
from gristmill.sources import readers, sinks
from gristmill.storage import new_folder


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_typed(spark, sf_dir):
    """Types are found in the data."""
    path = new_folder(spark, "csv")
    sinks.write_table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "csv")
    found = readers.delimited(spark, path, header=True)
    assert dict(found.dtypes)["n_nationkey"] == "int"
    return found.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey"))


@query("SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS label, p_size FROM part")
def csv_quoted(spark, sf_dir):
    """Values with delimiters and quotes, read with a schema."""
    path = new_folder(spark, "csv")
    label = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    made = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), "p_size")
    made.write.option("escape", '"').csv(path)
    return readers.delimited(spark, path, "p_partkey bigint, label string, p_size int")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def converted_formats(spark, sf_dir):
    """Parquet to JSON, JSON to ORC, in folders by segment."""
    a, b = new_folder(spark, "json"), new_folder(spark, "orc")
    kept = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    sinks.write_table(kept, a, "json", by=["c_mktsegment"])
    sinks.convert(spark, a, b, "json", "orc")
    return spark.read.orc(b).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("SELECT p_partkey, p_name || ',' || p_brand AS both, p_type AS last FROM part")
def quoted_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lines = p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), "p_name", F.lit(","), "p_brand", F.lit('",'), "p_type").alias("value"))
    f = readers.split_fields(lines)
    return f.select(F.col("fields")[0].cast("bigint").alias("p_partkey"), F.col("fields")[1].alias("both"), F.col("fields")[2].alias("last"))


@query("SELECT p_partkey AS id, 'A ' || p_name || ' < ' || p_type AS body, lower(p_type) || ',' || replace(p_brand, '#', '') AS tags FROM part")
def posts_read(spark, sf_dir):
    """Lines of attributes with escaped bodies and tags."""
    p = table(spark, sf_dir, "part")
    body = F.concat(F.lit("&lt;p&gt;A "), "p_name", F.lit("&lt;/p&gt; &lt; "), "p_type")
    tags = F.concat(F.lit("&lt;"), F.lower("p_type"), F.lit("&gt;&lt;"), F.regexp_replace("p_brand", "#", ""), F.lit("&gt;"))
    line = F.concat(F.lit('  <row Id="'), F.col("p_partkey").cast("string"), F.lit('" Body="'), body, F.lit('" Tags="'), tags, F.lit('" />'))
    found = readers.posts(p.select(F.explode(F.array(line, F.lit("<posts>"))).alias("value")))
    return found.select("id", "body", F.array_join("tags", ",").alias("tags"))


@query("SELECT event_id, date_trunc('second', ts) AS time, event_type || ' of user ' || user_id AS body, 'en' AS lang, lower(event_type) AS tag FROM events")
def messages_read(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = F.to_json(
        F.struct(
            F.date_format("ts", "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at"), F.concat("event_type", F.lit(" of user "), "user_id").alias("text"), F.lit("en").alias("lang"),
            F.struct(F.col("event_id").cast("string").alias("location")).alias("user"), F.struct(F.array(F.struct(F.upper("event_type").alias("text"))).alias("hashtags")).alias("entities"),
        )
    )
    found = readers.messages(e.select(made.alias("value")))
    return found.select(F.col("location").cast("bigint").alias("event_id"), "time", "body", "lang", F.col("tags")[0].alias("tag"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey BETWEEN 10 AND 60")
def index_dump(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus")).alias("value"))
    return readers.search_documents(lines, "o_orderkey bigint, o_custkey bigint, o_orderstatus string", {"o_orderstatus": "F", "o_custkey": (10, 60)})


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'supplier_' || l_suppkey || ' ' || CASE l_returnflag WHEN 'A' THEN 'takes_back' WHEN 'R' THEN 'returns' ELSE 'n' END || ' order_' || l_orderkey AS sentence FROM lineitem")
def action_sentences(spark, sf_dir):
    codes = spark.createDataFrame([("A", "Takes  back"), ("R", "Returns")], "code string, text string")
    li = table(spark, sf_dir, "lineitem").withColumns({"actor1": F.concat(F.lit("Supplier "), "l_suppkey"), "actor2": F.concat(F.lit("Order "), "l_orderkey"), "code": F.col("l_returnflag")})
    return readers.actions(li, codes).select("l_orderkey", "l_linenumber", "l_partkey", "sentence")


@query("SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS count FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey NOT IN (3, 7) AND c_nationkey NOT IN (3, 7) GROUP BY 1, 2")
def visible_edges(spark, sf_dir):
    """Edges with a nation of the blacklist are labelled, and a reader without that label doesn't see them."""
    t = lambda n: table(spark, sf_dir, n)
    met = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    edges = met.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.lit(1).cast("bigint").alias("count"))
    return readers.edges_with_labels(sinks.with_visibility(edges, [3, 7]), ["PUBLIC"])


@query("SELECT user_id, max(event_id) AS event_id, CAST(count(*) > 0 AS BOOLEAN) AS found FROM events WHERE event_id % 10 < 5 GROUP BY 1")
def upserted_rows(spark, sf_dir):
    """Five versions, the last written twice: every key reads as its newest row."""
    path = new_folder(spark, "upserts")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").where("event_id % 10 < 5")
    newest = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("e")).select("user_id", "e.*")
    old = e.groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type"), "event_id").alias("e")).select("user_id", "e.*")
    for version in range(1, 4):
        sinks.upsert(old, path, ["user_id"], version)
    for rows in (old, newest):
        sinks.upsert(rows, path, ["user_id"], 4)
    return readers.latest(spark.read.parquet(path), ["user_id"], "version").select("user_id", "event_id", F.lit(True).alias("found"))


@query("SELECT event_id, ts + INTERVAL 48 HOUR AS expires_at FROM events WHERE ts + INTERVAL 48 HOUR > TIMESTAMP '2024-01-15 00:00:00'")
def unexpired_events(spark, sf_dir):
    e = sinks.with_expiry(table(spark, sf_dir, "events").select("event_id", "ts"), "ts")
    return sinks.not_expired(e, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "expires_at")


@query("SELECT event_type AS name, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE event_type LIKE 'p%' GROUP BY 1")
def metrics_by_prefix(spark, sf_dir):
    """Metrics sorted for a series store, written, and read by the beginning of their name."""
    path = new_folder(spark, "metrics")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("ts").alias("time"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    sinks.metric_order(e).write.parquet(path)
    return readers.metrics_with_prefix(spark.read.parquet(path), "p").groupBy("name").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("SELECT c_custkey, c_name, 2 * (16 + 16 * (octet_length(encode(c_name)) // 16 + 1)) AS digits FROM customer")
def encrypted_texts(spark, sf_dir):
    """Text files of encrypted values: a start block of 16 bytes and the padding come with each."""
    path = new_folder(spark, "encrypted")
    key = F.substring(F.md5(F.lit("only for this check")), 1, 16).cast("binary")
    hidden = sinks.encrypted(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", key)
    sinks.single_text(hidden, path, F.concat_ws(" ", "c_custkey", "c_name"))
    f = F.split("value", " ")
    back = readers.text_lines(spark, path).select(f[0].cast("bigint").alias("c_custkey"), f[1].alias("c_name"), F.length(f[1]).cast("bigint").alias("digits"))
    return sinks.decrypted(back, "c_name", key)


@query("SELECT count(*) AS points, count(DISTINCT event_id) AS ids, true AS within FROM events")
def geohash_folders(spark, sf_dir):
    """Folders by area hold every point once, and each point's area is that of its position."""
    path = new_folder(spark, "areas")
    e = table(spark, sf_dir, "events")
    lat, lon = (F.col("event_id") * 7919 % 18001) / 100.0 - 90, (F.col("user_id") * 104729 % 36001) / 100.0 - 180
    sinks.by_geohash(e.select("event_id", lat.alias("lat"), lon.alias("lon")), path)
    back = spark.read.parquet(path)
    own = F.col("area") == geo.geohash(F.col("lat"), F.col("lon"), 3)
    return back.agg(F.count("*").alias("points"), F.count_distinct("event_id").alias("ids"), F.bool_and(own).alias("within"))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS geo_id, CAST(c_mktsegment AS VARCHAR) AS name, CAST(c_nationkey AS VARCHAR) AS country, n_name AS admin, 2 AS names FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 4 < 3")
def gazetteer_read(spark, sf_dir):
    """Ranked places with the names of their states; unranked kinds are left out."""
    t = lambda n: table(spark, sf_dir, n)
    feature = F.element_at(F.array(*map(F.lit, ("PCLI", "PPLA", "PPL", "HTL"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    own = {"geo_id": F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")), "name": F.col("c_mktsegment"), "names": F.lit("one,, two,one"), "feature": feature, "country": F.col("c_nationkey").cast("string"), "admin1": F.lit("01")}
    own |= {"population": F.lit(1).cast("bigint"), "timezone": F.lit("Europe/X"), "lat": F.lit(0.0), "lon": F.lit(0.0)}
    fields = [f.strip().split() for f in readers.GAZETTEER_FIELDS.split(",")]
    places = t("customer").select(*[own.get(n, none(k)).alias(n) for n, k in fields])
    admin = t("nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".01")).alias("code"), F.col("n_name").alias("state"))
    return readers.gazetteer(places, admin).select("geo_id", "name", "country", "admin", F.size("names").alias("names"))


@query("SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('second', ts) AS time, strftime(ts, '%d/%m/%Y') AS text FROM events", dates="day")
def lenient_times(spark, sf_dir):
    from gristmill.functions import text as T

    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format("ts", "dd/MM/yyyy").alias("text"))
    return e.select("event_id", T.day_month_year(F.col("text")).alias("day"), T.lenient_time(F.col("iso")).alias("time"), "text")


@query("SELECT event_type, CAST(week + 4 AS DATE) AS common_friday, price, direction, text FROM ("
       "WITH w AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, value, row_number() OVER (PARTITION BY event_type, date_trunc('week', ts) ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL), "
       "l AS (SELECT event_type, week, value AS price, CASE WHEN value > lag(value) OVER (PARTITION BY event_type ORDER BY week) THEN 1.0 ELSE 0.0 END AS direction FROM w WHERE r = 1), "
       "t AS (SELECT CAST(date_trunc('week', ts + INTERVAL 3 DAY) - INTERVAL 3 DAY + INTERVAL 7 DAY AS DATE) AS common_friday, string_agg(event_type, ' ' ORDER BY event_type) AS text FROM events WHERE event_type IS NOT NULL GROUP BY 1) "
       "SELECT l.*, text FROM l JOIN t ON t.common_friday = CAST(week + 4 AS DATE))", dates="common_friday")  # fmt: skip
def price_direction(spark, sf_dir):
    """Weekly sentences with the direction of the week's last prices: what the direction model is trained on."""
    e = table(spark, sf_dir, "events")
    return ts.price_direction(ts.weekly_text(e, "ts", "event_type"), ts.last_price_direction(e, "ts", "value", ["event_id"], ["event_type"]))


@query("SELECT c_custkey, c_phone FROM (SELECT c_custkey, " + " || ".join("'-'" if c == "-" else f"CAST(CAST('0x' || substr(md5('salt|{k}|' || c_name), 1, 8) AS BIGINT) % 10 AS VARCHAR)" for k, c in enumerate("999-9999")) + " AS c_phone FROM customer)")
def masked_digits(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", protect.digits(F.col("c_name"), "999-9999", "salt").alias("c_phone"))
