"""Queries over the test tables for the library's operators, and their DuckDB equivalents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import profile
from gristmill.operators import timeseries as ts
from gristmill.plans import exchange, graphs, records, similarity, texts  # noqa: F401  (they register their queries)
from gristmill.plans.registry import ORACLES, QUERIES, query, table

# Profiles

CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def melted(name: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS idx, CAST({c} AS VARCHAR) AS value FROM {name}" for i, c in enumerate(columns))


def lines_sql(name: str, columns: tuple[str, ...]) -> str:
    return f"SELECT concat_ws(',', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}) AS value FROM {name}"


def lines(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select(F.concat_ws(",", *columns).alias("value"))


@query("SELECT count(*) AS rows FROM customer")
def profile_row_count(spark, sf_dir):
    return profile.row_count(table(spark, sf_dir, "customer"))


@query("SELECT len(string_split(text, ',')) AS fields, count(*) AS n, min(text) AS example FROM documents WHERE text IS NOT NULL GROUP BY 1")
def profile_field_count(spark, sf_dir):
    return profile.field_counts(table(spark, sf_dir, "documents"), ",", "text")


def described_sql() -> str:
    """(symbol, description) of ASCII, other characters are NA."""
    names = ", ".join(f"({i}, '{unicodedata.name(chr(i), f'CONTROL {i}')}')" for i in range(1, 128))
    return f"(SELECT chr(i) AS symbol, description FROM (VALUES {names}) AS v(i, description))"


@query(f"SELECT symbol, coalesce(description, 'NA') AS description, n FROM (SELECT symbol, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS symbol FROM documents) WHERE symbol <> '' GROUP BY 1) LEFT JOIN {described_sql()} USING (symbol)")
def profile_char_hist(spark, sf_dir):
    return profile.character_histogram(table(spark, sf_dir, "documents"), "text")


@query(f"SELECT idx, avg(CASE WHEN coalesce(value, '') = '' THEN 1.0 ELSE 0.0 END) AS ratio FROM ({melted('customer', CUSTOMER)}) GROUP BY 1")
def profile_emptiness(spark, sf_dir):
    return profile.emptiness(profile.cells(table(spark, sf_dir, "customer"), CUSTOMER))


@query(f"""WITH c AS (SELECT idx, coalesce(value, '') AS value, count(*) AS n FROM ({melted("customer", CUSTOMER)}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY n DESC, value) AS r FROM c)
SELECT idx, count(*) / sum(n) AS ratio, string_agg(value, '|' ORDER BY r) FILTER (WHERE r <= 5) AS top FROM r GROUP BY 1""")
def profile_cardinality(spark, sf_dir):
    return profile.cardinality(profile.cells(table(spark, sf_dir, "customer"), CUSTOMER))


def mask_sql(mask: str, name: str, columns: tuple[str, ...]) -> str:
    return f"""WITH m AS (SELECT idx, value, {mask} AS mask FROM (SELECT idx, coalesce(value, '') AS value FROM ({melted(name, columns)}))),
c AS (SELECT idx, mask, value, count(*) AS n FROM m GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY idx, mask ORDER BY n DESC, value) AS r FROM c)
SELECT idx, mask, CAST(sum(n) AS BIGINT) AS n, string_agg(value, '|' ORDER BY r) FILTER (WHERE r <= 3) AS examples FROM r GROUP BY 1, 2"""


LOW = "regexp_replace(regexp_replace(regexp_replace(value, '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g'), '[0-9]+', '9', 'g')"
CLASSES = "CASE WHEN c ~ '[0-9]' THEN '9' WHEN c ~ '[A-Z]' THEN 'A' WHEN c ~ '[a-z]' THEN 'a' WHEN c = ' ' THEN 'T' ELSE 'U' END"


@query(mask_sql(LOW, "part", PART))
def profile_mask_low(spark, sf_dir):
    return profile.mask_histogram(profile.cells(table(spark, sf_dir, "part"), PART), "field.ascii.low")


@query(mask_sql(LOW.replace("+", ""), "part", PART))
def profile_mask_high(spark, sf_dir):
    return profile.mask_histogram(profile.cells(table(spark, sf_dir, "part"), PART), "field.ascii.high")


@query(mask_sql("CASE WHEN trim(value) = '' THEN '0' ELSE '1' END", "customer", CUSTOMER))
def profile_pop(spark, sf_dir):
    return profile.mask_histogram(profile.cells(table(spark, sf_dir, "customer"), CUSTOMER), "field.pop.check")


@query(f"""WITH m AS (SELECT idx, value, {CLASSES} AS mask FROM (SELECT idx, value, unnest(string_split(value, '')) AS c FROM ({melted("part", PART)}))),
c AS (SELECT idx, mask, value, count(*) AS n FROM m GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY idx, mask ORDER BY n DESC, value) AS r FROM c)
SELECT idx, mask, CAST(sum(n) AS BIGINT) AS n, string_agg(value, '|' ORDER BY r) FILTER (WHERE r <= 3) AS examples FROM r GROUP BY 1, 2""")
def profile_class(spark, sf_dir):
    return profile.mask_histogram(profile.cells(table(spark, sf_dir, "part"), PART), "field.class.freq")


@query(f"""SELECT idx, hex(encode(c)) AS mask, count(*) AS n FROM (SELECT idx, unnest(string_split(value, '')) AS c FROM ({melted("part", PART)})) GROUP BY 1, 2""")
def profile_hex(spark, sf_dir):
    return profile.mask_histogram(profile.cells(table(spark, sf_dir, "part"), PART), "field.hex").drop("examples")


def examples_sql(mask: str, cell: str) -> str:
    return f"""(SELECT field || '/' || mask AS tag, CAST(sum(n) AS DOUBLE) AS value, string_agg(value, '|' ORDER BY r) FILTER (WHERE r <= 3) AS examples FROM (
SELECT *, row_number() OVER (PARTITION BY field, mask ORDER BY n DESC, value) AS r FROM (SELECT field, {mask} AS mask, value, count(*) AS n FROM {cell} GROUP BY 1, 2, 3)) GROUP BY 1)"""


@query(f"""WITH names AS (SELECT unnest({list(CUSTOMER)}) AS field, unnest(range({len(CUSTOMER)})) AS idx),
cell AS (SELECT field, coalesce(value, '') AS value FROM ({melted("customer", CUSTOMER)}) JOIN names USING (idx)), line AS ({lines_sql("customer", CUSTOMER)}),
signs AS (SELECT field, value, unnest(string_split(value, '')) AS c FROM cell),
top AS (SELECT field, string_agg(value, '|' ORDER BY r) FILTER (WHERE r <= 5) AS examples, count(*) / sum(n) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM (SELECT field, value, count(*) AS n FROM cell GROUP BY 1, 2)) GROUP BY 1)
SELECT *, 'customer' AS source, '2024-01-01 00:00:00' AS ingest_time FROM (
SELECT 'row.count' AS metric, CAST(count(*) AS DOUBLE) AS value, 'customer' AS tag, '' AS examples FROM line
UNION ALL SELECT 'row.ascii', n, symbol, coalesce(description, 'NA') FROM (SELECT c AS symbol, count(*) AS n FROM (SELECT unnest(string_split(value, '')) AS c FROM line) GROUP BY 1) LEFT JOIN {described_sql()} USING (symbol)
UNION ALL SELECT 'field.count', count(*), CAST(len(string_split(value, ',')) AS VARCHAR), '' FROM line GROUP BY 3
UNION ALL SELECT 'field.emptiness', avg(CASE WHEN value = '' THEN 1.0 ELSE 0.0 END), field, '' FROM cell GROUP BY field
UNION ALL SELECT 'field.cardinality', ratio, field, examples FROM top
UNION ALL SELECT 'field.ascii.low', value, tag, examples FROM {examples_sql(LOW, "cell")}
UNION ALL SELECT 'field.ascii.high', value, tag, examples FROM {examples_sql(LOW.replace("+", ""), "cell")}
UNION ALL SELECT 'field.pop.check', value, tag, examples FROM {examples_sql("CASE WHEN trim(value) = '' THEN '0' ELSE '1' END", "cell")}
UNION ALL SELECT 'field.class.freq', value, tag, examples FROM {examples_sql(CLASSES, "signs")})""")
def profile_report(spark, sf_dir):
    """The whole report; tag and examples put the entries of its map into two columns."""
    made = profile.report(table(spark, sf_dir, "customer"), "customer", "2024-01-01 00:00:00", CUSTOMER)
    tag = F.coalesce(F.concat_ws("/", "tags.field", "tags.mask"), F.lit(""))
    examples = F.coalesce("tags.examples", "tags.top", "tags.description", F.lit(""))
    return made.select("metric", "value", F.coalesce("tags.table", "tags.symbol", "tags.fields", tag).alias("tag"), examples.alias("examples"), "source", F.col("ingest_time").cast("string").alias("ingest_time"))


# Time series

DAILY = """SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,
CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS price FROM orders GROUP BY 1, 2"""
BARS = f"""daily AS ({DAILY}), ranked AS (
  SELECT *, CAST(date_trunc('week', date) AS DATE) AS week,
    row_number() OVER (PARTITION BY series, date_trunc('week', date) ORDER BY price DESC, date) AS h,
    row_number() OVER (PARTITION BY series, date_trunc('week', date) ORDER BY price, date DESC) AS l FROM daily),
bars AS (SELECT series, week, max(price) AS high, max(date) FILTER (WHERE h = 1) AS high_date, min(price) AS low, max(date) FILTER (WHERE l = 1) AS low_date FROM ranked GROUP BY 1, 2)"""
TREND = f"""{BARS}, lagged AS (
  SELECT *, lag(high) OVER w AS prev_high, lag(high_date) OVER w AS prev_high_date, lag(low) OVER w AS prev_low, lag(low_date) OVER w AS prev_low_date
  FROM bars WINDOW w AS (PARTITION BY series ORDER BY week)),
trended AS (SELECT *, CAST(sign(sign(high - prev_high) + sign(low - prev_low)) AS INTEGER) AS sign FROM lagged)"""


def daily_prices(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(
        (F.sum(cents).cast("double") / F.count("*")).alias("price")
    )


@query(f"WITH {BARS} SELECT *, CASE WHEN high_date < low_date THEN high ELSE low END AS first_price, CASE WHEN high_date < low_date THEN low ELSE high END AS second_price FROM bars", dates="week high_date low_date")
def hlc_weekly(spark, sf_dir):
    return ts.weekly_high_low(daily_prices(spark, sf_dir), series=["series"])


@query(f"WITH {TREND} SELECT series, week, high, low, sign FROM trended", dates="week")
def trend_sign(spark, sf_dir):
    return ts.trend(hlc_weekly(spark, sf_dir), ["series"]).select("series", "week", "high", "low", "sign")


@query(f"""WITH {TREND}, r AS (SELECT *, lag(sign) OVER (PARTITION BY series ORDER BY week) AS prev_sign FROM trended)
SELECT series, week, sign, CASE WHEN sign < prev_sign THEN prev_high_date ELSE prev_low_date END AS date, CASE WHEN sign < prev_sign THEN prev_high ELSE prev_low END AS price
FROM r WHERE sign <> prev_sign""", dates="week date")
def reversals(spark, sf_dir):
    found = ts.reversals(ts.trend(hlc_weekly(spark, sf_dir), ["series"]), ["series"])
    return found.where("reversal IS NOT NULL").select("series", "week", "sign", "reversal.date", "reversal.price")


@query(f"WITH {BARS} SELECT series, high_date AS date, high AS price FROM bars UNION ALL SELECT series, low_date, low FROM bars", dates="date")
def stacked_high_low(spark, sf_dir):
    return ts.stacked(hlc_weekly(spark, sf_dir), ["series"])


@query("""WITH w AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, value, row_number() OVER (PARTITION BY event_type, date_trunc('week', ts) ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL),
l AS (SELECT event_type, week, value AS price, lag(value) OVER (PARTITION BY event_type ORDER BY week) AS before FROM w WHERE r = 1)
SELECT event_type, CAST(week + 4 AS DATE) AS common_friday, price, CASE WHEN price > before THEN 1.0 ELSE 0.0 END AS direction FROM l""", dates="common_friday")
def weekly_last_direction(spark, sf_dir):
    return ts.last_price_direction(table(spark, sf_dir, "events"), "ts", "value", ["event_id"], ["event_type"])


@query("""SELECT CAST(date_trunc('week', ts + INTERVAL 3 DAY) - INTERVAL 3 DAY + INTERVAL 7 DAY AS DATE) AS common_friday, string_agg(event_type, ' ' ORDER BY event_type) AS text FROM events WHERE event_type IS NOT NULL GROUP BY 1""", dates="common_friday")
def weekly_sentences(spark, sf_dir):
    return ts.weekly_text(table(spark, sf_dir, "events"), "ts", "event_type")


@query("SELECT event_type AS tag, date_trunc('minute', ts) AS minute, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def minute_metrics(spark, sf_dir):
    return ts.minute_sum(table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint")), "ts", "event_type", "cents")


@query("SELECT 'events' AS name, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS value, event_type, user_id % 10 AS state FROM events GROUP BY 2, 4, 5", dates="day")
def state_count(spark, sf_dir):
    return ts.count_metrics(table(spark, sf_dir, "events").withColumn("state", F.col("user_id") % 10), "events", "ts", ["event_type", "state"])


@query("SELECT 'value' AS name, CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(value) AS value, event_type, user_id % 10 AS state FROM events GROUP BY 2, 4, 5", dates="day")
def state_mean(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("bigint")
    return ts.mean_metrics(table(spark, sf_dir, "events").withColumn("state", F.col("user_id") % 10), "value", "ts", cents, ["event_type", "state"])


@query("""SELECT CASE WHEN value > 0 AND value <= 1.5 THEN 'SECRET' WHEN value > 1.5 AND value <= 2.5 THEN 'INTERNAL' ELSE 'CONFIDENTIAL' END AS viz, count(*) AS n FROM events GROUP BY 1""")
def viz_bucket(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(ts.visibility(F.col("value")).alias("viz")).agg(F.count("*").alias("n"))


@query("SELECT event_id, 'put events ' || (epoch_us(ts) // 1000) || ' ' || CAST(value AS VARCHAR) || ' viz=' || CASE WHEN value > 0 AND value <= 1.5 THEN 'SECRET' WHEN value > 1.5 AND value <= 2.5 THEN 'INTERNAL' ELSE 'CONFIDENTIAL' END || ' type=' || event_type || ' user=' || user_id AS line FROM events")
def metric_lines(spark, sf_dir):
    tags = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    line = ts.metric_line(F.lit("events"), F.col("ts"), F.col("value"), tags, ts.visibility(F.col("value")))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("""WITH p AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, count(*) AS value FROM events GROUP BY 1, 2),
d AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM p)
SELECT key, day, value FROM (SELECT DISTINCT key FROM p) CROSS JOIN d LEFT JOIN p USING (key, day)""", dates="day")
def aligned_series(spark, sf_dir):
    points = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return ts.aligned(points, "user_id", "day", "n")


@query("""WITH w AS (SELECT event_type AS key, unnest(generate_series(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 36 HOUR, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'), INTERVAL 12 HOUR)) AS window_start FROM events)
SELECT window_start, window_start + INTERVAL 48 HOUR AS window_end, key, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def sliding_48h_count(spark, sf_dir):
    return ts.sliding_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query("""WITH w AS (SELECT user_id AS key, unnest(generate_series(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 36 HOUR, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'), INTERVAL 12 HOUR)) AS window_start FROM events),
c AS (SELECT window_start, key, count(*) AS n FROM w GROUP BY 1, 2)
SELECT window_start, key, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, key) AS rank FROM c) WHERE rank <= 5""")
def event_topk_window(spark, sf_dir):
    counts = ts.sliding_counts(table(spark, sf_dir, "events"), "ts", "user_id")
    return ts.top_per_group(counts, ["window_start"], [F.desc("n"), "key"], 5).select("window_start", "key", "n", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT min(ts) AS first, max(ts) AS last, coalesce(max(event_id), 0) AS last_id FROM events")
def date_range(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.coalesce(F.max("event_id"), F.lit(0)).alias("last_id"))
