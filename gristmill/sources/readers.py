"""Readers: delimited events, gazetteers, code tables, short messages, posts, timed files, sounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import geo
from gristmill.functions import text as T
from gristmill.functions.phonetic import word_key
from gristmill.operators.entities import FEATURES


def text_lines(spark: SparkSession, path: str, line_end: str | None = None) -> DataFrame:
    """(value): lines of text files, or records that end in line_end."""
    reader = spark.read if line_end is None else spark.read.option("lineSep", line_end)
    return reader.text(path)


def delimited(spark: SparkSession, path: str, schema: str | None = None, delimiter: str = ",", header: bool = False) -> DataFrame:
    """Delimited files with quotes, read with a given schema, else with types found in the data; values that can't be read are null."""
    reader = spark.read.option("sep", delimiter).option("header", header).option("mode", "PERMISSIVE").option("escape", '"')
    return reader.csv(path, inferSchema=True) if schema is None else reader.csv(path, schema=schema)


def split_fields(lines: DataFrame, delimiter: str = ",", value: str = "value") -> DataFrame:
    """(fields): array of the fields of every line, with double quotes around fields that hold the delimiter."""
    d = "\\Q" + delimiter + "\\E"
    pieces = F.split(F.col(value), d + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    bare = lambda x: F.when(x.rlike('^".*"$'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')).otherwise(x)
    return lines.select(F.transform(pieces, bare).alias("fields"))


def timed_files(spark: SparkSession, folder: str, pattern: str = r"(\d{14})\.export\.CSV$") -> DataFrame:
    """(path, time): files whose names match, with the 14 digits as a timestamp."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")  # contents aren't read
    stamp = F.regexp_extract("path", pattern, 1)
    return files.where(stamp != "").select("path", F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).alias("time"))


def event_points(lines: DataFrame, lat: int = 39, lon: int = 40, date: int = 1, least_fields: int = 41, value: str = "value") -> DataFrame:
    """(fields, date, lat, lon, status): parsed event lines; status is ok, or what is wrong: line, date or point.

    lat, lon and date are field numbers from 0; dates are yyyyMMdd. Counting
    rows by status gives the counters of an ingest.
    """
    f = F.split(F.col(value), "\t", -1)
    made = lines.select(f.alias("fields")).select(
        "fields",
        F.to_date(F.try_to_timestamp(F.get("fields", F.lit(date)), F.lit("yyyyMMdd"))).alias("date"),
        F.get("fields", F.lit(lat)).try_cast("double").alias("lat"),
        F.get("fields", F.lit(lon)).try_cast("double").alias("lon"),
    )
    status = (
        F.when(F.col("fields").isNull() | (F.size("fields") < least_fields), "line")
        .when(F.col("date").isNull(), "date")
        .when(~geo.valid_point(F.col("lat"), F.col("lon")), "point")
        .otherwise("ok")
    )
    return made.withColumn("status", status)


def points_between(points: DataFrame, south: float, north: float, west: float, east: float, first: str, last: str) -> DataFrame:
    """Points within bounds and dates, both ends of the dates included; pushed to the scan of a table of points."""
    return points.where(geo.in_box(F.col("lat"), F.col("lon"), south, north, west, east) & F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


GAZETTEER_FIELDS = "geo_id bigint, name string, ascii_name string, names string, lat double, lon double, class string, feature string, country string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population bigint, elevation int, dem int, timezone string, modified string"


def gazetteer(places: DataFrame, admin: DataFrame) -> DataFrame:
    """(geo_id, name, names, country, admin, feature, population, timezone, lat, lon): ranked places with the names of their states.

    places has GAZETTEER_FIELDS; admin has (code, state) with codes like ``XX.01``.
    """
    ranked = places.where(F.col("feature").isin(*FEATURES))
    coded = ranked.withColumn("code", F.concat_ws(".", "country", "admin1"))
    other = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("names", F.lit("")), ","), lambda n: F.trim(n)), lambda n: n != ""))
    met = coded.join(admin.select("code", "state"), "code", "left")
    return met.select("geo_id", "name", other.alias("names"), "country", F.coalesce("state", F.lit("")).alias("admin"), "feature", "population", F.split("timezone", ";").alias("timezone"), "lat", "lon")


def nicknames(rows: Sequence[tuple[str, str]]) -> Mapping[str, set[str]]:
    """Phonetic key of a nickname to the keys of the full names it may stand for, from (full name, nickname)."""
    out: dict[str, set[str]] = {}
    for name, nick in rows:
        out.setdefault(word_key(nick.lower()), set()).add(word_key(name.lower()))
    return out


def actions(events: DataFrame, codes: DataFrame, actor1: str = "actor1", code: str = "code", actor2: str = "actor2") -> DataFrame:
    """events with column sentence: ``actor1 action actor2`` in lower case, blanks within each replaced by _.

    codes has (code, text); an unknown code stands for itself.
    """
    known = codes.select(F.col("code").alias("_code"), F.col("text").alias("_action"))
    met = events.join(F.broadcast(known), F.col(code) == F.col("_code"), "left")  # a fixed list of codes
    part = lambda c: F.regexp_replace(F.lower(c), r"\s+", "_")
    return met.withColumn("sentence", F.concat_ws(" ", part(F.col(actor1)), part(F.coalesce("_action", code)), part(F.col(actor2)))).drop("_code", "_action")


MESSAGE = "created_at string, text string, lang string, user struct<location: string>, entities struct<hashtags: array<struct<text: string>>>"


def messages(lines: DataFrame, value: str = "value") -> DataFrame:
    """(time, body, lang, location, tags): short messages from JSON; missing parts are empty."""
    j = lines.select(F.from_json(value, MESSAGE).alias("j"))
    stamp = F.coalesce(F.try_to_timestamp(F.col("j.created_at"), F.lit("MMM dd HH:mm:ss Z yyyy")), F.try_to_timestamp(F.substring("j.created_at", 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")), T.lenient_time(F.col("j.created_at")))
    tags = F.coalesce(F.transform("j.entities.hashtags", lambda t: F.lower(t["text"])), F.array().cast("array<string>"))
    return j.select(stamp.alias("time"), F.coalesce("j.text", F.lit("")).alias("body"), "j.lang", F.coalesce("j.user.location", F.lit("")).alias("location"), tags.alias("tags"))


def english_messages(parsed: DataFrame, more_words: int = 5) -> DataFrame:
    """Messages in English of more than so many words."""
    return parsed.where((F.col("lang") == "en") & (F.size(T.words(F.col("body"))) > more_words))


def posts(lines: DataFrame, value: str = "value") -> DataFrame:
    """(id, body, tags): posts from lines ``<row Id=... Body=... Tags=.../>``; other lines are left out.

    The body is unescaped and has no tags of its own.
    """
    rows = lines.where(F.trim(value).startswith("<row Id"))
    x = rows.select(F.from_xml(value, F.lit("_Id bigint, _Body string, _Tags string")).alias("x"))
    return x.select(F.col("x._Id").alias("id"), F.trim(F.regexp_replace(F.regexp_replace("x._Body", "<[^>]*>", " "), r"\s+", " ")).alias("body"), T.tag_list(F.col("x._Tags")).alias("tags"))


def search_documents(lines: DataFrame, schema: str, query: Mapping[str, str | tuple] | None = None, value: str = "value") -> DataFrame:
    """Documents of a search index's JSON dump whose fields equal, or lie between, the query's values."""
    out = lines.select(F.from_json(value, schema).alias("d")).select("d.*")
    for field, wanted in (query or {}).items():
        out = out.where(F.col(field).between(*wanted) if isinstance(wanted, tuple) else F.col(field) == wanted)
    return out


def visible(labels: Column, granted: Sequence[str]) -> Column:
    """Whether a cell's label expression (``A&B``, ``A|B`` or empty) is met by the granted labels."""
    all_of = lambda part: F.forall(F.split(part, "&"), lambda x: F.trim(x).isin(*granted))
    return (F.coalesce(labels, F.lit("")) == "") | F.coalesce(F.exists(F.split(labels, r"\|"), all_of), F.lit(False))


def edges_with_labels(edges: DataFrame, granted: Sequence[str]) -> DataFrame:
    """(src, dst, count): visible edges, counted."""
    return edges.where(visible(F.col("visibility"), granted)).groupBy("src", "dst").agg(F.sum("count").alias("count"))


def metrics_with_prefix(metrics: DataFrame, prefix: str) -> DataFrame:
    """Points of the metrics whose names start with prefix (a pushed-down filter)."""
    return metrics.where(F.col("name").startswith(prefix))


def latest(df: DataFrame, keys: Sequence[str], *newest: str) -> DataFrame:
    """The newest row of every key: what an upserted table reads as."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in newest])
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
