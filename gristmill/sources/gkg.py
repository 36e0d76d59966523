"""Parser of knowledge-graph records: 27 tab-separated fields with nested lists, as one projection.

A line without 27 fields gives a record of nulls and empty lists with valid
false. Parts that can't be read become nulls or empty texts within their list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _double(c: Column) -> Column:
    return c.try_cast("double")


def _items(field: Column, delimiter: str) -> Column:
    """Non-empty pieces of a field."""
    return F.filter(F.split(F.coalesce(field, F.lit("")), delimiter), lambda x: x != "")


def _last(c: Column, delimiter: str) -> Column:
    return F.substring_index(c, delimiter, -1)


def _before_last(c: Column, delimiter: str) -> Column:
    return F.when(F.instr(c, delimiter) > 0, F.regexp_replace(c, f"{delimiter}[^{delimiter}]*$", "")).otherwise(c)


def record_id(field: Column) -> Column:
    """Struct (date, translingual, batch) of ``yyyyMMddHHmmss-[T]n``; translingual is told by the T."""
    batch = F.get(F.split(field, "-"), F.lit(1))
    return F.struct(
        F.get(F.split(field, "-"), F.lit(0)).try_cast("bigint").alias("date"),
        F.coalesce(batch.startswith("T"), F.lit(False)).alias("translingual"),
        _int(F.regexp_replace(batch, "^T", "")).alias("batch"),
    )


def _count(x: Column) -> Column:
    p = F.split(x, "#")
    return F.struct(F.get(p, F.lit(0)).alias("type"), _int(F.get(p, F.lit(1))).alias("count"), F.get(p, F.lit(2)).alias("object"), location(F.array_join(F.slice(p, 4, F.greatest(F.size(p) - 3, F.lit(0))), "#")).alias("location"))


def location(x: Column) -> Column:
    """Struct of ``type#name#country#adm1#lat#lon#feature``."""
    p = F.split(x, "#")
    return F.struct(
        _int(F.get(p, F.lit(0))).alias("type"), F.get(p, F.lit(1)).alias("name"), F.get(p, F.lit(2)).alias("country"), F.get(p, F.lit(3)).alias("adm1"),
        _double(F.get(p, F.lit(4))).alias("lat"), _double(F.get(p, F.lit(5))).alias("lon"), F.get(p, F.lit(6)).alias("feature"),
    )


def enhanced_location(x: Column) -> Column:
    """Struct (location, adm2, offset) of ``type#name#country#adm1#adm2#lat#lon#feature#offset``; all null inside with other than 9 parts."""
    p = F.split(x, "#")
    nine = F.size(p) == 9
    part = lambda i: F.when(nine, F.get(p, F.lit(i)))
    loc = F.struct(_int(part(0)).alias("type"), part(1).alias("name"), part(2).alias("country"), part(3).alias("adm1"), _double(part(5)).alias("lat"), _double(part(6)).alias("lon"), part(7).alias("feature"))
    return F.struct(loc.alias("location"), part(4).alias("adm2"), _int(part(8)).alias("offset"))


def _named(x: Column) -> Column:
    return F.struct(_before_last(x, ",").alias("name"), _int(_last(x, ",")).alias("offset"))


def tone(field: Column) -> Column:
    """Struct of the six tone figures and the number of words."""
    p = F.split(field, ",")
    figures = ("tone", "positive", "negative", "polarity", "activity", "self_group")
    return F.struct(*[_double(F.get(p, F.lit(i))).alias(n) for i, n in enumerate(figures)], _int(F.get(p, F.lit(6))).alias("words"))


def _date(x: Column) -> Column:
    p = F.split(x, ",")
    return F.struct(*[_int(F.get(p, F.lit(i))).alias(n) for i, n in enumerate(("resolution", "month", "day", "year", "offset"))])


def _quote(x: Column) -> Column:
    p = F.split(x, r"\|")
    return F.struct(_int(F.get(p, F.lit(0))).alias("offset"), _int(F.get(p, F.lit(1))).alias("length"), F.get(p, F.lit(2)).alias("verb"), F.get(p, F.lit(3)).alias("quote"))


def _amount(x: Column) -> Column:
    p = F.split(x, ",")
    return F.struct(_double(F.get(p, F.lit(0))).alias("amount"), F.get(p, F.lit(1)).alias("object"), _int(F.get(p, F.lit(2))).alias("offset"))


def _score(x: Column) -> Column:
    p = F.split(x, ":")
    return F.struct(F.get(p, F.lit(0)).alias("dimension"), _double(F.get(p, F.lit(1))).alias("score"))


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row of nested columns for every line; see the module for malformed lines."""
    fields = F.split(F.col(value), "\t", -1)
    valid = F.coalesce(F.size(fields) == 27, F.lit(False))
    base = lines.select(valid.alias("valid"), F.when(valid, fields).alias("f"))
    f = lambda n: F.get("f", F.lit(n - 1))
    listed = lambda n, delimiter, made: F.transform(_items(f(n), delimiter), made)
    themed = lambda x: F.struct(_before_last(x, ",").alias("theme"), _int(_last(x, ",")).alias("offset"))
    return base.select(
        "valid",
        record_id(f(1)).alias("record_id"),
        f(2).try_cast("bigint").alias("date"),
        _int(f(3)).alias("collection"),
        f(4).alias("source"),
        f(5).alias("document"),
        listed(6, ";", _count).alias("counts"),
        listed(7, ";", lambda x: F.struct(_count(_before_last(x, "#")).alias("count"), _int(_last(x, "#")).alias("offset"))).alias("enhanced_counts"),
        _items(f(8), ";").alias("themes"),
        listed(9, ";", themed).alias("enhanced_themes"),
        listed(10, ";", location).alias("locations"),
        listed(11, ";", enhanced_location).alias("enhanced_locations"),
        _items(f(12), ";").alias("persons"),
        listed(13, ";", _named).alias("enhanced_persons"),
        _items(f(14), ";").alias("organisations"),
        listed(15, ";", _named).alias("enhanced_organisations"),
        tone(f(16)).alias("tone"),
        listed(17, ";", _date).alias("dates"),
        listed(18, ",", _score).alias("gcam"),
        f(19).alias("sharing_image"),
        _items(f(20), ";").alias("related_images"),
        _items(f(21), ";").alias("social_images"),
        _items(f(22), ";").alias("social_videos"),
        listed(23, "#", _quote).alias("quotations"),
        listed(24, ";", _named).alias("all_names"),
        listed(25, ";", _amount).alias("amounts"),
        F.struct(F.get(F.split(f(26), ";"), F.lit(0)).alias("source_language"), F.get(F.split(f(26), ";"), F.lit(1)).alias("engine")).alias("translation"),
        f(27).alias("extras"),
    )
