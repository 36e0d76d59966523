"""Data-quality profilers over raw lines and over fields, and their common report.

Field profilers work on cells (idx, value): the table is melted once and every
metric is an aggregate over the same cells. Fields are numbered from 0. Null
and empty values are the same to all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import masks
from gristmill.storage import tasks_for, written

#: Entries that a value may have of its own in the counts: itself, its masks and the classes or codes of its characters.
ENTRIES_A_VALUE = 8

MASKS = {
    "field.ascii.low": lambda v: F.array(masks.low_grain(v)),
    "field.ascii.high": lambda v: F.array(masks.high_grain(v)),
    "field.pop.check": lambda v: F.array(masks.pop_check(v)),
    "field.class.freq": masks.class_masks,
    "field.hex": masks.hex_mask,
    "field.unicode": masks.unicode_mask,
}


def row_count(lines: DataFrame) -> DataFrame:
    """(rows): number of rows."""
    return lines.agg(F.count("*").alias("rows"))


def character_histogram(lines: DataFrame, value: str = "value", table: DataFrame | None = None) -> DataFrame:
    """(symbol, description, n): occurrences of every character.

    table has (symbol, description); a character it lacks is described as NA.
    """
    counts = lines.select(F.explode(masks.characters(F.col(value))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))
    table = ascii_table(lines.sparkSession) if table is None else table
    return counts.join(F.broadcast(table), "symbol", "left").select("symbol", F.coalesce("description", F.lit("NA")).alias("description"), "n")


def ascii_table(spark) -> DataFrame:
    """(symbol, description) of the 128 ASCII characters."""
    import unicodedata

    return spark.createDataFrame([(chr(i), unicodedata.name(chr(i), f"CONTROL {i}")) for i in range(128)], "symbol string, description string")


def field_counts(lines: DataFrame, delimiter: str = ",", value: str = "value") -> DataFrame:
    """(fields, n, example): number of lines of each field count, with the smallest such line."""
    n = F.size(F.split(F.col(value), _literal(delimiter), -1)).cast("bigint")
    return lines.where(F.col(value).isNotNull()).groupBy(n.alias("fields")).agg(F.count("*").alias("n"), F.min(value).alias("example"))


def _literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(idx, value): every cell of the columns as text, numbered from 0."""
    columns = list(columns or df.columns)
    return df.select(F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("idx", "value"))


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def emptiness(cell: DataFrame) -> DataFrame:
    """(idx, ratio): share of empty values of every field."""
    return cell.groupBy("idx").agg((F.count_if(_blank(F.col("value"))) / F.count("*")).alias("ratio"))


def cardinality(cell: DataFrame, top: int = 5) -> DataFrame:
    """(idx, ratio, top): distinct values over rows, and the most frequent values joined by ``|`` (ties by value)."""
    return _cardinality(written(cell.groupBy("idx", F.coalesce("value", F.lit("")).alias("value")).agg(F.count("*").alias("n")), "values"), top)


def _spread(df: DataFrame, entries: int) -> DataFrame:
    """df in as many tasks as so many entries a row ask for; as it is if one will do."""
    tasks = tasks_for(df.count() * entries)
    return df.repartition(tasks) if tasks > 1 else df


def _cardinality(counts: DataFrame, top: int = 5) -> DataFrame:
    ranked = _spread(counts, 1).withColumn("r", F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("n"), "value")))
    best = ranked.where(F.col("r") <= top).groupBy("idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]), "|").alias("top"))
    total = counts.groupBy("idx").agg((F.count("*") / F.sum("n")).alias("ratio"))
    return total.join(best, "idx")


def mask_histogram(cell: DataFrame, mask: str, top: int = 3) -> DataFrame:
    """(idx, mask, n, examples): occurrences of every mask, and its most frequent values joined by ``|``.

    mask is a key of MASKS. Masks with one value a character count each of them.
    Cells are counted, spread over as many tasks as they ask for, and read again.
    """
    made = _spread(cell, ENTRIES_A_VALUE).select("idx", F.coalesce("value", F.lit("")).alias("value")).select("idx", "value", F.explode(MASKS[mask](F.col("value"))).alias("mask"))
    return _examples(written(made.groupBy("idx", "mask", "value").agg(F.count("*").alias("n")), "masks"), ["idx", "mask"], top)


def _examples(counts: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """keys, n and examples of written counts; only each task's best values of a key are sent on and sorted together."""
    ranked = _spread(counts, 1).withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "value")))
    best = ranked.where(F.col("r") <= top).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]), "|").alias("examples"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("n")).join(best, keys)


REPORTED = ("field.ascii.low", "field.ascii.high", "field.pop.check", "field.class.freq")


def report(df: DataFrame, source: str, ingest_time: str, columns: Sequence[str] | None = None, delimiter: str = ",") -> DataFrame:
    """(metric, value, ingest_time, source, tags): all metrics of a table in one long form.

    tags is a map with the field's name and number, the mask, and examples, as
    far as the metric has them. The table's rows are counted, to spread them over
    as many tasks as they ask for, and read once: every row gives its entries for
    all metrics, these are counted together, and the counts are written; metrics
    are made of the counts.
    """
    columns = list(columns or df.columns)
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    text = F.concat_ws(delimiter, *values)

    def entry(metric: str, idx: Column, mask: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), idx.cast("int").alias("idx"), mask.alias("mask"), value.alias("value"))

    none, blank = F.lit(-1), F.lit("")
    whole = F.array(entry("row.count", none, blank, blank), entry("field.count", none, F.size(F.split(text, _literal(delimiter), -1)).cast("string"), blank))
    signs = F.transform(masks.characters(text), lambda c: entry("row.ascii", none, c, blank))

    def of_field(value: Column, idx: Column) -> Column:
        listed = lambda m: F.transform(MASKS[m](value), lambda k: entry(m, idx, k, value))
        masked = [listed(m) for m in REPORTED]
        return F.concat(F.array(entry("field", idx, blank, value)), *masked)

    entries = F.concat(whole, signs, F.flatten(F.transform(F.array(*values), of_field)))
    counted = _spread(df, ENTRIES_A_VALUE * len(columns)).select(F.explode(entries).alias("e")).select("e.*").groupBy("metric", "idx", "mask", "value").agg(F.count("*").alias("n"))
    counts = written(counted, "profile")
    name = F.array(*[F.lit(c) for c in columns])
    field = lambda: [F.lit("field"), F.element_at(name, F.col("idx") + 1), F.lit("idx"), F.col("idx").cast("string")]
    only = lambda metric: counts.where(F.col("metric") == metric).drop("metric")

    def part(metric: str, rows: DataFrame, value: Column, *tags: Column) -> DataFrame:
        return rows.select(F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.create_map(*tags).alias("tags"))

    known = only("row.ascii").join(F.broadcast(ascii_table(df.sparkSession)), F.col("mask") == F.col("symbol"), "left")  # 128 rows
    cell = only("field")
    empty = cell.groupBy("idx").agg((F.sum(F.when(_blank(F.col("value")), F.col("n")).otherwise(0)) / F.sum("n")).alias("ratio"))
    parts = [
        part("row.count", only("row.count").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")), F.col("rows"), F.lit("table"), F.lit(source)),
        part("row.ascii", known, F.col("n"), F.lit("symbol"), F.col("mask"), F.lit("description"), F.coalesce("description", F.lit("NA"))),
        part("field.count", only("field.count"), F.col("n"), F.lit("fields"), F.col("mask")),
        part("field.emptiness", empty, F.col("ratio"), *field()),
        part("field.cardinality", _cardinality(cell.select("idx", "value", "n")), F.col("ratio"), *field(), F.lit("top"), F.col("top")),
    ]
    masked = _examples(counts.where(F.col("metric").isin(*REPORTED)), ["metric", "idx", "mask"])
    tags = F.create_map(*field(), F.lit("mask"), F.col("mask"), F.lit("examples"), F.col("examples"))
    out = masked.select("metric", F.col("n").cast("double").alias("value"), tags.alias("tags"))
    for p in parts:
        out = out.unionByName(p)
    return out.withColumns({"ingest_time": F.lit(ingest_time).cast("timestamp"), "source": F.lit(source)})
