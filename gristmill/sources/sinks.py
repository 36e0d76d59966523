"""Writers: tables with upserts, visibility and expiry, sorted metric lines, encrypted text, single files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import geo, protect


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "append", by: Sequence[str] = (), header: bool = True) -> None:
    """df as parquet, json, csv (with header), orc or any installed format, in folders by the given columns."""
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", header)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)


def convert(spark, source: str, target: str, source_format: str = "parquet", target_format: str = "parquet") -> None:
    """Copy a table from one format to another."""
    write_table(spark.read.format(source_format).load(source), target, target_format, "overwrite")


def single_text(df: DataFrame, path: str, column: str | Column) -> None:
    """One text file of a small result."""
    df.select(F.col(column) if isinstance(column, str) else column).coalesce(1).write.mode("overwrite").text(path)


def upsert(df: DataFrame, path: str, keys: Sequence[str], version: int) -> None:
    """Write rows as a version of a table; readers.latest(keys, "version") reads the newest row of each key.

    A version has a folder of its own and one row of every key (of several the
    same in every run), so writing it again replaces it, whatever it held.
    """
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*df.columns), *[F.col(c).cast("string") for c in df.columns])
    one = df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    one.write.mode("overwrite").parquet(f"{path}/version={int(version)}")


def with_expiry(df: DataFrame, ts: str, hours: int = 48) -> DataFrame:
    """df with column expires_at."""
    return df.withColumn("expires_at", F.col(ts) + F.make_interval(hours=F.lit(hours)))


def not_expired(df: DataFrame, now: Column) -> DataFrame:
    return df.where(F.col("expires_at") > now)


def with_visibility(edges: DataFrame, blacklist: Sequence[str], label: str = "SECRET") -> DataFrame:
    """edges with column visibility: label where an end is on the blacklist, else empty."""
    listed = F.col("src").isin(*blacklist) | F.col("dst").isin(*blacklist)
    return edges.withColumn("visibility", F.when(listed, label).otherwise(""))


def metric_order(metrics: DataFrame, partitions: int | None = None) -> DataFrame:
    """metrics with each name in one partition, sorted by name and time, ready to be put."""
    spread = metrics.repartition(partitions, "name") if partitions else metrics.repartition("name")
    return spread.sortWithinPartitions("name", "time")


def encrypted(df: DataFrame, column: str, key: Column) -> DataFrame:
    """df with a text column encrypted and in hexadecimal digits."""
    return df.withColumn(column, F.hex(protect.encrypt(F.col(column), key)))


def decrypted(df: DataFrame, column: str, key: Column) -> DataFrame:
    return df.withColumn(column, protect.decrypt(F.unhex(column), key))


def by_geohash(points: DataFrame, path: str, prefix: int = 3) -> None:
    """Points in folders by the beginning of their geohash, so that readers prune by area."""
    code = geo.geohash(F.col("lat"), F.col("lon"), 12)
    made = points.where(geo.valid_point(F.col("lat"), F.col("lon"))).withColumn("geohash", code).withColumn("area", F.substring("geohash", 1, prefix))
    made.repartition("area").write.mode("overwrite").partitionBy("area").parquet(path)
