"""Stories: clusters of articles that follow a stream, and their drift from batch to batch."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators.learning import decayed_update
from gristmill.storage import mounted, write_once


def assign(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """df with cluster (number of the nearest centre) and distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(centres.astype(np.float64))

    @F.pandas_udf("cluster int, distance double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for vectors in batches:
            x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, c.shape[1]))
            d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)
            best = d.argmin(1)
            yield pd.DataFrame({"cluster": best.astype(np.int32), "distance": np.sqrt(d[np.arange(len(x)), best])})

    return df.withColumn("_c", nearest(F.col(vector))).select(*df.columns, "_c.cluster", "_c.distance")


def batch_sums(assigned: DataFrame, vector: str, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of vectors and counts of every cluster (k rows come to the driver)."""
    parts = assigned.select("cluster", F.posexplode(vector).alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    sums, counts = np.zeros((k, size)), np.zeros(k)
    for r in parts.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("l"), F.max("n").alias("n")).collect():
        sums[r.cluster] = [e.s for e in r.l]
        counts[r.cluster] = r.n
    return sums, counts


def summarise(assigned: DataFrame, entities: list[str], offset: int = 0, top: int = 5) -> DataFrame:
    """One row a cluster: story id (offset + cluster), articles, first date, mean tone, title and url of the article next to the centre, and the top entities of each array column.

    Clusters without articles have no row; a null tone counts as 0; ties go by url and by entity.
    """
    key = (F.col("cluster") + offset).cast("bigint").alias("story")
    base = assigned.groupBy(key).agg(
        F.count("*").alias("articles"),
        F.min("date").alias("first_date"),
        F.avg(F.coalesce("tone", F.lit(0.0))).alias("tone"),
        F.min(F.struct("distance", "url", "title")).alias("b"),
    )
    out = base.select("story", "articles", "first_date", "tone", "b.title", "b.url")
    for column in entities:
        counted = assigned.select(key, F.explode(column).alias("e")).groupBy("story", "e").agg(F.count("*").alias("n"))
        ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("story").orderBy(F.desc("n"), "e"))).where(F.col("r") <= top)
        listed = F.transform(F.sort_array(F.collect_list(F.struct("r", "e"))), lambda s: s["e"])
        out = out.join(ranked.groupBy("story").agg(listed.alias(column)), "story", "left")
        out = out.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, target, n): articles (url, story) of each old story in each new one."""
    a = before.select("url", F.col("story").alias("source"))
    return a.join(after.select("url", F.col("story").alias("target")), "url").groupBy("source", "target").agg(F.count("*").alias("n"))


class StoryClusters:
    """Streaming k-means with a half-life; step() is a function for foreachBatch over (url, title, date, tone, vector, entity arrays).

    Each batch writes articles, stories and drift under its number, and the
    centres after it; running a batch again starts from the centres before it.
    """

    def __init__(self, spark: SparkSession, folder: str, k: int, size: int, half_life: float = 5.0, window: int = 4, entities: tuple[str, ...] = (), seed: int = 1):
        self.spark, self.folder, self.k, self.size, self.half_life, self.window, self.entities, self.seed = spark, folder, k, size, half_life, window, list(entities), seed

    def _state(self, batch_id: int) -> tuple[np.ndarray, np.ndarray]:
        path = f"{mounted(self.folder)}/centres/{batch_id}.json"
        if os.path.exists(path):
            with open(path) as f:
                s = json.load(f)
            return np.array(s["centres"]), np.array(s["weights"])
        return np.random.default_rng(self.seed).normal(size=(self.k, self.size)), np.zeros(self.k)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        centres, weights = self._state(batch_id - 1)
        batch.write.mode("overwrite").parquet(f"{self.folder}/input/batch={batch_id}")
        rows = self.spark.read.parquet(f"{self.folder}/input/batch={batch_id}")
        if not weights.any() and not rows.isEmpty():  # start from articles of the first batch
            first = rows.orderBy(F.xxhash64("url"), "url").limit(self.k).collect()
            centres[: len(first)] = [r.vector for r in first]
        sums, counts = batch_sums(assign(rows, "vector", centres), "vector", self.k, self.size)
        centres, weights = decayed_update(centres, weights, sums, counts, self.half_life)
        os.makedirs(f"{mounted(self.folder)}/centres", exist_ok=True)
        write_once(f"{mounted(self.folder)}/centres/{batch_id}.json", json.dumps({"centres": centres.tolist(), "weights": weights.tolist()}).encode())
        placed = assign(rows, "vector", centres).withColumn("story", (F.col("cluster") + batch_id * self.k).cast("bigint"))
        placed.select("url", "story", "vector").write.mode("overwrite").parquet(f"{self.folder}/articles/batch={batch_id}")
        summarise(placed.drop("story"), self.entities, batch_id * self.k).write.mode("overwrite").parquet(f"{self.folder}/stories/batch={batch_id}")
        past = [b for b in range(max(0, batch_id - self.window), batch_id) if os.path.exists(f"{mounted(self.folder)}/articles/batch={b}")]
        if past:
            old = self.spark.read.parquet(*[f"{self.folder}/articles/batch={b}" for b in past])
            new = assign(old, "vector", centres).select("url", (F.col("cluster") + batch_id * self.k).cast("bigint").alias("story"))
            drift(old, new).write.mode("overwrite").parquet(f"{self.folder}/drift/batch={batch_id}")
