"""Trending keys and tagging on streams.

Windows use event time with a watermark of one slide: later rows are dropped.
"""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import learning
from gristmill.storage import mounted, write_once


def trend_counts(stream: DataFrame, ts: str, key: str, length: str = "48 hours", slide: str = "15 minutes", late: str | None = None) -> DataFrame:
    """(window_start, window_end, key, n) over a stream (or a table)."""
    marked = stream.withWatermark(ts, late or slide) if stream.isStreaming else stream
    counted = marked.groupBy(F.window(ts, length, slide).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "n")


def top_keys(counts: DataFrame, k: int = 100) -> DataFrame:
    """The k most frequent keys of the latest window, ties by key."""
    last = counts.agg(F.max("window_end").alias("window_end"))
    return counts.join(F.broadcast(last), "window_end").orderBy(F.desc("n"), "key").limit(k)  # one row


def linked_tags(messages: DataFrame, body: str = "body") -> DataFrame:
    """(url, tags): the hashtags that messages give to the links in them."""
    pairs = messages.select(F.explode(T.urls(F.col(body))).alias("url"), T.hashtags(F.col(body)).alias("tags"))
    return pairs.select("url", F.explode("tags").alias("tag")).groupBy("url").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


class ModelStore:
    """Versions of a model in a shared folder; readers see only complete ones."""

    def __init__(self, folder: str):
        self.folder = folder

    def save(self, model: PipelineModel, version: int) -> None:
        """Write a version and then point to it; saving the same version again replaces it."""
        model.write().overwrite().save(f"{self.folder}/v{version}")
        write_once(f"{mounted(self.folder)}/current.json", json.dumps({"version": version}).encode())

    def load(self) -> PipelineModel | None:
        path = f"{mounted(self.folder)}/current.json"
        if not os.path.exists(path):
            return None
        with open(path) as f:
            return PipelineModel.load(f"{self.folder}/v{json.load(f)['version']}")


class TrendTagger:
    """Learns tags from one stream of messages and gives them to another stream of articles.

    learn() and tag() are functions for foreachBatch. Training uses the batch
    and the stored rows of the last ttl_hours. Rows are stored by batch, so a
    batch that runs again replaces its own.
    """

    def __init__(self, spark: SparkSession, folder: str, ttl_hours: int = 48, least_words: int = 500, top: int = 100):
        self.spark, self.folder, self.ttl, self.least_words, self.top = spark, folder, ttl_hours, least_words, top
        self.models = ModelStore(f"{folder}/models")

    def learn(self, batch: DataFrame, batch_id: int) -> None:
        """batch has (url, body, tags, time): articles and the tags of their links."""
        counts = batch.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
        trending = counts.orderBy(F.desc("n"), "tag").limit(self.top).select("tag")
        long = batch.where(F.size(T.words(F.col("body"))) >= self.least_words)
        kept = long.select("url", "body", "time", F.explode("tags").alias("tag")).join(F.broadcast(trending), "tag", "left_semi")  # at most `top` rows
        grouped = kept.groupBy("url", "body", "time").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
        grouped.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch_id}")
        rows = self.spark.read.schema(grouped.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/rows")
        last = rows.agg(F.max("time").alias("last"))
        fresh = rows.crossJoin(F.broadcast(last)).where(F.col("time") >= F.col("last") - F.make_interval(hours=F.lit(self.ttl))).drop("last")
        if not fresh.isEmpty():
            self.models.save(learning.fit_tagger(fresh, "body"), batch_id)

    def tag(self, batch: DataFrame, batch_id: int) -> None:
        """batch has (url, body): writes the articles of more than 255 characters with their tags (none while there is no model)."""
        model = self.models.load()
        articles = batch.where(F.length("body") > 255)
        if model is None:
            out = articles.withColumns({"tag": F.lit(None).cast("string"), "tags": F.array().cast("array<struct<tag: string, probability: double>>")})
        else:
            out = learning.predict_tags(model, articles, "body")
        out.write.mode("overwrite").parquet(f"{self.folder}/tagged/batch={batch_id}")
