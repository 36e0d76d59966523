"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._frames import quoted


def _known(labels: DataFrame, label: str, ident: str) -> DataFrame:
    """(id, y) of every labelled id."""
    return (
        labels.select(F.col(quoted(ident)).alias("id"), F.col(quoted(label)).cast("int").alias("y"))
        .where("id IS NOT NULL AND y IN (0, 1)")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )


def class_weights(labels: DataFrame, label: str, rows: int, ident: str = "doc_id") -> tuple[float, float]:
    """Labelled ids that each sampled one of class 0 and of class 1 stands for; 1 where labelled_sample takes all."""
    counts = {r["y"]: r["n"] for r in _known(labels, label, ident).groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    half = max(1, rows // 2)
    return tuple(max(1.0, counts.get(y, 0) / half) for y in (0, 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(h, y, text) of at most rows labelled documents, at most half of them from each class 0 and 1.

    The rows with the smallest hash of the id are taken, so the sample is the
    same in every run and needs no sort of all labels (a top-k of each
    partition). An id with several labels counts as 1 if any of them is 1; of
    rows with the same id one text is taken. Rows with null are left out.
    """
    known = _known(labels, label, ident).withColumn("h", F.xxhash64("id"))
    half = max(1, rows // 2)
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("h", "id").limit(half)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col(quoted(ident)).alias("id"), F.col(quoted(text)).alias("text")).where("text IS NOT NULL")
    found = texts.join(F.broadcast(chosen), "id")  # at most `rows` ids
    return found.groupBy("id").agg(F.first("h").alias("h"), F.first("y").alias("y"), F.min("text").alias("text")).select("h", "y", "text")
