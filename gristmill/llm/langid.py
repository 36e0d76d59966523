"""Language identification by multinomial naive Bayes over hashed character n-grams.

The matrix of log probabilities (languages x buckets) is fitted on a bounded
sample of labelled rows (TRAIN_ROWS of each language, chosen by a hash of the
id) and broadcast; its size depends on the number of languages only. Scoring
adds up the matrix columns of a batch's n-grams in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._arrays import gram_parts, sums
from gristmill.llm._frames import quoted

SIZES = (1, 2, 3)
BITS = 16
SMOOTH = 0.5
#: At most so many rows of each language are used to fit the model.
TRAIN_ROWS = 1000


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # (languages, buckets) float32, log probabilities
    prior: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        """(texts, languages): log of prior times likelihood."""
        out = np.zeros((len(column), len(self.languages)))
        for a, b, bucket, doc in gram_parts(column, SIZES, BITS, padded=True):
            for k, row in enumerate(self.matrix):
                out[a:b, k] += sums(row[bucket], doc, b - a)
        return out + self.prior


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for name in langs:
            rows[name] = rows.get(name, 0) + 1
        for a, b, bucket, doc in gram_parts(batch.column(1), SIZES, BITS, padded=True):
            names = sorted(set(langs[a:b]))
            which = np.searchsorted(names, langs[a:b])
            for k, name in enumerate(names):
                made = np.bincount(bucket[which[doc] == k], minlength=2**BITS)
                counts[name] = counts.get(name, 0) + made
    names = sorted(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([rows[n] for n in names], pa.int64()), pa.array([counts[n].astype(np.int64).tobytes() for n in names], pa.binary())],
        names=["lang", "rows", "counts"],
    )


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), np.int64) for c in table.column("counts"))
    log = np.log((total + SMOOTH) / (total.sum() + SMOOTH * len(total))).astype(np.float32)
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "rows": [pc.sum(table.column("rows")).as_py()], "log": pa.array([log.tobytes()], pa.binary())})


def train(docs: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", ident: str = "doc_id", lang: str = "lang") -> Model:
    """Model of at most rows texts of each language in column lang (null languages and texts are left out).

    The prior is uniform. The row_number filter becomes a top-k of each
    partition before any shuffle, of ids only.
    """
    named = docs.select(F.col(quoted(ident)).alias("id"), F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(text)).alias("text")).where(
        "id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"
    )
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = named.select("lang", "id", F.xxhash64("id").alias("h")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows)
    sample = named.join(F.broadcast(chosen.select("lang", "id").distinct()), ["lang", "id"])
    parts = sample.select("lang", "text").mapInArrow(_count, "lang string, rows bigint, counts binary")
    found = sorted(parts.groupBy("lang").applyInArrow(_add, "lang string, rows bigint, log binary").collect(), key=lambda r: r["lang"])
    matrix = np.array([np.frombuffer(r["log"], np.float32) for r in found], np.float32).reshape(len(found), 2**BITS)
    return Model([r["lang"] for r in found], matrix, np.zeros(len(found)))


def identify_language(docs: DataFrame, model: Model, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, language, probability) of every row; among equal scores the first language in alphabetical order.

    Null and empty texts, and all texts if the model knows no language, have
    null language and probability. Repeated rows are scored like any others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = len(batch)
            none = pc.fill_null(pc.equal(pc.binary_length(batch.column(1)), 0), True).to_numpy(zero_copy_only=False)
            if not m.languages:
                best, p, none = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
            else:
                z = m.scores(batch.column(1))
                best = z.argmax(1)
                p = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
            names = pa.array(np.array(m.languages or [""], object)[best], pa.string(), mask=none)
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(p, mask=none)], names=["doc_id", "language", "probability"])

    kind = docs.schema[ident].dataType.simpleString()
    narrow = docs.select(F.col(quoted(ident)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, language string, probability double")
