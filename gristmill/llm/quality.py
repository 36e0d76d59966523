"""Quality classifier: averaged hashed subword embeddings with a softmax output.

A text's features are its words, pairs of neighbouring words and character
n-grams (case kept), hashed to buckets that each have a learned vector; the
mean of the vectors goes through a linear layer and a softmax. Both layers are
trained by stochastic gradient descent in numpy, in one executor task, on a
bounded sample of the labelled rows (TRAIN_ROWS, at most half from each class).
Where that changes the ratio of the classes, the log odds are shifted back to
the ratio among all labels, so that decisions don't depend on the bound.

For scoring the output layer is folded into the table: the mean of vectors
times a matrix is the mean of the buckets' products with it. So each feature
costs one look-up of two numbers, and the whole text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._arrays import BYTES, U, gram_parts, mix, owners, slices, sums, text_buffers, word_hashes
from gristmill.llm._frames import quoted
from gristmill.llm._labelled import class_weights, labelled_sample

SIZES = (3, 4)
BITS = 18
DIMENSIONS = 12
#: At most so many labelled rows are used to fit the classifier.
TRAIN_ROWS = 4000
EPOCHS = 6
RATE = 1.0


def feature_parts(column: pa.Array, limit: int = 500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, buckets, text indexes) of every feature occurrence; rows come in more than one part."""
    shift = U(64 - BITS)
    for a, b in slices(column, limit):
        words, offsets = word_hashes(*text_buffers(column[a:b]), BYTES)
        doc = owners(offsets)
        for at in range(0, len(words), limit):
            own, after, of = words[at : at + limit], words[at + 1 : at + limit + 1], doc[at : at + limit + 1]
            same = of[1:] == of[:-1]
            pairs = mix(own[: len(after)] * U(3) + after * U(0x9E3779B97F4A7C15))[same]
            yield a, b, np.concatenate((own >> shift, pairs >> shift)).astype(np.uint32), np.concatenate((of[: len(own)], of[1:][same]))
    for a, b, bucket, doc in gram_parts(column, SIZES, BITS, lower=False, padded=True, limit=limit):
        yield a, b, bucket, doc.astype(np.int64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every feature occurrence of every text."""
    parts = [(bucket, doc + a) for a, _, bucket, doc in feature_parts(column)]
    return np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint32)]), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])


@dataclass
class Model:
    table: np.ndarray  # (buckets, 2): each bucket's vector times the output layer
    shift: float = 0.0  # log ratio of the classes among all labels over that among the training rows

    def probability(self, column: pa.Array) -> np.ndarray:
        """Probability of class 1 of every text."""
        n, z = np.zeros(len(column)), np.zeros(len(column))
        odds = self.table[:, 1] - self.table[:, 0]
        for a, b, bucket, doc in feature_parts(column):
            n[a:b] += np.bincount(doc, minlength=b - a)
            z[a:b] += sums(odds[bucket], doc, b - a)
        return 1 / (1 + np.exp(-np.clip(z / np.maximum(n, 1) + self.shift, -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 11, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Train on (distinct buckets, their counts) of every text; one step a text, the rate falls to 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (2**BITS, DIMENSIONS)).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), np.float32)
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, count = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(bucket):
                continue
            share = (count / count.sum()).astype(np.float32)
            hidden = share @ vectors[bucket]
            z = output @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = p @ output
            output -= lr * np.outer(p, hidden).astype(np.float32)
            vectors[bucket] -= (lr * len(bucket) ** 0.5) * np.outer(share, back).astype(np.float32)
    return Model(vectors @ output.T)


def counted(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, counts) of every text."""
    out = []
    for a, b in slices(column, 1_000_000):
        if b - a == 1:  # perhaps long: counted in a table
            count = np.zeros(2**BITS)
            for _, _, bucket, _ in feature_parts(column[a:b]):
                count += np.bincount(bucket, minlength=2**BITS)
            bucket = np.flatnonzero(count).astype(np.uint32)
            out.append((bucket, count[bucket].astype(np.float32)))
            continue
        bucket, doc = features(column[a:b])
        key = np.sort((doc.astype(U) << U(BITS)) | bucket)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key))).astype(np.float32)
        bucket = (key[first] & U(2**BITS - 1)).astype(np.uint32)
        cuts = np.searchsorted(key[first] >> U(BITS), np.arange(1, b - a, dtype=U))
        out += list(zip(np.split(bucket, cuts), np.split(count, cuts)))
    return out


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = counted(batch.column(2))
        made = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["h", "y", "buckets", "counts"])


def _trainer(table: pa.Table) -> pa.Table:
    table = table.sort_by([("h", "ascending"), ("y", "ascending")])
    rows = [
        (np.frombuffer(b.as_py(), np.uint32), np.frombuffer(c.as_py(), np.float32))
        for b, c in zip(table.column("buckets"), table.column("counts"))
    ]
    return pa.table({"model": pa.array([fit(rows, table.column("y").to_numpy()).table.astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", ident: str = "doc_id") -> Model:
    """Model of at most rows labelled texts. Without any, every text has probability one half."""
    sample = labelled_sample(docs, labels, "quality", rows, text, ident)
    bad, good = class_weights(labels, "quality", rows, ident)
    fitted = sample.mapInArrow(_featurize, "h bigint, y int, buckets binary, counts binary").groupBy(F.lit("all")).applyInArrow(_trainer, "model binary")
    found = fitted.collect()  # one row of 2 MB
    if not found:
        return Model(np.zeros((2**BITS, 2), np.float32))
    return Model(np.frombuffer(found[0]["model"], np.float32).reshape(-1, 2), float(np.log(good / bad)))


def score_quality(docs: DataFrame, model: Model, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, probability, quality) of every row: probability of good quality, and 1 where it is at least one half.

    Null and empty texts have no features: their probability is one half and
    their quality null. Repeated rows and null ids are scored like any others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            p = shared.value.probability(batch.column(1))
            none = pc.fill_null(pc.equal(pc.binary_length(batch.column(1)), 0), True).to_numpy(zero_copy_only=False)
            p[none] = 0.5
            label = pa.array((p >= 0.5).astype(np.int32), mask=none)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), label], names=["doc_id", "probability", "quality"])

    kind = docs.schema[ident].dataType.simpleString()
    narrow = docs.select(F.col(quoted(ident)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, probability double, quality int")
