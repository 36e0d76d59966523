"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of the lower-cased whole text,
hashed to buckets. A feature's value is the log ratio of its smoothed share
among toxic and among clean training texts; a logistic regression over these
values is fitted by mini-batch AdaGrad in numpy. The training rows are a
bounded sample of the labelled rows (TRAIN_ROWS, at most half from each class,
chosen by a hash of the id). Where that changes the ratio of the classes, the
threshold and the log odds are those of the ratio among all labels. Scoring
covers every text from start to end.
Weight times ratio is one number a bucket, 4 MB in all, sent to every worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._arrays import distinct_by_doc, gram_parts, slices, sums
from gristmill.llm._frames import fresh, quoted
from gristmill.llm._labelled import class_weights, labelled_sample

SIZES = (4, 5, 6)
BITS = 20
#: At most so many labelled rows are used to fit the classifier.
TRAIN_ROWS = 6000
MIN_TEXTS = 4
PENALTY = 0.003
EPOCHS = 12


@dataclass
class Model:
    weights: np.ndarray  # float32 of every bucket
    bias: float
    threshold: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Log odds of toxicity of every text."""
        out = np.zeros(len(column))
        used = self.weights != 0
        for a, b, bucket, doc in distinct_parts(column, used):
            out[a:b] = sums(self.weights[bucket], doc, b - a)
        return out + self.bias


def distinct_parts(column: pa.Array, used: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, buckets, text indexes): each distinct bucket of every text, ordered; used leaves out the others.

    A long text's buckets are marked in a table while its parts are read.
    """
    marks, row = None, -1
    for a, b, bucket, doc in gram_parts(column, SIZES, BITS, padded=True):
        if marks is not None and a != row:
            yield row, row + 1, *_listed(marks)
            marks = None
        if used is not None:
            some = used[bucket]
            bucket, doc = bucket[some], doc[some]
        if b - a > 1:
            yield a, b, *distinct_by_doc(bucket, doc, BITS)
            continue
        if marks is None:
            marks, row = np.zeros(2**BITS, bool), a
        marks[bucket] = True
    if marks is not None:
        yield row, row + 1, *_listed(marks)


def _listed(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bucket = np.flatnonzero(marks).astype(np.uint32)
    return bucket, np.zeros(len(bucket), np.int32)


def features(column: pa.Array) -> list[np.ndarray]:
    """Distinct buckets of every text."""
    out = []
    for a, b, bucket, doc in distinct_parts(column):
        out += np.split(bucket, np.searchsorted(doc, np.arange(1, b - a)))
    return out


def log_count_ratios(
    rows: list[np.ndarray], toxic: np.ndarray, smooth: float = 1.0, least: int = MIN_TEXTS, sizes: np.ndarray | None = None, features: int = 2**BITS
) -> np.ndarray:
    """ln of a bucket's share in toxic texts over its share in clean ones; 0 for buckets of fewer than least texts.

    sizes has the texts' numbers of buckets where rows lack those of fewer than
    least texts; features is the number of buckets that rows still have.
    """
    counts, total = [np.zeros(features), np.zeros(features)], [smooth * 2**BITS] * 2
    for k, (r, y) in enumerate(zip(rows, toxic)):
        counts[int(y)][r] += 1
        total[int(y)] += len(r) if sizes is None else sizes[k]
    shares = [(c + smooth) / t for c, t in zip(counts, total)]
    ratio = np.log(shares[1] / shares[0])
    ratio[counts[0] + counts[1] < least] = 0
    return ratio.astype(np.float32)


def _regression(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Logistic regression on the ratio-scaled features; weights already multiplied by the ratios."""
    scale = ratio.astype(np.float64)
    w, g2, bias, bias_g2 = np.zeros(len(ratio)), np.full(len(ratio), 1e-6), 0.0, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            index = np.concatenate([rows[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            z = np.bincount(doc, (w * scale)[index], len(batch)) + bias
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]
            g = np.bincount(index, error[doc], len(ratio)) * scale / len(batch) + PENALTY * w
            g2 += g * g
            w -= 0.05 * g / np.sqrt(g2)
            gb = error.mean()
            bias_g2 += gb * gb
            bias -= 0.05 * gb / np.sqrt(bias_g2)
    return (w * scale).astype(np.float32), bias


def fit(
    rows: list[np.ndarray], toxic: np.ndarray, seed: int = 7, sizes: np.ndarray | None = None, weights: tuple[float, float] = (1.0, 1.0), features: int = 2**BITS
) -> Model:
    """Fit on four fifths, set the threshold on the rest, then fit on all with that threshold.

    The threshold is the middle of the scores at which the held-out rows are
    told apart with the highest F1, where each row counts with the weight of its
    class (clean, toxic). Rows of one class only give a model that rejects
    everything or nothing.
    """
    y = np.asarray(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(features, np.float32), 10.0 if len(y) and y[0] else -10.0, 0.0)
    held = np.arange(len(y)) % 5 == 0
    sizes = np.array([len(r) for r in rows]) if sizes is None else sizes
    part = [r for r, h in zip(rows, held) if not h]
    threshold = 0.0
    if len(set(y[held])) == 2 and len(set(y[~held])) == 2:
        w, b = _regression(part, y[~held], log_count_ratios(part, y[~held], sizes=sizes[~held], features=features), seed)
        z = np.array([w[r].sum() + b for r, h in zip(rows, held) if h])
        order = np.argsort(-z)
        weight = np.where(y[held] == 1, weights[1], weights[0])
        hit = np.cumsum((weight * y[held])[order])
        f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y[held]).sum())
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        low = int(best[len(best) // 2])
        threshold = float((z[order][low] + z[order][min(low + 1, len(z) - 1)]) / 2)
    w, b = _regression(rows, y, log_count_ratios(rows, y, sizes=sizes, features=features), seed)
    shift = float(np.log(weights[1] / weights[0]))
    return Model(w, b + shift, threshold + shift)


def _packed(row: np.ndarray) -> bytes:
    """Ordered buckets as their low 16 bits after the number of buckets of each value of the other bits."""
    return np.bincount(row >> np.uint32(16), minlength=1 << (BITS - 16)).astype(np.uint32).tobytes() + row.astype(np.uint16).tobytes()


def _unpacked(data) -> np.ndarray:
    counts = np.frombuffer(data, np.uint32, 1 << (BITS - 16))
    low = np.frombuffer(data, np.uint16, offset=counts.nbytes)
    return (np.repeat(np.arange(len(counts), dtype=np.uint32), counts) << np.uint32(16)) | low


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(2), 4_000_000):
            part = batch.slice(a, b - a)
            rows = [_packed(r) for r in features(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["h", "y", "buckets"])


def _trained(table: pa.Table, weights: tuple[float, float]) -> pa.Table:
    h, y = table.column("h").to_numpy(), table.column("y").to_numpy()
    views = [b.as_buffer() for b in table.column("buckets")]
    texts, sizes = np.zeros(2**BITS, np.int32), np.zeros(len(views), np.int64)
    for i, v in enumerate(views):
        row = _unpacked(v)
        texts[row] += 1
        sizes[i] = len(row)
    common = np.flatnonzero(texts >= MIN_TEXTS).astype(np.uint32)  # the others have no weight anyway
    place = np.zeros(2**BITS, np.uint32)
    place[common] = np.arange(len(common), dtype=np.uint32)
    ends = np.zeros(len(views) + 1, np.int64)
    order = np.lexsort((y, h))
    flat = np.empty(int(texts[common].sum()), np.uint32)  # all rows, one after the other: as numbers of common buckets
    for k, i in enumerate(order):
        row = _unpacked(views[i])
        row = place[row[texts[row] >= MIN_TEXTS]]
        ends[k + 1] = ends[k] + len(row)
        flat[ends[k] : ends[k + 1]] = row
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    model = fit(rows, y[order], sizes=sizes[order], weights=weights, features=len(common))
    used = np.flatnonzero(model.weights)
    return pa.table({"used": [common[used].tobytes()], "weights": [model.weights[used].tobytes()], "bias": [model.bias], "threshold": [model.threshold]})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", ident: str = "doc_id") -> Model:
    """Model of at most rows labelled texts; one executor fits it, the driver gets the finished weights.

    Rows with null id, text or label aren't used. Without usable rows nothing is toxic.
    """
    sample = labelled_sample(docs, labels, "toxic", rows, text, ident)
    shares = class_weights(labels, "toxic", rows, ident)
    got = sample.mapInArrow(_featurize, "h bigint, y int, buckets binary").groupBy(F.lit("all")).applyInArrow(
        lambda table: _trained(table, shares), "used binary, weights binary, bias double, threshold double"
    )
    found = got.collect()
    weights = np.zeros(2**BITS, np.float32)
    if not found:
        return Model(weights, -10.0, 0.0)
    weights[np.frombuffer(found[0]["used"], np.uint32)] = np.frombuffer(found[0]["weights"], np.float32)
    return Model(weights, found[0]["bias"], found[0]["threshold"])


def _scorer(model, text: str, keep: list[str], only_clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            score = m.scores(column)
            toxic = score > m.threshold
            toxic[column.is_null().to_numpy(zero_copy_only=False)] = False
            if only_clean:
                yield batch.filter(pa.array(~toxic))
            else:
                kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array(toxic.astype(np.int32))], names=[*keep, "score", "toxic"])

    return run


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, score, toxic) of every row: log odds, and 1 where they exceed the model's threshold.

    Null text is never toxic and has the score of an empty text, the model's
    bias. Repeated rows and null ids are scored like any others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[ident].dataType.simpleString()
    narrow = docs.select(F.col(quoted(ident)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    return narrow.mapInArrow(_scorer(shared, "text", ["doc_id"], False), f"doc_id {kind}, score double, toxic int")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of docs that score_toxicity doesn't call toxic, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scorer(shared, text, [], True), docs.schema)
