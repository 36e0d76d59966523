"""Tagging, clustering, embeddings and word vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer, Tokenizer, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    square = lambda p, q: F.pow(p.cast("double") - q.cast("double"), 2)
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, v: s + v))


def fit_tagger(docs: DataFrame, text: str = "text", tags: str = "tags", features: int = 2048, idf: bool = False) -> PipelineModel:
    """Naive Bayes over hashed words, normalised (or IDF-weighted), with one row for every tag of a document."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.explode(tags).alias("tag")).where("tag IS NOT NULL")
    scaled = IDF(inputCol="counts", outputCol="features") if idf else Normalizer(inputCol="counts", outputCol="features", p=2.0)
    stages = [
        StringIndexer(inputCol="tag", outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc"),
        Tokenizer(inputCol="text", outputCol="words"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        scaled,
        NaiveBayes(smoothing=1.0),
    ]
    return Pipeline(stages=stages).fit(rows)


def tag_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict_tags(model: PipelineModel, docs: DataFrame, text: str = "text", above: float = 0.25) -> DataFrame:
    """docs with tag (the likeliest) and tags: structs (tag, probability) above the threshold, likeliest first; null text has none."""
    names = F.array(*[F.lit(t) for t in tag_names(model)])
    prepared = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumnRenamed(text, "_own").withColumnRenamed("_text", "text")
    made = PipelineModel(model.stages[1:]).transform(prepared)
    listed = F.zip_with(names, vector_to_array("probability"), lambda n, p: F.struct((-p).alias("o"), n.alias("tag"), p.alias("probability")))
    kept = F.transform(F.array_sort(F.filter(listed, lambda s: s["probability"] > above)), lambda s: F.struct(s["tag"].alias("tag"), s["probability"].alias("probability")))
    empty = F.col("_own").isNull()
    best = F.element_at(names, (F.col("prediction") + 1).cast("int"))
    out = made.select(*[F.col("_own").alias(text) if c == text else F.col(c) for c in docs.columns], F.when(~empty, best).alias("tag"), F.when(empty, F.slice(kept, 1, 0)).otherwise(kept).alias("tags"))
    return out


#: Words that a worker embeds together; a batch of long texts is taken in parts.
WORDS_AT_ONCE = 1 << 17


def _parts(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of rows of so many words at most, or of one row."""
    out, lo, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            out.append((lo, i))
            lo, held = i, 0
        held += n
    return [*out, (lo, len(sizes))] if sizes else []


def embed(df: DataFrame, ident: str, text: str, size: int = 256, seed: int = 1) -> DataFrame:
    """(ident, vector): the words' sparse random directions, summed and scaled to length 1; zeros without words.

    Every word has four places of +1 or -1 by its hash (random indexing), so no vocabulary is kept.
    """
    count, at_once = 4, WORDS_AT_ONCE

    def of_part(s: list) -> np.ndarray:
        sizes = np.array([0 if t is None else len(t) for t in s], np.int64)
        doc = np.repeat(np.arange(len(s)), sizes)
        h = np.concatenate([np.asarray(t, np.int64) for t in s if t is not None and len(t)] or [np.zeros(0, np.int64)])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
        weight = np.sqrt(np.diff(np.append(first, len(h)))).astype(np.float32)
        own, of = h[first].view(np.uint64), doc[first]
        v = np.zeros((len(s), size), np.float32)
        for k in range(count):  # place and sign from different bits of a product with an odd number
            x = (own ^ (own >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 0x1000003D2 * k)
            np.add.at(v, (of, ((x >> np.uint64(20)) % np.uint64(size)).astype(np.int64)), np.where(x >> np.uint64(63), weight, -weight))
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1)

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for lo, hi in _parts([0 if t is None else len(t) for t in s], at_once):
                out += list(of_part(s.iloc[lo:hi].tolist()))
            yield pd.Series(out)

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashes = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(F.lit(seed), w))
    return df.select(F.col(ident).alias(ident), vector(hashes).alias("vector"))


def cluster(df: DataFrame, vector: str, k: int, seed: int = 1, iterations: int = 20):
    """(model, df with cluster and distance to its centre) by k-means; vector is an array of numbers."""
    from pyspark.ml.functions import array_to_vector

    made = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=iterations, initMode="k-means||", featuresCol="_v", predictionCol="cluster").fit(made)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    out = model.transform(made).drop("_v")
    return model, out.withColumn("distance", euclidean(F.col(vector), F.element_at(centres, F.col("cluster") + 1)))


def anomalies(df: DataFrame, columns: list[str], k: int = 5, seed: int = 1) -> DataFrame:
    """df with cluster and score: the distance to the own centre of the columns scaled to a sum of 1; nulls count as 0."""
    assembled = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df.na.fill(0, columns))
    scaled = Normalizer(inputCol="_raw", outputCol="_unit", p=1.0).transform(assembled).withColumn("_array", vector_to_array("_unit")).drop("_raw", "_unit")
    return cluster(scaled, "_array", k, seed)[1].drop("_array").withColumnRenamed("distance", "score")


def word_vectors(docs: DataFrame, text: str = "text", size: int = 50, least: int = 5, seed: int = 1):
    """Word2Vec model of the documents' lower-case words."""
    words = docs.where(F.col(text).isNotNull()).select(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}']+"), lambda w: w != "").alias("words"))
    return Word2Vec(vectorSize=size, minCount=least, seed=seed, numPartitions=1, inputCol="words", outputCol="v").fit(words)


def vectors_of(model) -> DataFrame:
    """(word, vector) of a word-vector model."""
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def analogy(model, plus: list[str], minus: list[str], n: int = 5) -> DataFrame:
    """(word, similarity): words nearest to a sum of words less others; the given words are left out."""
    rows = {r.word: np.array(r.vector) for r in vectors_of(model).where(F.col("word").isin(*plus, *minus)).collect()}
    from pyspark.ml.linalg import Vectors

    target = sum((rows[w] for w in plus if w in rows), np.zeros(model.getVectorSize())) - sum((rows[w] for w in minus if w in rows), np.zeros(model.getVectorSize()))
    return model.findSynonyms(Vectors.dense(target), n + len(plus) + len(minus)).where(~F.col("word").isin(*plus, *minus)).limit(n)


def most_similar(vectors: DataFrame, queries: DataFrame, n: int = 5, ident: str = "word", vector: str = "vector", block: int = 8192) -> DataFrame:
    """(src, dst, similarity): for each of queries' rows the n others of vectors with the largest positive cosine, ties by dst.

    Both have the ident and the vector (an array of numbers, equally long).
    Vectors and queries are cut into blocks by a hash; each block of queries
    meets each block of vectors in one task, as a product of matrices, and sends
    on n rows a query.
    """
    kind = vectors.schema[ident].dataType.simpleString()
    h, chosen = F.xxhash64(ident), [F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")]
    cut = lambda df: max(1, -(-df.count() // block))
    q, b = cut(queries), cut(vectors)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = queries.select(F.pmod(h, F.lit(q)).cast("int").alias("part"), every(b).alias("block"), *chosen)
    held = vectors.select(every(q).alias("part"), F.pmod(h, F.lit(b)).cast("int").alias("block"), *chosen)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        src, dst, found = [], [], []
        if len(left) and len(right):
            own, ids = np.array(left.column("id").to_pylist()), np.array(right.column("id").to_pylist())
            unit = lambda t: (lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))(np.stack(t.column("v").to_numpy()))
            y = unit(right)
            x = unit(left)
            for at in range(0, len(own), 512):
                d = x[at : at + 512] @ y.T
                d[own[at : at + 512][:, None] == ids] = 0
                for i, row in enumerate(d):
                    pick = np.flatnonzero((row > 0) & (row >= (np.partition(row, -n)[-n] if len(row) > n else 0)))
                    pick = pick[np.lexsort((ids[pick], -row[pick]))][:n]
                    src += [own[at + i].item()] * len(pick)
                    dst += ids[pick].tolist()
                    found += row[pick].tolist()
        to = left.schema.field("id").type
        return pa.table({"src": pa.array(src, to), "dst": pa.array(dst, to), "similarity": pa.array(found, pa.float64())})

    met = asked.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(search, f"src {kind}, dst {kind}, similarity double")
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def synonym_graph(vectors: DataFrame, words: DataFrame, n: int = 5) -> DataFrame:
    """(src, dst, weight): each of words' n nearest others by cosine, weights summing to 1. words has word."""
    own = vectors.join(words.select("word").distinct(), "word", "left_semi")
    found = most_similar(vectors, own, n)
    return found.select("src", "dst", (F.col("similarity") / F.sum("similarity").over(Window.partitionBy("src"))).alias("weight"))


def split_by_hash(df: DataFrame, key: str, share: float = 0.6, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two parts of df, about `share` of the keys in the first; the same in every run."""
    first = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)) < F.lit(round(share * 10_000))
    return df.where(first), df.where(~first)


def predict_direction(weeks: DataFrame, key: str = "common_friday", text: str = "text", label: str = "direction", share: float = 0.6, features: int = 10_000):
    """(model, predictions of the held-out weeks, accuracy) of a naive Bayes model of hashed, IDF-weighted words.

    weeks has a text and a label of 0.0 or 1.0 for every key; about `share` of
    the keys are trained on. Accuracy is null if no week is held out.
    """
    known = weeks.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    fit, held = split_by_hash(known, key, share)
    stages = [Tokenizer(inputCol=text, outputCol="_words"), HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features), IDF(inputCol="_counts", outputCol="_scaled"), NaiveBayes(featuresCol="_scaled", labelCol=label)]
    model = Pipeline(stages=stages).fit(fit)
    made = model.transform(held).select(*weeks.columns, "prediction")
    return model, made, made.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]


def anchor_scores(texts: DataFrame, ident: str, words: str, vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """(ident, anchor, score): mean cosine of a text's words (an array) to each anchor word's vector. anchors has anchor."""
    exploded = texts.select(ident, F.explode(words).alias("word")).join(vectors, "word")
    fixed = anchors.join(vectors.select(F.col("word").alias("anchor"), F.col("vector").alias("b")), "anchor")
    return exploded.crossJoin(F.broadcast(fixed)).groupBy(ident, "anchor").agg(F.avg(cosine(F.col("vector"), F.col("b"))).alias("score"))  # a few anchors


def decayed_update(centres: np.ndarray, weights: np.ndarray, sums: np.ndarray, counts: np.ndarray, half_life: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and weights after a batch: what was known before counts half after half_life batches."""
    old = weights * 0.5 ** (1 / half_life)
    new = old + counts
    moved = np.where(new[:, None] > 0, (centres * old[:, None] + sums) / np.maximum(new, 1e-12)[:, None], centres)
    return np.where((counts > 0)[:, None], moved, centres), new
