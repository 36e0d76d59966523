"""Kneser-Ney model against a dictionary implementation of the same formulas."""

import math
import os
import random
import resource
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import _arrays
from gristmill.llm import lm_scoring as L
from gristmill.llm import queries

SCHEMA = "doc_id bigint, text string"


def texts(seed=4, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(400)]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12, 60]))) for _ in range(n)]
    return [*out, out[0], out[0], "", "Zebra zebra", None]


class Plain:
    """The model with dictionaries."""

    def __init__(self, docs, order, least=1):
        self.order, self.least = order, least
        self.counts = {order: Counter()}
        for t in docs:
            if t is not None:
                seq = ["<s>"] * (order - 1) + t.lower().split() + ["</s>"]
                self.counts[order].update(tuple(seq[i - order + 1 : i + 1]) for i in range(order - 1, len(seq)))
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter()
            for g, c in self.counts[n + 1].items():
                self.counts[n][g[1:]] += c if g[1] == "<s>" else 1
        self.contexts = {n: defaultdict(Counter) for n in self.counts}
        for n, counts in self.counts.items():
            for g, c in counts.items():
                self.contexts[n][g[:-1]][min(c, 3)] += 1
                self.contexts[n][g[:-1]]["total"] += c
        self.d = {}
        for n, counts in self.counts.items():
            of = Counter(counts.values())
            self.d[n] = L.discounts(of[1], of[2], of[3], of[4])

    def p(self, words):
        value = 1 / (len(self.counts[1]) + 1)
        for n in range(1, self.order + 1):
            g = words[len(words) - n :]
            about = self.contexts[n].get(g[:-1])
            if not about:
                continue
            d = self.d[n]
            c = self.counts[n][g]
            top = n == self.order
            kept = max(c - d[min(c, 3) - 1], 0) if c and not (top and c < self.least) else 0
            lost = sum((k if top and k < self.least else d[k - 1]) * about[k] for k in (1, 2, 3))
            value = (kept + lost * value) / about["total"]
        return value

    def log(self, text):
        seq = ["<s>"] * (self.order - 1) + text.lower().split() + ["</s>"]
        return sum(math.log(self.p(tuple(seq[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(seq)))


@pytest.mark.parametrize("order,least", [(1, 1), (2, 1), (3, 1), (3, 2)])
def test_scores_equal_plain_model(spark, order, least):
    docs = texts()
    df = spark.createDataFrame(list(enumerate(docs)), SCHEMA)
    folder = L.train(df, order, least)
    plain = Plain(docs, order, least)
    asked = [*docs, "w1 w2 unseen words w3", "w1"]
    got = L.score(spark.createDataFrame(list(enumerate(asked)), SCHEMA), folder).collect()
    assert len(got) == len(asked)
    for r in got:
        t = asked[r.doc_id]
        if t is None:
            assert (r.n_tokens, r.log_prob, r.perplexity) == (0, None, None)
        else:
            assert r.n_tokens == len(t.split()) + 1
            assert r.log_prob == pytest.approx(plain.log(t), rel=1e-9)
            assert r.perplexity == pytest.approx(math.exp(-r.log_prob / r.n_tokens), rel=1e-9)
    context = ("w1",) * (order - 1)
    words = {g[0] for g in plain.counts[1]}
    assert sum(plain.p((*context, w)) for w in words) + plain.p((*context, "unseen")) == pytest.approx(1)


def test_combining_in_small_portions_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "COMBINE", 50)
    monkeypatch.setattr(L, "BLOCK", 7)
    monkeypatch.setattr(L, "SHARD_BYTES", 200)
    docs = texts(9, 40)
    df = spark.createDataFrame(list(enumerate(docs)), SCHEMA).repartition(5)
    plain = Plain(docs, 2)
    for r in L.score(df, L.train(df, 2)).collect():
        if docs[r.doc_id] is not None:
            assert r.log_prob == pytest.approx(plain.log(docs[r.doc_id]), rel=1e-9)


def test_query_scores_with_five_words(spark, tmp_path):
    docs = texts(5, 60)
    spark.createDataFrame(list(enumerate(docs)), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    plain = Plain(docs, 5)
    got = {r.doc_id: r.log_prob for r in queries.op1_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for k, t in enumerate(docs):
        assert got[k] == (None if t is None else pytest.approx(plain.log(t), rel=1e-9))


def test_more_shards_than_open_files(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_BYTES", 10)
    docs = texts(6, 60)
    model = L.Model(L.train(spark.createDataFrame(list(enumerate(docs)), SCHEMA), 3))
    assert model.shards > 200
    plain = Plain(docs, 3)
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 540, hard))
    try:
        for t in (docs[0], docs[-2], "w1 unseen"):
            seq, offsets = L.sequences(*_arrays.word_hashes(*_arrays.text_buffers(pa.array([t]))), 3)
            assert model.log_probabilities(seq, np.arange(2, offsets[1])).sum() == pytest.approx(plain.log(t), rel=1e-9)
        every = np.arange(0, 2**64, 2**52, dtype=np.uint64)  # some in each shard
        assert all(len(f) == len(every) for level in (1, 2, 3) for f in model.look_up(level, every))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))


@pytest.mark.parametrize("order,part_bytes", [(2, 1 << 20), (3, 1000), (4, 1 << 20), (5, 1000)])
def test_own_scores_equal_plain_model(spark, monkeypatch, order, part_bytes):
    monkeypatch.setattr(L, "PART_BYTES", part_bytes)
    monkeypatch.setattr(L, "COMBINE", 900)
    monkeypatch.setattr(L, "SHARD_BYTES", 2000)
    docs = texts(11, 60)
    df = spark.createDataFrame([(None if k % 7 == 0 else k // 2, t) for k, t in enumerate(docs)], SCHEMA)
    plain = Plain(docs, order)
    show = lambda ident, n, log: (ident is None, ident, n, log is None, log and round(log, 6))
    want = [show(r.doc_id, 0 if t is None else len(t.split()) + 1, None if t is None else plain.log(t)) for r, t in zip(df.collect(), docs)]
    got = L.score_own(df, order).collect()
    assert sorted(want, key=str) == sorted((show(r.doc_id, r.n_tokens, r.log_prob) for r in got), key=str)
    for r in got:
        assert r.perplexity == (None if r.log_prob is None else pytest.approx(math.exp(-r.log_prob / r.n_tokens), rel=1e-9))


def test_own_scores_leave_no_model_on_disk(spark, monkeypatch, tmp_path):
    docs = texts(12, 60)
    df = spark.createDataFrame(list(enumerate(docs)), SCHEMA)
    monkeypatch.setattr(L, "PART_BYTES", 1000)
    monkeypatch.setattr(L, "new_folder", lambda s, purpose: f"{tmp_path}/{purpose}")
    assert queries.lm_scoring.score_own(df).count() == len(docs)
    assert os.listdir(f"{tmp_path}/own-scores") == ["scores"]
    assert len(os.listdir(f"{tmp_path}/own-scores/scores")) > 1


@pytest.mark.parametrize("order,frequent", [(3, 1), (5, 40)])
def test_own_scores_of_repeated_runs(spark, monkeypatch, order, frequent):
    for name, value in (("PART_BYTES", 9000), ("ROW_BYTES", 3000), ("PIECE", 700), ("FREQUENT", frequent)):
        monkeypatch.setattr(L, name, value)
    docs = [*texts(13, 50), "ab " * 4000, "of the one and of the other " * 300, "of the one", "ab " * 4000]
    df = spark.createDataFrame(list(enumerate(docs)), SCHEMA).repartition(3)
    plain = Plain(docs, order)
    got = {r.doc_id: r.log_prob for r in L.score_own(df, order).collect()}
    assert len(got) == len(docs)
    for k, t in enumerate(docs):
        assert got[k] == (None if t is None else pytest.approx(plain.log(t), rel=1e-9))


def test_own_scores_count_every_part_once(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_BYTES", 1000)
    monkeypatch.setattr(L, "PARTS", 4)
    runs, write = [], L._write
    monkeypatch.setattr(L, "_write", lambda *a: (runs.append(a[1:]), write(*a)))
    docs = texts(14, 60)
    assert L.score_own(spark.createDataFrame(list(enumerate(docs)), SCHEMA)).count() == len(docs)
    # for each part its n-grams, and (but for the last) the words so far; besides the texts, frequent words, all words and scores
    assert len(runs) <= 2 * L.PARTS + 3


def test_own_scores_of_no_text(spark):
    assert L.score_own(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in L.score_own(spark.createDataFrame([(1, None)], SCHEMA)).collect()] == [(1, 0, None, None)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    folder = L.train(df)
    assert L.score(df, folder).count() == 0
    (row,) = L.score(spark.createDataFrame([(1, "a")], SCHEMA), folder).collect()
    assert row.log_prob == pytest.approx(0.0)


def test_discounts():
    assert L.discounts(0, 0, 0, 0) == (0.5, 1.0, 1.5)
    y = 10 / 20
    assert L.discounts(10, 5, 3, 2) == pytest.approx((1 - 2 * y * 5 / 10, 2 - 3 * y * 3 / 5, 3 - 4 * y * 2 / 3))
