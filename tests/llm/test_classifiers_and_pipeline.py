"""Classifiers on held-out rows, and the pipeline against plain versions of its stages."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as C
from gristmill.llm import _arrays as R
from gristmill.llm import langid, mixing, packing, quality, toxicity
from tests.llm.test_mixing_packing_tokens import plain_mix
from tests.llm.test_near_and_exact import brute_groups, edited, prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
INSULTS = ["grobnak", "fumplewit", "dorkelhen"]


def corpus(n=420, seed=6):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.choice([30, 80, 200]))
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        bad = i % 4 == 1
        text = " ".join(w + rng.choice(["$$", "%%"]) if bad else w for w in words)
        rows.append((i, text, "en", f"s{rng.choice([0, 0, 0, 1, 2])}", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus(1200)
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels[:900], "doc_id bigint, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels, truth = tables
    got = {r.doc_id: r.toxic for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert len(got) == len(truth)
    assert np.mean([got[i] == t for i, _, t in truth[900:]]) >= 0.96
    assert np.mean([got[i] for i, _, t in truth[900:] if t]) >= 0.96


def test_toxicity_score_by_definition():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(size=2**toxicity.BITS).astype(np.float32), 0.5, 0.0)
    texts = ["Abcd efgh\nabcd", "x", "", None, "ÄÖÜ äöü 漢字漢字"]
    got = model.scores(pa.array(texts))
    for t, s in zip(texts, got):
        padded = " " + (t or "").lower().replace("\n", " ")
        grams = {padded[i : i + n] for n in toxicity.SIZES for i in range(len(padded) - n + 1)}
        buckets = {int(R.char_ngrams(pa.array([g]), (len(g),), toxicity.BITS)[0][0]) for g in grams}
        assert s == pytest.approx(0.5 + sum(float(model.weights[b]) for b in buckets), abs=1e-4)


def test_log_count_ratios():
    rows = [np.array([1, 2], np.uint32), np.array([1], np.uint32), np.array([2, 3], np.uint32)]
    r = toxicity.log_count_ratios(rows, np.array([1, 1, 0]), 1.0, 2)
    p, q = 2**toxicity.BITS + 3, 2**toxicity.BITS + 2
    assert r[1] == pytest.approx(np.log((3 / p) / (1 / q))) and r[2] == pytest.approx(np.log((2 / p) / (2 / q))) and r[3] == 0


def test_quality_on_held_out_rows(spark, tables):
    docs, labels, truth = tables
    got = {r.doc_id: r.quality for r in quality.score_quality(docs, quality.train(docs, labels)).collect()}
    assert np.mean([got[i] == q for i, q, _ in truth[900:]]) >= 0.97


def test_quality_gradient_and_folding():
    """Training lowers the loss, and the folded table gives the softmax of the averaged vectors."""
    col = pa.array(["good words here", "bad$$ words$$"] * 20)
    rows = quality.counted(col)
    y = np.array([1, 0] * 20)
    p = quality.fit(rows, y).probability(col)
    assert (p[y == 1] > 0.9).all() and (p[y == 0] < 0.1).all()
    bucket, doc = quality.features(pa.array(["a b", "", "c"]))
    table = np.random.default_rng(0).normal(size=(2**quality.BITS, 2))
    z = np.array([table[bucket[doc == k]].mean(0) if (doc == k).any() else [0, 0] for k in range(3)])
    assert quality.Model(table).probability(pa.array(["a b", "", "c"])) == pytest.approx(np.exp(z[:, 1]) / np.exp(z).sum(1))


def test_bounded_samples_keep_the_ratio_of_all_labels(spark):
    """Texts that both classes have are decided by the ratio among all labels, not by that in the even sample."""
    texts = {"plain": "an ordinary sentence of plain words", "mixed": "borderline remark quoted verbatim", "rude": "grobnak fumplewit dorkelhen"}
    kinds = [("rude", 1)] * 120 + [("mixed", 1)] * 80 + [("mixed", 0)] * 760 + [("plain", 0)] * 3040
    docs = spark.createDataFrame([(i, texts[k]) for i, (k, _) in enumerate(kinds)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - t, t) for i, (_, t) in enumerate(kinds)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels, rows=400)
    assert (model.scores(pa.array(list(texts.values()))) > model.threshold).tolist() == [False, False, True]
    p = quality.train(docs, labels, rows=400).probability(pa.array(list(texts.values())))
    assert p[0] > 0.9 and p[1] > 0.6 and p[2] < 0.5


def test_language_on_held_out_rows(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdef", "bb": "defghi", "cc": "ghijka"}
    rows = [(i, " ".join("".join(rng.choice(letters[x]) for _ in range(5)) for _ in range(30)), x) for i in range(600) for x in [rng.choice(list(letters))]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df.where("doc_id < 300"), rows=60)
    got = {r.doc_id: r.language for r in langid.identify_language(df, model).collect()}
    assert np.mean([got[i] == x for i, _, x in rows if i >= 300]) == 1
    odd = spark.createDataFrame([(1, None, "aa"), (2, "", "aa"), (None, "fed abc", None), (4, "abc", "aa"), (4, "abc", "aa")], "doc_id bigint, text string, lang string")
    assert sorted((r.doc_id or 0, r.language) for r in langid.identify_language(odd, model).collect()) == sorted([(1, None), (2, None), (0, "aa"), (4, "aa"), (4, "aa")], key=lambda p: p[0])
    empty = langid.train(odd.limit(0))
    assert {r.language for r in langid.identify_language(odd, empty).collect()} == {None}


def test_naive_bayes_by_definition():
    texts = ["ab", "b"]
    table = langid._add((pa.scalar("x"),), next(iter([pa.table({"lang": ["x"], "rows": [2], "counts": [np.bincount(R.char_ngrams(pa.array(texts), langid.SIZES, langid.BITS, padded=True)[0], minlength=2**langid.BITS).astype(np.int64).tobytes()]})])))
    row = np.frombuffer(table.column("log")[0].as_py(), np.float32)
    counts = Counter(g for t in texts for n in langid.SIZES for g in [(" " + t)[i : i + n] for i in range(len(t) + 2 - n)])
    bucket = int(R.char_ngrams(pa.array(["b"]), (1,), langid.BITS)[0][0])
    assert row[bucket] == pytest.approx(np.log((counts["b"] + 0.5) / (sum(counts.values()) + 0.5 * 2**langid.BITS)), rel=1e-5)


def test_classifiers_handle_nulls_ties_and_no_labels(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "abc"), (4, "x " * 50_000), (4, "x")], "doc_id bigint, text string").selectExpr("*", "1 AS h", "2 AS score")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (2, None, 1), (None, 0, 0), (4, 1, None), (4, 0, 1), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (none, some):
        assert toxicity.score_toxicity(odd, toxicity.train(odd, labels)).count() == 5
        kept = toxicity.drop_toxic(odd, toxicity.train(odd, labels))
        assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1
        got = {r.doc_id: (r.probability, r.quality) for r in quality.score_quality(odd, quality.train(odd, labels)).collect()}
        assert got[1] == (0.5, None) and got[2] == (0.5, None)
    assert toxicity.score_toxicity(odd.limit(0), toxicity.train(odd.limit(0), none)).count() == 0


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = corpus(240, 12)
    more = []
    for i, text, *_ in rows[:40]:
        more += [text, " ".join(edited(rng, text.split(), 0.02))]
    more += [rows[0][1]] * 3 + [None, ""]
    rows += [(1000 + i, t, "en", "s1", 0) for i, t in enumerate(more)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_pipeline_equals_plain_stages(spark, small_corpus):
    folder, rows = small_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.scores(pa.array([r[1] for r in rows], pa.string()))
    left = [r for r, s in zip(rows, scores) if r[1] is None or s <= model.threshold]
    assert not any(x in (r[1] or "") for r in left for x in INSULTS)
    assert len(rows) - len(left) <= sum(any(x in (r[1] or "") for x in INSULTS) for r in rows) + 4
    first = {}
    for r in sorted(left):
        first.setdefault(r[1] if r[1] is not None else ("null", r[0]), r)
    left = sorted(first.values())
    groups = brute_groups([r[1] for r in left], 0.6)
    left = [r for i, r in enumerate(left) if groups.get(i, i) == i]
    mixed = plain_mix([(r[0], r[1], r[3]) for r in left], mixing.WEIGHTS, mixing.DEFAULT_WEIGHT)
    want = defaultdict(Counter)
    for (i, text, _), copies in mixed.items():
        n = len((text or "").split())
        for s in range(0, max(n, 1), packing.CAPACITY):
            want[i][(s, min(packing.CAPACITY, n - s))] += copies
    got = defaultdict(Counter)
    fill = Counter()
    for r in C.run(spark, folder).collect():
        got[r.doc_id][(r.start, r.length)] += 1
        fill[r.bin_id] += r.length
    assert got == want
    assert max(fill.values()) <= packing.CAPACITY
    assert len(fill) <= -(-sum(fill.values()) // packing.CAPACITY) + 1


def test_every_stage_keeps_the_columns(spark, small_corpus):
    folder, _ = small_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_quality_trainer_equals_plain_descent():
    """The same steps with loops over buckets, dimensions and classes."""
    col = pa.array(["good words here", "bad$$ words$$", "some good text", "$$ $$ bad"])
    rows, y, seed = quality.counted(col), np.array([1, 0, 1, 0]), 4
    d = quality.DIMENSIONS
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / d, 1 / d, (2**quality.BITS, d)).astype(np.float32).astype(float)
    output = [[0.0] * d for _ in range(2)]
    step = 0
    for _ in range(3):
        for i in rng.permutation(4):
            bucket, count = rows[i]
            lr = 0.5 * (1 - step / 12)
            step += 1
            share = [c / sum(count) for c in count]
            hidden = [sum(s * vectors[b][k] for s, b in zip(share, bucket)) for k in range(d)]
            z = [sum(o * h for o, h in zip(row, hidden)) for row in output]
            p = [np.exp(x) / sum(np.exp(v) for v in z) for x in z]
            p[y[i]] -= 1
            back = [sum(p[c] * output[c][k] for c in range(2)) for k in range(d)]
            for c in range(2):
                for k in range(d):
                    output[c][k] -= lr * p[c] * hidden[k]
            for s, b in zip(share, bucket):
                for k in range(d):
                    vectors[b][k] -= lr * len(bucket) ** 0.5 * s * back[k]
    model = quality.fit(rows, y, seed, epochs=3, rate=0.5)
    used = np.unique(np.concatenate([r[0] for r in rows]))
    np.testing.assert_allclose(model.table[used], vectors[used] @ np.array(output).T, atol=2e-5)


def test_toxicity_trainer_equals_plain_descent():
    """Logistic regression on scaled features, feature by feature; features are the buckets with a ratio."""
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(30, 8, replace=False)).astype(np.uint32) for _ in range(100)]
    y = np.array([float(5 in r or 9 in r) for r in rows])
    ratio = toxicity.log_count_ratios(rows, y, least=1, features=30)
    w, g2, bias, b2 = [0.0] * 30, [1e-6] * 30, 0.0, 1e-6
    order_of = np.random.default_rng(3)
    for _ in range(toxicity.EPOCHS):
        order = order_of.permutation(100)
        for at in range(0, 100, 64):
            batch = order[at : at + 64]
            errors = [1 / (1 + np.exp(-(sum(w[f] * float(ratio[f]) for f in rows[i]) + bias))) - y[i] for i in batch]
            for f in range(30):
                g = sum(e * float(ratio[f]) for e, i in zip(errors, batch) if f in rows[i]) / len(batch) + toxicity.PENALTY * w[f]
                g2[f] += g * g
                w[f] -= 0.05 * g / g2[f] ** 0.5
            g = sum(errors) / len(batch)
            b2 += g * g
            bias -= 0.05 * g / b2**0.5
    got, got_bias = toxicity._regression(rows, y, ratio, 3)
    np.testing.assert_allclose(got, [a * float(b) for a, b in zip(w, ratio)], atol=1e-5)
    assert got_bias == pytest.approx(bias, abs=1e-6)


def test_language_trainer_counts_every_ngram(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("ab ab", "p"), ("ba", "p"), ("cde", "q"), ("", "q"), (None, "q"), ("zz", None)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS id", "2 AS h", "3 AS k")
    model = langid.train(df)
    assert model.languages == ["p", "q"]
    for k, lang in enumerate(model.languages):
        counts = Counter()
        for _, t, x in rows:
            if x == lang and t is not None:
                counts.update(int(R.char_ngrams(pa.array([(" " + t)[i : i + n]]), (n,), langid.BITS)[0][0]) for n in langid.SIZES for i in range(len(t) + 2 - n))
        total = sum(counts.values()) + langid.SMOOTH * 2**langid.BITS
        want = np.full(2**langid.BITS, np.log(langid.SMOOTH / total))
        for b, c in counts.items():
            want[b] = np.log((c + langid.SMOOTH) / total)
        np.testing.assert_allclose(model.matrix[k], want, rtol=1e-5)
    assert langid.identify_language(df, model).count() == 6


def test_pipeline_keeps_extra_columns_with_clashing_names(spark, tmp_path):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS units", "2 AS mark", "3 AS gone", "4 AS node", "5 AS copies")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*SCHEMA.replace(" bigint", "").replace(" string", "").split(", "), "units", "mark", "gone", "node", "copies"]
    assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 100
