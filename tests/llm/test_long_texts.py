"""Long texts give what short parts give, within bounded memory."""

import subprocess
import sys
import textwrap

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import _arrays as R
from gristmill.llm import langid, lm_scoring, mixing, packing, quality, toxicity
from gristmill.llm import superminhash as S
from tests.llm.test_near_and_exact import SCHEMA


def texts():
    rng = np.random.default_rng(3)
    words = np.array(["Abc", "défg", "h", "漢字", "x" * 90, "\n", "zz9"])
    return [" ".join(words[rng.integers(0, len(words), n)]) for n in (0, 1, 7, 400, 3000)] + [None, "y" * 20_000, "ab " * 5_000]


def test_words_of_small_chunks_are_the_same(monkeypatch):
    data, offsets = R.text_buffers(pa.array(texts()))
    want = R.word_hashes(data, offsets)
    runs = R.windows(*want, 3)
    for size in (1, 5, 64, 4099):
        monkeypatch.setattr(R, "CHUNK", size)
        got = R.word_hashes(data, offsets)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        if size > 5:
            again = R.windows(*want, 3)
            assert (again[0] == runs[0]).all() and (again[1] == runs[1]).all()
    plain = [t.split() for t in texts() if t]
    assert len(want[0]) == sum(map(len, plain)) and len(set(want[0].tolist())) == len({w.lower() for p in plain for w in p})


@pytest.mark.parametrize("padded", [True, False])
@pytest.mark.parametrize("limit", [4, 37, 10_000])
def test_parts_have_every_ngram_once(limit, padded):
    column = pa.array(texts())
    bucket, doc = R.char_ngrams(column, (1, 3, 4), 16, padded=padded)
    want = np.sort(doc.astype(np.int64) << 16 | bucket)
    parts = [(d.astype(np.int64) + a) << 16 | b for a, _, b, d in R.gram_parts(column, (1, 3, 4), 16, padded=padded, limit=limit)]
    assert (np.sort(np.concatenate(parts)) == want).all()


def test_scores_of_parts_are_those_of_whole_texts(monkeypatch):
    column = pa.array(texts())
    rng = np.random.default_rng(1)
    models = [
        toxicity.Model(rng.normal(size=2**toxicity.BITS).astype(np.float32), 0.5, 0.0).scores,
        langid.Model(["a", "b"], rng.normal(size=(2, 2**langid.BITS)).astype(np.float32), np.zeros(2)).scores,
        quality.Model(rng.normal(size=(2**quality.BITS, 2)).astype(np.float32)).probability,
    ]
    want = [m(column) for m in models] + [quality.counted(column), toxicity.features(column)]
    parts = R.gram_parts
    for module in (toxicity, langid, quality):
        monkeypatch.setattr(module, "gram_parts", lambda *a, **k: parts(*a, **(k | {"limit": 300})))
    for got, whole in zip([m(column) for m in models], want):
        np.testing.assert_allclose(got, whole, rtol=1e-9)
    for (b, n), (c, m) in zip(quality.counted(column), want[3]):
        assert (b == c).all() and (n == m).all()
    assert all((b == c).all() for b, c in zip(toxicity.features(column), want[4]))


PROGRAM = """
    import resource
    import numpy as np, pyarrow as pa
    from gristmill.llm import exact_dedup, langid, lm_scoring, packing, quality, superminhash, toxicity
    text = pa.array([%s])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), text], names=["doc_id", "text"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    toxicity.Model(np.ones(2**toxicity.BITS, np.float32), 0.0, 0.0).scores(text)
    langid.Model(["a", "b"], np.zeros((2, 2**langid.BITS), np.float32), np.zeros(2)).scores(text)
    quality.Model(np.zeros((2**quality.BITS, 2), np.float32)).probability(text)
    assert len(list(superminhash._sketcher(2, 128, 32)(iter([batch])))) == 1
    exact_dedup._fingerprint_columns(text)
    assert len(list(packing._count_words(iter([batch])))) == 1
    for _ in lm_scoring._counter(5, 64)(iter([batch.select([1])])):
        pass
    print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


@pytest.mark.parametrize("text", ["'ab ' * (50_000_000 // 3)", "'Words of many a kind make a text. ' * (50_000_000 // 34)", "'x' * 50_000_000"])
def test_fifty_megabytes_take_less_than_five_hundred_more(text):
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(PROGRAM % text)], capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) < 500


def test_operators_take_long_texts(spark):
    long = "Some words go on. " * 120_000
    docs = spark.createDataFrame([(1, long, "en", "src0", len(long)), (2, long, "en", "s", len(long)), (3, "short", "en", "s", 5), (4, None, None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.train(docs, 3)).collect()}
    assert got[1].n_tokens == 480_001 and got[1].log_prob == got[2].log_prob and got[4].n_tokens == 0
    pieces = packing.pack_documents(docs).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == 480_000 and {r.doc_id for r in pieces} == {1, 2, 3, 4}
    assert {r.doc_id for r in mixing.mix_sources(docs.withColumnRenamed("lang", "units")).collect()} <= {1, 2, 3, 4}
    assert {(r.doc_id, r.group_id) for r in S.near_duplicate_groups(docs).collect()} == {(1, 1), (2, 1)}
