"""Mixing, packing and token files against plain versions, bounds and round trips."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import mixing as M
from gristmill.llm import packing as P
from gristmill.llm import token_files as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_mix(rows, weights, default, seed=M.SEED):
    """Copies of each (doc_id, text, source) by the definition, in whole numbers."""
    key = lambda s: "n" if s is None else "s" + s
    size = Counter()
    for _, t, s in rows:
        size[key(s)] += len(t or "")
    w = {k: next((v for n, v in weights.items() if "s" + n == k), default) for k in size}
    live = [k for k in size if size[k] and w[k]]
    out = Counter()
    for k in live:
        units = sum(size[x] for x in live) * w[k] * M.UNIT // (sum(w[x] for x in live) * size[k])
        at = int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:8], 16) * M.UNIT // 2**32
        bucket = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16)
        for r in sorted((r for r in rows if key(r[2]) == k), key=lambda r: (bucket(r[0]), r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
            copies = (at + units) // M.UNIT - at // M.UNIT
            at += units
            if copies:
                out[r] += copies
    return out


@pytest.mark.parametrize("rows,step", [(1, 3), (20_000, 65_536)])
def test_few_characters_of_a_large_weight(spark, monkeypatch, rows, step):
    """A source that is repeated many times; neither buckets nor steps change what is drawn."""
    monkeypatch.setattr(M, "BUCKET_ROWS", rows)
    monkeypatch.setattr(M, "STEP", step)
    docs = [(i, "x" * 50, "a") for i in range(60)] + [(100, "yz", "tiny"), (101, None, "tiny")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in docs], SCHEMA)
    got = M.mix_sources(df, {"tiny": 1, "a": 3}, 1).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == plain_mix(docs, {"tiny": 1, "a": 3}, 1)
    mine = sorted(r["copy"] for r in got if r.doc_id == 100)
    assert mine == list(range(1, len(mine) + 1)) and len(mine) > 300


def test_more_copies_than_a_bigint_of_units_holds(spark):
    df = spark.createDataFrame([(1, "x", "en", "tiny", 1), (2, "y" * 5_000_000, "en", "big", 1)], SCHEMA)
    plan = M.mix_sources(df, {"tiny": 1_000_000, "big": 1}, 1)
    assert plan.where("doc_id = 2").count() <= 1  # some 5 million copies of the other row aren't asked for


def test_mixing_equals_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(0, 90), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(800)]
    rows += [(5, "twin", "a"), (5, "twin", "a"), (5, None, "a"), (None, "q", "b"), (None, None, "b"), (900, "", "void"), (901, "drop", "zero")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).selectExpr("*", "1 AS units", "2 AS COPY", "3 AS k")
    weights = {"a": 1, "b": 3, "zero": 0}
    got = M.mix_sources(df, weights, 2)
    assert got.columns == [*df.columns, "_copy"]
    seen = got.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in seen) == plain_mix(rows, weights, 2)
    chars = Counter()
    for r in seen:
        chars[r.source] += len(r.text or "")
    total = sum(len(t or "") for _, t, s in rows if s != "zero")
    for s, w in (("a", 1), ("b", 3), ("c", 2), (None, 2)):
        assert chars[s] / total == pytest.approx(w / 8, rel=0.15)
    assert M.mix_sources(df.limit(0)).count() == 0
    assert M.mix_sources(df, weights, 2, copy=None).columns == df.columns


def improving_step(bins, sizes, capacity):
    """Whether moving or exchanging pieces between two bins raises the sum of squared fills (all bins with room)."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    open_ = [k for k in range(len(bins)) if fill[k] < capacity]
    for a, b in itertools.permutations(open_, 2):
        if fill[a] < fill[b]:
            continue
        outs = [(), *((i,) for i in bins[a]), *itertools.combinations(bins[a], 2)]
        ins = [*((i,) for i in bins[b]), *itertools.combinations(bins[b], 2)]
        for x, y in itertools.product(outs, ins):
            if (len(x), len(y)) in ((0, 1), (1, 1), (1, 2), (2, 1)):
                d = sum(sizes[i] for i in y) - sum(sizes[i] for i in x)
                if 0 < d <= capacity - fill[a]:
                    return True
    return False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=25))
def test_packing_ends_in_a_local_optimum(sizes):
    bins = P.pack(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 20 for b in bins)
    solid = [[i for i in b if sizes[i]] for b in bins]
    assert not improving_step([b for b in solid if b], sizes, 20)
    assert len(bins) <= len(P.best_fit([s for s in sizes if s], 20)) + (not any(sizes) and bool(sizes))


def test_search_empties_a_bin_that_best_fit_leaves():
    sizes, capacity = [6, 6, 4, 4, 7, 3], 10
    start = [[0, 5], [1], [2, 3], [4]]
    assert len(P.Search(sizes, start, capacity).run()) == 3
    assert len(P.Search([5, 2, 3, 4, 6], [[0, 1], [2, 3], [4]], 10).run()) == 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=9))
def test_packing_is_near_the_best_possible(sizes):
    def best(rest, rooms):
        if not rest:
            return len(rooms)
        found = len(rooms) + len(rest)
        for k in {r: k for k, r in enumerate(rooms) if r >= rest[0]}.values():
            found = min(found, best(rest[1:], rooms[:k] + [rooms[k] - rest[0]] + rooms[k + 1 :]))
        return min(found, best(rest[1:], [*rooms, 10 - rest[0]]))

    assert len(P.pack(sizes, 10)) <= best(sorted(sizes, reverse=True), []) + 1


def test_packed_table_covers_every_word_once(spark):
    rng = random.Random(1)
    texts = ["w " * rng.choice([0, 1, 5, 40, 99, 100, 101, 730]) for _ in range(300)] + [None, "", "one two", "one two"]
    ids = [*range(300), None, 301, 302, 302]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], SCHEMA).selectExpr("*", "1 AS size", "2 AS g")
    rows = P.pack_documents(df, 100, 64).collect()
    spans = defaultdict(list)
    fills = Counter()
    for r in rows:
        spans[r.doc_id].append((r.start, r.length))
        fills[r.bin_id] += r.length
    assert max(fills.values()) <= 100
    want = defaultdict(list)
    for i, t in zip(ids, texts):
        n = len((t or "").split())
        want[i] += [(s, min(100, n - s)) for s in range(0, max(n, 1), 100)]
    assert {k: sorted(v) for k, v in spans.items()} == {k: sorted(v) for k, v in want.items()}
    by_bin = defaultdict(list)
    for r in rows:
        by_bin[r.bin_id].append((r.bin_offset, r.length))
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    words = sum(fills.values())
    assert len(fills) <= -(-words // 100) + 6 + 1
    assert P.pack_documents(df.limit(0)).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    texts = ["Hello, world!  two  blanks\n\n", "", None, "ünïcödé 漢字 🙂 it's 123", "<|endoftext|>", "a" * 100_000, "Hello", "Hello"]
    df = spark.createDataFrame([(i if i != 6 else None, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).selectExpr("*", "1 AS shard", "2 AS start")
    folder = f"file://{tmp_path}/tokens"
    rows = T.write_token_files(df.repartition(3), folder).collect()
    files, tokenizer = T.TokenFiles(folder), T.encoding(T.VOCABULARY)
    assert len(rows) == len(texts)
    end = 0
    for r in sorted(rows, key=lambda r: (r.token_offset, r.n_tokens)):
        assert r.token_offset == end
        end += r.n_tokens
        ids = files.tokens(r.token_offset, r.n_tokens)
        assert ids.dtype == np.uint16
        want = texts[6 if r.doc_id is None else r.doc_id]
        if want is None:
            assert r.n_tokens == 0
        else:
            assert ids[-1] == T.END_OF_TEXT and tokenizer.decode(ids[:-1].tolist()) == want
            assert ids[:-1].tolist() == tokenizer.encode_ordinary(want)
    for k, shard in enumerate(files.manifest["shards"]):
        offsets = files.offsets(k)
        assert offsets.dtype == np.uint64 and len(offsets) == shard["docs"] + 1
        own = sorted((r.row_in_shard, r.token_offset) for r in rows if r.shard == shard["shard"])
        assert offsets[:-1].tolist() == [o for _, o in own] and offsets[-1] == shard["base"] + shard["tokens"]
        assert len(files.shard(k)) == shard["tokens"]
    assert T.write_token_files(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_files_of_other_attempts_are_removed(spark, tmp_path):
    (tmp_path / "tokens").mkdir()
    (tmp_path / "tokens" / "000000-lost.ids").write_bytes(b"xx")
    df = spark.createDataFrame([(i, f"text {i}", "en", "s", 0) for i in range(20)], SCHEMA).repartition(2)
    T.write_token_files(df, f"file://{tmp_path}/tokens")
    files = T.TokenFiles(f"file://{tmp_path}/tokens")
    assert sorted(p.name for p in (tmp_path / "tokens").glob("*.ids")) == sorted(s["file"] for s in files.manifest["shards"])
