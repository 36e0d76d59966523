"""Near and exact duplicates against brute force."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import exact_dedup as X
from gristmill.llm import superminhash as S
from gristmill.operators.components import connected_components, union_find

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], SCHEMA)


def prose(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(90)) for _ in range(n)]


def edited(rng, words, share):
    return [w if rng.random() > share else "x" + w for w in words]


def shingles(text):
    w = re.findall(r"[a-z0-9]+", text.lower())
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def brute_groups(texts, threshold):
    sets = [shingles(t or "") for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return union_find(pairs)


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "...", "one", "One!", "two words", "two  WORDS"]
    for n in (3, 8, 40, 200, 900):
        for _ in range(4):
            base = prose(rng, n)
            texts.append(" ".join(base))
            texts += [" ".join(edited(rng, base, s)) for s in (0, 0.01, 0.05)]
    passage = prose(rng, 60)
    texts += [" ".join(prose(rng, 200) + passage + prose(rng, 200)) for _ in range(10)]
    base = prose(rng, 300)
    texts += [" ".join(edited(rng, base, 0.03)) for _ in range(60)]
    got = {r.doc_id: r.group_id for r in S.near_duplicate_groups(frame(spark, texts)).collect()}
    assert got == brute_groups(texts, S.THRESHOLD)


def test_bucket_with_strangers_is_solved_exactly(spark):
    """One band of one position: buckets hold unlike texts, and every pair in them still gets compared."""
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = prose(rng, 30)
        texts += [" ".join(base), " ".join(edited(rng, base, 0.05)), " ".join(edited(rng, base, 0.05))]
    rng.shuffle(texts)
    col = pa.array(texts)
    keys = S.band_keys(S.signatures(*S.shingles(col), 4), 4)
    meet = {(a, b) for k in range(4) for a, b in itertools.combinations(range(len(texts)), 2) if keys[a, k] == keys[b, k]}
    sets = [shingles(t) for t in texts]
    want = union_find([(a, b) for a, b in meet if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.group_id for r in S.near_duplicate_groups(frame(spark, texts), positions=4, bands=4).collect()}
    assert got == want


def test_many_strangers_in_few_buckets(spark):
    """Templates of one core: all meet in every bucket, none is alike, and pairs of edits among them are found."""
    rng = random.Random(4)
    core = prose(rng, 60)
    texts = [" ".join(core + prose(rng, 60)) for _ in range(3000)]
    texts += [t + " more" for t in texts[:40]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    got = {r.doc_id: r.group_id for r in S.near_duplicate_groups(frame(spark, [texts[i] for i in order]), positions=8, bands=8).collect()}
    place = {i: k for k, i in enumerate(order)}
    assert got == union_find([(place[i], place[3000 + i]) for i in range(40)])


def test_ids_with_several_texts_meet_through_each_of_them(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 300)
    texts = [" ".join(a), " ".join(b), " ".join(edited(rng, a, 0.03)), " ".join(edited(rng, b, 0.03)), "stranger here"]
    got = {r.doc_id: r.group_id for r in S.near_duplicate_groups(frame(spark, texts, [5, 5, 7, 9, 11])).collect()}
    assert got == {5: 5, 7: 5, 9: 5}
    named = frame(spark, texts, [5, 5, 7, 9, 11]).selectExpr("concat('d', doc_id) AS doc_id", "text", "1 AS node", "2 AS hub")
    assert {r.doc_id: r.group_id for r in S.near_duplicate_groups(named).collect()} == {"d5": "d5", "d7": "d5", "d9": "d5"}


def test_rare_pairs_lose_no_pair(spark):
    rng = random.Random(11)
    core = rng.sample(range(1000), 30)
    sets = [sorted({*rng.sample(core, rng.randrange(1, 30)), *rng.sample(range(1000, 1040), rng.randrange(0, 12))}) for _ in range(120)]
    rows = [(i, i % 7, np.array(x, np.uint64).tobytes()) for i, x in enumerate(sets)]
    members = spark.createDataFrame(rows, "node bigint, component bigint, shingles binary")
    for t in (0.4, 0.6, 0.8):
        got = {(r.a, r.b) for r in S._rare_pairs(members, t).collect()}
        alike = {(a, b) for a, b in itertools.combinations(range(120), 2) if a % 7 != b % 7 and len({*sets[a]} & {*sets[b]}) >= t * len({*sets[a]} | {*sets[b]})}
        assert alike <= got and all(a % 7 != b % 7 for a, b in got)


def test_signature_is_superminhash_by_definition():
    """The batch routine equals the plain algorithm, element by element, step by step."""
    rng = np.random.default_rng(3)
    m = 16
    values = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values[3] = values[2]
    offsets = np.array([0, 1, 1, 6, 40])
    got = S.signatures(values, offsets, m)
    mask = 2**64 - 1

    def mix(x):
        return int(S.mix(np.array([x & mask], np.uint64))[0])

    for d in range(4):
        want = [mask] * m
        for v in map(int, values[offsets[d] : offsets[d + 1]]):
            perm = list(range(m))
            for j in range(m):
                draw = mix(v + 0x632BE59BD9B4E019 * (j + 1))
                k = j + (((draw >> 32) * (m - j)) >> 32)
                perm[j], perm[k] = perm[k], perm[j]
                want[perm[j]] = min(want[perm[j]], (j << 56) | (mix(draw) & (2**56 - 1)))
        assert got[d].tolist() == want


def test_variance_is_below_minhash():
    rng = np.random.default_rng(1)
    values, offsets = [], [0]
    for _ in range(300):
        base = rng.integers(0, 2**63, 27, dtype=np.uint64)
        values += [base[:20], base[7:]]
        offsets += [offsets[-1] + 20, offsets[-1] + 40]
    s = S.signatures(np.concatenate(values), np.array(offsets))
    estimate = (s[0::2] == s[1::2]).mean(1)
    true = 13 / 27
    assert abs(estimate.mean() - true) < 0.01
    assert estimate.std() < 0.85 * (true * (1 - true) / 128) ** 0.5


def test_near_drop_keeps_one_of_each_group_and_all_columns(spark):
    docs = frame(spark, ["a b c d", "a b c d", None, None, "", "z"], [1, 2, None, 4, 5, 5]).selectExpr("*", "1 AS gone", "2 AS id")
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in kept.select("doc_id", "text").collect() if r.text is not None) == [(True, 1, "a b c d"), (True, 5, ""), (True, 5, "z")]
    assert kept.count() == 5
    assert S.near_duplicate_groups(frame(spark, [])).count() == 0


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (7, 8), (7, 8)]
    df = spark.createDataFrame([*edges, (None, 3)], "src bigint, dst bigint")
    want = union_find(edges)
    assert {r.id: r.component for r in connected_components(df).collect()} == want
    monkeypatch.setattr("gristmill.operators.components.EDGES_PER_TASK", 30)
    assert {r.id: r.component for r in connected_components(df.repartition(5)).collect()} == want


def test_fingerprints_combine():
    rng = np.random.default_rng(0)
    for size in (0, 1, 4095, 4096, 4097, 50_000, 1_100_000):
        a, b = rng.integers(0, 256, size, dtype=np.uint8), rng.integers(0, 256, 777, dtype=np.uint8)
        both = np.concatenate((a, b))
        offsets = np.array([0, size, size + 777, size + 777 + len(both)])
        high, low = X.fingerprints(np.concatenate((both, both)), offsets)
        f = list(zip(high.tolist(), low.tolist()))
        assert X.combine(f[0], f[1], 777) == f[2]
    plain = 0
    for x in both[:5000].tolist():
        plain = (plain * X.BASES[0] + x + 1) % X.PRIMES[0]
    assert int(X.fingerprints(both[:5000], np.array([0, 5000]))[0][0]) == plain


def exact_texts():
    long = "ab" * 400_000
    return [None, None, "", "", "x", "y", "x", "x", long, long + "c", long, "y "], [3, 4, 9, 8, 5, None, 5, 2, 11, 12, 10, 13]


def check_exact(spark):
    texts, ids = exact_texts()
    docs = frame(spark, texts, ids).selectExpr("*", "1 AS mark", "2 AS portion", "doc_id AS of")
    kept = X.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    key = lambda p: (p[0] is None, p[0] or 0, p[1] or "")
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=key)
    assert rows == sorted([(3, None), (4, None), (8, ""), (None, "y"), (2, "x"), (10, texts[8]), (12, texts[9]), (13, "y ")], key=key)
    pairs = sorted((r.doc_id, r.duplicate_of) for r in X.exact_duplicates(docs).collect())
    assert pairs == [(5, 2), (5, 2), (9, 8), (11, 10)]


def test_exact_conventions(spark):
    check_exact(spark)
    empty = frame(spark, [])
    assert X.drop_exact_duplicates(empty).count() == 0 and X.exact_duplicates(empty).count() == 0


def test_exact_in_portions_and_with_equal_fingerprints(spark, monkeypatch):
    """Large groups are compared in portions; texts whose fingerprints agree by chance stay apart."""
    monkeypatch.setattr(X, "PORTION", 1)
    check_exact(spark)
    texts = [f"t{i % 7}" for i in range(90)]
    pairs = {r.doc_id: r.duplicate_of for r in X.exact_duplicates(frame(spark, texts)).collect()}
    assert pairs == {i: i % 7 for i in range(7, 90)}
    batch = pa.RecordBatch.from_pydict({"k": [1] * 5, "text": ["a", "b", "a", "b", "c"], "doc_id": [1, 2, 3, 4, 5]})
    (out,) = X._comparer(["k"], "text")(iter([batch]))
    assert out.to_pydict()["doc_id"] == [1, 2, 5]
    places = {"mark": [1] * 5, "size": [1] * 5, "portion": [0] * 5, "split": [True] * 5}
    batch = pa.RecordBatch.from_pydict(places | {"text": ["a", "b", "a", "b", "c"], "id": [1, 2, 3, 4, 5]})
    (out,) = X._linker(["mark"], None)(iter([batch]))
    out = out.to_pydict()
    assert out["of"] == [1, 2, 1, 2, 5] and out["first"] == [True, True, False, False, True]
    assert out["head"] == [0, 1, 0, 1, 2] and out["text"] == ["a", "b", None, None, "c"]


@pytest.mark.parametrize("portion", [1, 4, 2000])
def test_exact_pairs_with_repeated_and_null_idents(spark, monkeypatch, portion):
    monkeypatch.setattr(X, "PORTION", portion)
    texts, ids = ["x"] * 30 + ["y"] * 56 + ["z", "z", "z", "z", None, None], [*range(1, 31), *range(5, 61), 1, 1, None, None, 1, None]
    docs = frame(spark, texts, ids)
    first = {t: min(i for i, u in zip(ids, texts) if u == t and i is not None) for t in "xyz"}
    want = Counter((i, first[t]) for i, t in zip(ids, texts) if t is not None) - Counter((i, i) for i in first.values())
    got = Counter((r.doc_id, r.duplicate_of) for r in X.exact_duplicates(docs).collect())
    assert got == want
    assert docs.count() - X.drop_exact_duplicates(docs).count() == sum(got.values())
    only = frame(spark, ["x"] * 6, [None] * 6)
    assert [(r.doc_id, r.duplicate_of) for r in X.exact_duplicates(only).collect()] == [(None, None)] * 5


def test_full_table_of_bits_loses_no_row(spark, monkeypatch):
    monkeypatch.setattr("gristmill.llm._bits.MOST", 1 << 16)
    texts = [f"t{i}" for i in range(9000)] * 2 + [f"u{i}" for i in range(3000)]
    docs = frame(spark, texts).repartition(3)
    assert {(r.doc_id, r.duplicate_of) for r in X.exact_duplicates(docs).collect()} == {(i + 9000, i) for i in range(9000)}
    assert X.drop_exact_duplicates(docs).count() == 12000
