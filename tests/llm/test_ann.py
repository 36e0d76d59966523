"""Nearest neighbours against brute force."""

import numpy as np

from gristmill.llm import ann as A
from gristmill.llm import queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(x, ids, k):
    d = A._squared(x.astype(np.float64), x.astype(np.float64))
    np.fill_diagonal(d, np.inf)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, row))[:k]] for i, row in enumerate(d)}


def test_recall_over_all_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 2
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    ids = np.arange(3000) * 3 + 1
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)
    rows = A.nearest_neighbours(df, leaf=60).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.vec_id, r.rank)):
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    want = brute(x, ids, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.92
    place = {int(i): n for n, i in enumerate(ids)}
    for r in rows[:500]:
        assert abs(r.distance - np.linalg.norm(x[place[r.vec_id]].astype(float) - x[place[r.neighbour_id]])) < 1e-5


def test_portions_blocks_and_string_ids(spark, monkeypatch):
    """Searching in small portions and blocks, by ids of unequal length, gives what whole parents give."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[:300] = x[0]
    names = [f"v{'x' * (i % 40)}{i}" for i in range(1500)]
    df = spark.createDataFrame([(n, v.tolist(), i) for i, (n, v) in enumerate(zip(names, x))], "vec_id string, embedding array<float>, label int")
    rows = lambda: sorted((r.vec_id, r["rank"], r.neighbour_id) for r in A.nearest_neighbours(df, "label % 10 = 0", leaf=40, recall=1.0).collect())
    want = rows()
    assert len(want) == 1500
    monkeypatch.setattr(A, "QUERIES", 7)
    monkeypatch.setattr(A, "BLOCK", 50)
    assert rows() == want
    d = A._squared(x.astype(np.float64), x.astype(np.float64))
    np.fill_diagonal(d, np.inf)
    near = {n: {names[j] for j in np.lexsort((names, d[i]))[:10]} for i, n in enumerate(names) if i % 10 == 0}
    got = {}
    for a, _, b in want:
        got.setdefault(a, set()).add(b)
    assert np.mean([len(got[n] & near[n]) / 10 for n in near]) >= 0.97


def test_registered_query_reaches_the_recall(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    want = brute(x, ids, 10)
    got = {}
    for r in queries.op2_neighbours(spark, sf_dir).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    assert np.mean([len(got[i] & set(want[i])) / 10 for i in got]) >= 0.9


def test_tree_fitted_on_a_sample_indexes_every_row(spark, monkeypatch):
    monkeypatch.setattr(A, "TRAIN_ROWS", 200)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in A.nearest_neighbours(df, "vec_id % 20 = 0", leaf=50).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    want = brute(x, np.arange(2000), 10)
    assert len(got) == 100 and np.mean([len(got[i] & set(want[i])) / 10 for i in got]) >= 0.9


def test_best_bin_first_visits_all_leaves_nearest_first():
    tree = A.Tree(np.array([[0], [-5], [5], [-6], [-4], [4], [6]], np.float32), {0: np.array([1, 2]), 1: np.array([3, 4]), 2: np.array([5, 6])})
    assert tree.leaves(np.array([4.4], np.float32)) == [5, 6, 4, 3]
    assert tree.leaves(np.array([4.4], np.float32), 2) == [5, 6]
    assert tree.descend(np.array([[-9], [4.9], [5.1]], np.float32)).tolist() == [3, 5, 6]


def test_conventions(spark):
    rows = [(None, [1.0, 2.0], 0), (1, None, 0), (2, [1.0, None], 0), (3, [float("nan"), 1.0], 0), (4, [1.0], 0)]
    rows += [(10, [0.0, 0.0], 1), (10, [0.0, 0.0], 1), (11, [0.0, 1.0], 1), (12, [0.0, 1.0], 1), (13, [3.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS leaf", "2 AS id")
    got = sorted((r.vec_id, r["rank"], r.neighbour_id, r.distance) for r in A.nearest_neighbours(df, k=2).collect())
    assert [(a, b, c) for a, b, c, _ in got] == [(10, 1, 11), (10, 2, 12), (11, 1, 12), (11, 2, 10), (12, 1, 11), (12, 2, 10), (13, 1, 10), (13, 2, 11)]
    assert got[0][3] == 1.0
    assert A.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert A.nearest_neighbours(df.where("vec_id = 13")).count() == 0


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0], 0) for i in range(700)] + [(1000 + i, [2.0, float(i)], 0) for i in range(20)], SCHEMA)
    rows = A.nearest_neighbours(df, k=3, leaf=50).collect()
    assert len(rows) == 720 * 3
    assert all(r.distance == 0 for r in rows if r.vec_id < 700)
