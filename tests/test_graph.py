"""Graph operators on small graphs with known answers."""

import math
from collections import Counter
from itertools import combinations

import pytest

from gristmill import storage
from gristmill.operators import graph as G

CLIQUES = [(a, b) for k in (0, 20) for a, b in combinations(range(k + 1, k + 6), 2)]
#: Two cliques of five, six vertices around 11 to 15, and a triangle that joins the three parts.
THREE = CLIQUES + [(13, 11), (11, 12)] + [(11, 14), (11, 15), (12, 13), (12, 14), (12, 15), (13, 14), (13, 15), (14, 15)] + [(x, 16) for x in (12, 13, 14, 15)] + [(1, 11), (1, 21), (11, 21)]


def edges(spark, pairs):
    return G.canonical(spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long"))


def test_canonical_merges_directions_and_drops_loops(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (None, 1), (2, 3)], "src long, dst long")
    assert sorted(map(tuple, G.canonical(df).collect())) == [(1, 2, 2), (2, 3, 1)]


def test_dense_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "x string")
    ids = G.dense_ids(df, "x")
    assert sorted(map(tuple, ids.collect())) == [("a", 1), ("b", 2), ("c", 3)]
    coded = G.encode_edges(spark.createDataFrame([("a", "c", 5), ("a", "z", 1)], "src string, dst string, weight int"), ids)
    assert [tuple(r) for r in coded.collect()] == [(1, 3, 5)]


def test_triangles_against_brute_force(spark):
    made = {tuple(sorted(p)) for p in THREE}
    nodes = sorted({x for p in made for x in p})
    want = {t for t in combinations(nodes, 3) if all(p in made for p in combinations(t, 2))}
    assert {tuple(r) for r in G.triangles(edges(spark, THREE)).collect()} == want
    path = edges(spark, [(1, 2), (2, 3)])
    assert G.triangles(path).count() == 0 and G.triangle_edges(path).count() == 0


def test_wcc_communities(spark):
    got = Counter(r.community for r in G.wcc_communities(edges(spark, THREE)).collect())
    assert dict(got) == {5: 5, 15: 6, 21: 5}


def test_louvain_finds_the_three_parts(spark):
    rows = G.louvain(edges(spark, THREE)).collect()
    top = max(r.level for r in rows)
    groups = {}
    for r in rows:
        if r.level == top:
            groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 5], [11, 12, 13, 14, 15, 16], [21, 22, 23, 24, 25]]


def test_modularity(spark):
    e = edges(spark, [(1, 2), (3, 4)])
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "id long, community long")
    assert math.isclose(G.modularity(e, members), 0.5)


def test_page_rank_against_power_iteration(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (1, 3), (4, 1)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.id: r["rank"] for r in G.page_rank(df, tolerance=1e-6).collect()}
    rank = {i: 1.0 for i in (1, 2, 3, 4)}
    out = Counter(a for a, _ in pairs)
    for _ in range(200):
        rank = {i: 0.1 + 0.9 * sum(rank[a] / out[a] for a, b in pairs if b == i) for i in rank}
    assert all(abs(got[i] - rank[i]) < 1e-4 for i in rank)
    own = {r.id: r["rank"] for r in G.page_rank(df, source=1, rounds=5, tolerance=0).collect()}
    assert own[4] == 0.0 and own[1] > own[2] > 0


def test_hops_and_landmark_distance(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (8, 9)])
    marks = spark.createDataFrame([(1,)], "id long")
    assert {r.id: r.hops for r in G.hops(e, marks).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.id: round(r.distance, 3) for r in G.landmark_distance(e, marks).collect()} == {1: 0.0, 2: 0.333, 3: 0.667, 4: 1.0}


def test_walk_ends_at_the_landmark(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 9, 1.0), (3, 9, 1.0)], "src long, dst long, weight double")
    start = spark.createDataFrame([(1,)], "id long")
    rows = G.random_walks(e, start, spark.createDataFrame([(9,)], "id long"), 10, walks=20).collect()
    assert len(rows) == 20 and {(r.id, r.steps) for r in rows} == {(9, 2)}
    short = G.random_walks(e, start, spark.createDataFrame([(9,)], "id long"), 1, walks=200).collect()
    assert {r.id for r in short} == {2, 3} and 60 < sum(r.id == 2 for r in short) < 140


def test_containment(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("c", 7)], "item string, f int")
    assert sorted(tuple(r) for r in G.containment(df, "item", "f").collect()) == [("a", "b", 1, 0.5), ("b", "a", 1, 1.0)]


def test_communities_and_pairs(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4)])
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, community long")
    assert sorted(tuple(r) for r in G.community_stats(e, members).collect()) == [(1, 3, 3, 1, 6 / 9), (4, 1, 0, 1, 0.0)]
    assert sorted((r.src, r.dst, r.mutation) for r in G.in_large_communities(e, members, 2).collect()) == [(1, 2, False), (1, 3, False), (2, 3, False), (3, 4, True)]
    lists = spark.createDataFrame([(1, ["x", "y", "z"]), (2, ["q"]), (3, None)], "id long, names array<string>")
    assert [tuple(r) for r in G.name_pairs(lists, "id", "names").collect()] == [(1, "x", "y"), (1, "x", "z"), (1, "y", "z")]


@pytest.mark.parametrize("name", ["pagerank_converged", "ppr_converged"])
def test_converged_ranks_equal_brute_force(spark, name):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    edges = entry.queries()["pair_containment_graph"](spark, folder).collect()
    own = name == "ppr_converged"
    total, want = {}, {r.src: float(not own or r.src == 1) for r in edges}
    start = dict(want)
    for r in edges:
        total[r.src] = total.get(r.src, 0) + (r.weight if own else 1)
    for _ in range(200):
        new = {v: 0.1 * x for v, x in start.items()}
        for r in edges:
            new[r.dst] += 0.9 * want[r.src] * (r.weight if own else 1) / total[r.src]
        want = new
    got = {r.id: r["rank"] for r in entry.queries()[name](spark, folder).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[v] - want[v]) < 1e-5 for v in want)


def _random_pairs(n, count, seed=3):
    import random

    draw = random.Random(seed)
    return [(a, b) for a, b in ((draw.randrange(-3, n), draw.randrange(-3, n) if draw.random() < 0.7 else 7) for _ in range(count)) if a != b]


def test_triangles_shuffle_no_wedges(spark, monkeypatch):
    """Slices, vertices and wedges are cut in many places; a hub is next to all."""
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(G, "EDGES_A_SLICE", 3)
    monkeypatch.setattr(G, "AT_ONCE", 4)
    pairs = _random_pairs(40, 400)
    made = {tuple(sorted(p)) for p in pairs}
    want = {t for t in combinations(sorted({x for p in made for x in p}), 3) if all(p in made for p in combinations(t, 2))}
    found = G.triangles(edges(spark, pairs))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and found.dtypes == [("a", "bigint"), ("b", "bigint"), ("c", "bigint")]
    named = G.canonical(spark.createDataFrame([(f"v{a:03}", f"v{b:03}") for a, b in CLIQUES], "src string, dst string"))
    assert G.triangles(named).count() == 20
    assert G.triangles(edges(spark, CLIQUES).where("src > 99")).count() == 0


def test_shared_features_are_bounded_by_pairs(spark, monkeypatch):
    """As many tasks as pairs ask for; repeated rows, nulls, NaN and features of all items."""
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 100)
    rows = [(i, float(f)) for i in range(40) for f in (i % 3, 7)] * 2 + [(None, 7.0), (3, None), (50, float("nan")), (51, float("nan"))]
    own, shared, tasks = G.shared_features(spark.createDataFrame(rows, "i int, f double"), "i", "f")
    want = Counter()
    for f in {0.0, 1.0, 2.0, 7.0}:
        want.update(combinations(sorted({i for i, g in rows if g == f and i is not None}), 2))
    want[50, 51] = 1
    assert {(r.src, r.dst): r.shared for r in shared.collect()} == dict(want)
    assert own.count() == 82 and tasks == -(-sum(want.values()) // 100)
    assert f", {tasks}), REPARTITION_BY_NUM" in shared._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_long_run_are_made_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(G, "AT_ONCE", 10)
    rows = [("x", 1)] + [(f"{i:02}", 2) for i in range(30)] + [("a", 3), ("b", 3)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + 4]]), pa.array([r[1] for r in rows[k : k + 4]])], names=["i", "f"]) for k in range(0, len(rows), 4)]
    made = list(G._pairs_of_runs(iter(batches)))
    assert max(map(len, made)) < 40
    assert sorted((a, b) for m in made for a, b in zip(m.column(0).to_pylist(), m.column(1).to_pylist())) == sorted([*combinations([f"{i:02}" for i in range(30)], 2), ("a", "b")])


@pytest.mark.parametrize("source", [None, 7, 999])
def test_ranks_in_blocks_equal_joined_ranks(spark, monkeypatch, source):
    pairs = _random_pairs(60, 300)
    df = spark.createDataFrame([(a, b, abs(a - b)) for a, b in pairs] + [(7, None, 2)], "src int, dst int, weight int")
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 40)
    shuffled = []
    own, G.written = G.written, lambda df, purpose: shuffled.append(purpose) or own(df, purpose)
    try:
        got = {r.id: r["rank"] for r in G.page_rank(df, rounds=6, tolerance=0, source=source, weighted=True).collect()}
        assert "ranks" not in shuffled  # no round joins the edges again
        monkeypatch.setattr(G, "is_mounted", lambda spark: False)
        want = {r.id: r["rank"] for r in G.page_rank(df, rounds=6, tolerance=0, source=source, weighted=True).collect()}
    finally:
        G.written = own
    assert got.keys() == want.keys() and all(math.isclose(got[v], want[v], abs_tol=1e-12) for v in want)


def test_hops_with_repeated_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (2, 3)], "src long, dst long")
    assert sorted((r.id, r.hops) for r in G.hops(e, spark.createDataFrame([(1,), (1,), (77,)], "id long")).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_hops_join_no_links(spark):
    """Neighbours are looked up in flat files: what a round sorts is the frontier, not all links."""
    made = []
    own, G.written = G.written, lambda df, purpose: made.append((purpose, df._jdf.queryExecution().optimizedPlan().toString())) or own(df, purpose)
    try:
        pairs = _random_pairs(60, 90)
        got = {r.id: r.hops for r in G.hops(edges(spark, pairs), spark.range(7, 8)).collect()}
        assert len(made) > 2 and not any("links-" in plan for purpose, plan in made if purpose == "frontier")
        G.is_mounted, mounted = (lambda spark: False), G.is_mounted
        assert got == {r.id: r.hops for r in G.hops(edges(spark, pairs), spark.range(7, 8)).collect()} and len(got) > 30
        G.is_mounted = mounted
    finally:
        G.written = own


def test_communities_of_edges_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 10)
    pairs = _random_pairs(30, 80)
    e, members = edges(spark, pairs), spark.createDataFrame([(i, i % 3) for i in range(-3, 30)], "id long, community long")
    made = {tuple(sorted(p)) for p in pairs}
    met = G.in_large_communities(e, members, 2)
    assert f", {-(-len(made) // 10)}), REPARTITION_BY_NUM" in met._jdf.queryExecution().executedPlan().toString()
    assert {(r.src, r.dst): r.mutation for r in met.collect()} == {(a, b): a % 3 != b % 3 for a, b in made}
    inside = Counter(a % 3 for a, b in made if a % 3 == b % 3)
    stats = G.community_stats(e, members)
    assert f", {-(-len(made) // 10)}), REPARTITION_BY_NUM" in stats._jdf.queryExecution().executedPlan().toString()
    assert {r.community: r.internal for r in stats.collect()} == dict(inside)


def test_no_edges_at_all(spark):
    none = edges(spark, CLIQUES).where("src > 99")
    assert G.hops(none, spark.range(0, 1)).count() == 0 and G.triangles(none).count() == 0 and G.page_rank(none).count() == 0


def test_name_pairs_query_in_bounded_tasks(spark, monkeypatch):
    """Lines of an order are brought to as many tasks as their pairs ask for."""
    import __spark_entry__ as entry

    monkeypatch.setattr(storage, "ROWS_PER_TASK", 1000)
    made = entry.queries()["name_pairs"](spark, "/root/testdata/sf0.001")
    lines = Counter(r.l_orderkey for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").collect())
    tasks = -(-sum(n * (n - 1) // 2 for n in lines.values()) // 1000)
    assert tasks > 4 and f", {tasks}), REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
