"""Queries over graphs that the tables hold: parts bought together, suppliers and nations of the same orders."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gristmill.operators import graph as G
from gristmill.plans.registry import query, table
from gristmill.storage import written

OWN = "own AS (SELECT DISTINCT l_partkey AS i, l_orderkey AS f FROM lineitem)"
EDGES = f"""{OWN}, edges AS (SELECT x.i AS src, y.i AS dst, count(*) AS weight FROM own x JOIN own y ON x.f = y.f AND x.i < y.i GROUP BY 1, 2)"""
SIMILAR = f"""{OWN}, n AS (SELECT i, count(*) AS n FROM own GROUP BY 1),
shared AS (SELECT x.i AS src, y.i AS dst, count(*) AS shared FROM own x JOIN own y ON x.f = y.f AND x.i <> y.i GROUP BY 1, 2),
graph AS (SELECT src, dst, shared, shared / n AS weight FROM shared JOIN n ON n.i = src)"""


def bought_together(spark, sf_dir):
    """Canonical edges between parts of the same order; weight counts orders."""
    return G.shared_features(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")[1].withColumnRenamed("shared", "weight")


@query(f"WITH {SIMILAR} SELECT src, dst, shared, weight FROM graph")
def pair_containment_graph(spark, sf_dir):
    return G.containment(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")


@query(f"WITH {SIMILAR} SELECT src, dst, weight AS similarity, 1.0 / count(*) OVER (PARTITION BY src) AS weight FROM graph")
def normalised_similarity(spark, sf_dir):
    return G.normalised_weights(pair_containment_graph(spark, sf_dir))


def _rank_sql(base: str, start: str, share: str) -> str:
    """Three unrolled rounds; every step is computed once."""
    once = re.sub(r"(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", SIMILAR)
    rounds = ", ".join(
        f"r{k} AS MATERIALIZED (SELECT v.i AS id, {base} + 0.9 * coalesce(g.s, 0) AS rank FROM n v LEFT JOIN (SELECT dst, sum(CAST(rank AS DOUBLE) * share) AS s FROM share JOIN r{k - 1} ON id = src GROUP BY 1) g ON g.dst = v.i)" for k in (1, 2, 3)
    )
    return f"WITH {once}, known AS MATERIALIZED (SELECT DISTINCT src FROM graph), share AS MATERIALIZED (SELECT src, dst, CAST({share} AS DOUBLE) AS share FROM graph), r0 AS MATERIALIZED (SELECT i AS id, CAST({start} AS DOUBLE) AS rank FROM n WHERE i IN (SELECT src FROM known)), {rounds} SELECT id, round(rank, 6) AS rank FROM r3 WHERE id IN (SELECT src FROM known)"


@query(_rank_sql("0.1", "1.0", "1.0 / count(*) OVER (PARTITION BY src)"))
def pagerank_fixed(spark, sf_dir):
    made = G.page_rank(pair_containment_graph(spark, sf_dir), rounds=3, tolerance=0)
    return made.select("id", F.round("rank", 6).alias("rank"))


@query(_rank_sql("CASE WHEN v.i = 1 THEN 0.1 ELSE 0 END", "CASE WHEN i = 1 THEN 1.0 ELSE 0.0 END", "weight / sum(weight) OVER (PARTITION BY src)"))
def ppr_fixed(spark, sf_dir):
    made = G.page_rank(pair_containment_graph(spark, sf_dir), rounds=3, tolerance=0, source=1, weighted=True)
    return made.select("id", F.round("rank", 6).alias("rank"))


@query()
def pagerank_converged(spark, sf_dir):
    return G.page_rank(pair_containment_graph(spark, sf_dir), tolerance=1e-6)


@query()
def ppr_converged(spark, sf_dir):
    return G.page_rank(pair_containment_graph(spark, sf_dir), tolerance=1e-6, source=1, weighted=True)


@query(f"WITH {EDGES} SELECT id, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted FROM (SELECT src AS id, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY 1")
def degrees(spark, sf_dir):
    return G.degrees(bought_together(spark, sf_dir))


@query(f"""WITH {EDGES}, t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst)
SELECT id, count(*) AS triangles FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY 1""")
def triangles(spark, sf_dir):
    return G.triangle_counts(written(bought_together(spark, sf_dir), "bought"))


@query(f"""WITH RECURSIVE {EDGES}, links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
r AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS hops WHERE 1 IN (SELECT src FROM links) UNION SELECT dst, hops + 1 FROM r JOIN links ON src = id WHERE hops < 8),
h AS (SELECT id, min(hops) AS hops FROM r GROUP BY 1)
SELECT id, least(hops / greatest(max(hops) OVER (), 1), 1.0) AS distance FROM h""")
def bfs_hops(spark, sf_dir):
    return G.landmark_distance(written(bought_together(spark, sf_dir), "bought"), spark.range(1, 2))


@query(f"""WITH {EDGES}, e AS (SELECT a.p_brand AS ca, b.p_brand AS cb FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst),
c AS (SELECT unnest(CASE WHEN ca = cb THEN [ca] ELSE [ca, cb] END) AS community, ca = cb AS inside FROM e),
s AS (SELECT community, count(*) FILTER (WHERE inside) AS internal, count(*) FILTER (WHERE NOT inside) AS external FROM c GROUP BY 1)
SELECT p_brand AS community, count(*) AS size, coalesce(max(internal), 0) AS internal, coalesce(max(external), 0) AS external, 2 * coalesce(max(internal), 0) / CAST(count(*) * count(*) AS DOUBLE) AS density
FROM part LEFT JOIN s ON community = p_brand GROUP BY 1""")
def community_stats(spark, sf_dir):
    members = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return G.community_stats(bought_together(spark, sf_dir), members)


@query("SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL)")
def dictionary_encode(spark, sf_dir):
    return G.dense_ids(table(spark, sf_dir, "part"), "p_name")


NATIONS = """SELECT least(s_nationkey, c_nationkey) AS src, greatest(s_nationkey, c_nationkey) AS dst, count(*) AS weight FROM lineitem
JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2"""


def _trade(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    met = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return G.canonical(met.select(F.col("s_nationkey").cast("bigint").alias("src"), F.col("c_nationkey").cast("bigint").alias("dst")))


@query(f"SELECT id, string_agg(other, ',' ORDER BY other) AS targets, string_agg(weight, ',' ORDER BY other) AS weights FROM (SELECT src AS id, dst AS other, weight FROM ({NATIONS}) UNION ALL SELECT dst, src, weight FROM ({NATIONS})) GROUP BY 1")
def adjacency_lists(spark, sf_dir):
    return G.adjacency(_trade(spark, sf_dir)).select("id", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"), F.array_join(F.col("weights").cast("array<string>"), ",").alias("weights"))


@query()
def louvain_nations(spark, sf_dir):
    return G.louvain(_trade(spark, sf_dir))


@query()
def wcc_nations(spark, sf_dir):
    return G.wcc_communities(_trade(spark, sf_dir))


@query()
def random_walk_nations(spark, sf_dir):
    trade = written(G.both_ways(_trade(spark, sf_dir)), "trade")
    starts = trade.select(F.col("src").alias("id")).distinct()
    return G.random_walks(trade, starts, starts.where("id = 0"), steps=10, walks=20)
