"""Queries over likeness: simhash variants, cosine neighbours, places in context, merged entities, links and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import masks as M
from gristmill.functions import simhash as S
from gristmill.functions import text as T
from gristmill.operators import entities as E
from gristmill.operators import graph as G
from gristmill.operators import learning, pages
from gristmill.plans import enrichment
from gristmill.plans.graphs import EDGES, bought_together
from gristmill.plans.records import PLACES
from gristmill.plans.registry import query, table
from gristmill.plans.texts import HASHES
from gristmill.storage import tasks_for
from gristmill.streaming import trends

WEIGHTED = """s AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 2)), lambda i: CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END)) AS s, unnest(range(greatest(len(w) - 1, 1), 0, -1)) AS n FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)),
h AS (SELECT doc_id, n, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) AS h FROM s),
b AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN n ELSE -n END) AS t FROM h, range(32) AS r(b) GROUP BY 1, 2)"""


@query(f"WITH {WEIGHTED} SELECT doc_id AS id, CAST(sum(CASE WHEN t > 0 THEN CAST(1 AS BIGINT) << b ELSE 0 END) AS BIGINT) AS simhash FROM b GROUP BY 1")
def simhash_weighted(spark, sf_dir):
    return S.simhash(table(spark, sf_dir, "documents"), "doc_id", "text", weighted=True)


@query(f"WITH {HASHES} SELECT id, CAST(bit_count(xor(simhash, CAST(1234567890 AS BIGINT))) AS INTEGER) AS distance FROM hashes WHERE bit_count(xor(simhash, CAST(1234567890 AS BIGINT))) <= 12")
def simhash_lookup(spark, sf_dir):
    return S.near_hash(S.simhash(table(spark, sf_dir, "documents"), "doc_id", "text"), 1234567890, 12)


COSINE = """pairs AS (SELECT q.vec_id AS src, v.vec_id AS dst, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS similarity
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)"""


def _near(spark, sf_dir, n):
    e = table(spark, sf_dir, "embeddings")
    return learning.most_similar(e, e.where("vec_id % 100 = 0"), n, "vec_id", "embedding")


@query(f"WITH {COSINE}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM pairs WHERE similarity > 0) SELECT src, dst, round(similarity, 6) AS similarity FROM r WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    """Queries are the ids divisible by 100, against all rows."""
    return _near(spark, sf_dir, 10).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {COSINE}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM pairs WHERE similarity > 0) SELECT src, dst, round(similarity / sum(similarity) OVER (PARTITION BY src), 6) AS weight FROM r WHERE rank <= 5")
def knn_graph(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))
    return learning.synonym_graph(e, e.where("word % 100 = 0").select("word")).withColumn("weight", F.round("weight", 6))


@query(f"""WITH g AS (SELECT *, CASE feature WHEN 'PCLI' THEN 2 WHEN 'PPLA' THEN 3 ELSE 12 END AS rank FROM ({PLACES}) WHERE feature <> 'HTL'),
m AS (SELECT DISTINCT o_custkey % 50 AS doc, c_mktsegment AS name FROM orders JOIN customer ON c_custkey = o_custkey),
met AS (SELECT m.doc, m.name, g.*EXCLUDE (name) FROM m JOIN g ON g.name = m.name),
c AS (SELECT DISTINCT doc, country FROM met WHERE feature = 'PCLI')
SELECT doc AS doc_id, name, geo_id, country FROM (SELECT met.*, row_number() OVER (PARTITION BY met.doc, name ORDER BY c.country IS NULL, rank, population DESC, geo_id) AS r FROM met LEFT JOIN c ON c.doc = met.doc AND c.country = met.country) WHERE r = 1""")
def geo_in_context(spark, sf_dir):
    """Places of customers' segments, in the light of the others that share a remainder of the customer's number."""
    c = table(spark, sf_dir, "customer")
    feature = F.element_at(F.array(*map(F.lit, ("PCLI", "PPLA", "PPL", "HTL"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    gazetteer = c.select(F.col("c_custkey").alias("geo_id"), F.col("c_mktsegment").alias("name"), F.lit(None).cast("array<string>").alias("names"), F.col("c_nationkey").cast("string").alias("country"), F.lit("").alias("admin"), feature.alias("feature"), F.round("c_acctbal").cast("bigint").alias("population"))
    mentions = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select((F.col("o_custkey") % 50).alias("doc_id"), F.col("c_mktsegment").alias("place"))
    return E.geo_in_context(mentions, gazetteer).select("doc_id", "name", "geo_id", "country")


@query("""SELECT o_orderkey, coalesce(list_aggregate(p, 'string_agg', ','), '') AS person, coalesce(list_aggregate(o, 'string_agg', ','), '') AS organization FROM orders LEFT JOIN
(SELECT l_orderkey, list_sort(list(DISTINCT p_type) FILTER (WHERE l_linenumber % 2 = 0)) AS p, list_sort(list(DISTINCT p_brand) FILTER (WHERE l_linenumber % 2 = 1)) AS o FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ON l_orderkey = o_orderkey""")
def merged_entities(spark, sf_dir):
    """Orders as articles; their parts' types and brands as persons and organizations."""
    t = lambda n: table(spark, sf_dir, n)
    even = F.col("l_linenumber") % 2 == 0
    found = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("o_orderkey"), F.when(even, F.col("p_type")).otherwise(F.col("p_brand")).alias("entity"), F.when(even, "person").otherwise("organization").alias("kind")
    )
    merged = E.merge_entities(t("orders").select("o_orderkey"), "o_orderkey", found)
    return merged.select("o_orderkey", F.array_join("person", ",").alias("person"), F.array_join("organization", ",").alias("organization"))


@query()
def enrich_pages(spark, sf_dir):
    """Pages with articles, sentiment and their canonical entities; nations are the known places."""
    nations = table(spark, sf_dir, "nation")
    gazetteer = nations.select(
        F.col("n_nationkey").alias("geo_id"), F.initcap("n_name").alias("name"), F.lit(None).cast("array<string>").alias("names"), F.col("n_nationkey").cast("string").alias("country"),
        F.lit("").alias("admin"), F.lit("PCLI").alias("feature"), F.lit(1).cast("bigint").alias("population"),
    )
    return enrichment.enrich(table(spark, sf_dir, "pages"), gazetteer, ["Mary", "John"], [f"Nation {i}" for i in range(25)])


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<meta\\s+(?:name|property)=\"og:title\"\\s+content=\"([^\"]*)\"', 1)), '') AS og_title, nullif(trim(regexp_extract(html, '(?i)<meta\\s+(?:name|property)=\"description\"\\s+content=\"([^\"]*)\"', 1)), '') AS description FROM pages")
def html_meta(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", pages.raw_meta(html, "og:title").alias("og_title"), pages.raw_meta(html, "description").alias("description"))


@query("SELECT url, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT url, '#' || regexp_replace(lower(w), '[^a-z].*$', '') AS tag FROM (SELECT url, unnest(string_split(html, ' ')[1:3]) AS w FROM pages WHERE url LIKE 'http%')) WHERE length(tag) > 5 GROUP BY 1")
def linked_tags(spark, sf_dir):
    """Messages of a link and of tags made of the page's first words."""
    w = F.transform(F.slice(F.split("html", " "), 1, 3), lambda x: F.concat(F.lit("#"), F.regexp_replace(F.lower(x), "[^a-z].*$", "")))
    made = table(spark, sf_dir, "pages").where(F.col("url").startswith("http")).select(F.concat_ws(" ", F.lit("see"), "url", F.array_join(w, " ")).alias("body"))
    return trends.linked_tags(made).select("url", F.array_join("tags", ",").alias("tags"))


@query("SELECT conv_id, turn, len(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda w: length(w) > 3 AND w NOT IN (" + ", ".join(repr(w) for w in T.STOP_WORDS) + "))) AS tokens FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\x7f]')")
def token_count(spark, sf_dir):
    """Turns in plain ASCII."""
    c = table(spark, sf_dir, "conversations").where(~F.col("text").rlike("[^\\x00-\\x7f]"))
    return c.select("conv_id", "turn", F.size(T.tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query(f"""WITH {EDGES}, big AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 3)
SELECT src, dst, weight, a.p_brand <> b.p_brand AS mutation FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand IN (SELECT * FROM big) OR b.p_brand IN (SELECT * FROM big)""")
def community_edges(spark, sf_dir):
    members = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return G.in_large_communities(bought_together(spark, sf_dir), members, 3)


@query("WITH l AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS r FROM lineitem) SELECT a.l_orderkey, a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS n FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.r < b.r GROUP BY 1, 2, 3")
def name_pairs(spark, sf_dir):
    """Pairs of an order's suppliers, as of the names in an article."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("l_suppkey", "l_linenumber", "l_partkey"))), lambda s: s["l_suppkey"])
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]
    per = lines.repartition(tasks_for(int(pairs or 0)), "l_orderkey").groupBy("l_orderkey").agg(listed.alias("names"))
    return G.name_pairs(per, "l_orderkey", "names").groupBy("l_orderkey", "src", "dst").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, p_name AS name, p_brand AS community FROM part")
def exported_nodes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    members = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return G.export_nodes(members, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("WITH w AS (SELECT event_type AS key, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 42 HOUR, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), INTERVAL 6 HOUR)) AS s FROM events), c AS (SELECT s, key, count(*) AS n FROM w GROUP BY 1, 2) SELECT s + INTERVAL 48 HOUR AS window_end, s AS window_start, key, n FROM c WHERE s = (SELECT max(s) FROM c) ORDER BY n DESC, key LIMIT 3")
def trending_keys(spark, sf_dir):
    """The three most frequent types of the latest window: a top-k report."""
    return trends.top_keys(trends.trend_counts(table(spark, sf_dir, "events"), "ts", "event_type", slide="6 hours"), 3)


@query("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'ca' ELSE 'ny' END AS state FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 < 2")
def states_found(spark, sf_dir):
    """States from free-text locations, by name or by code."""
    states = spark.createDataFrame([("ca", "California"), ("ny", "Gotham")], "code string, name string")
    where = F.when(F.col("user_id") % 3 == 0, "Somewhere in California, NY").when(F.col("user_id") % 3 == 1, "the city, (NY)").otherwise("Paris")
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("location", where)
    return E.state_of(users, "user_id", "location", states)


@query("SELECT c_custkey, c_name, string_agg('U+' || lpad(upper(hex(unicode(c))), 4, '0'), ' ' ORDER BY i) AS points FROM (SELECT c_custkey, c_name, unnest(string_split(c_name, '')) AS c, unnest(range(length(c_name))) AS i FROM customer) GROUP BY 1, 2")
def unicode_points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.array_join(M.unicode_mask(F.col("c_name")), " ").alias("points"))
