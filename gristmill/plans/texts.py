"""Queries over texts, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import simhash as S
from gristmill.functions import text as T
from gristmill.operators import learning, pages
from gristmill.operators.components import connected_components
from gristmill.plans.registry import query, table
from gristmill.storage import written

HASHES = """s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)),
h AS (SELECT doc_id, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) AS h FROM s),
b AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS t FROM h, range(32) AS r(b) GROUP BY 1, 2),
hashes AS (SELECT doc_id AS id, CAST(sum(CASE WHEN t > 0 THEN CAST(1 AS BIGINT) << b ELSE 0 END) AS BIGINT) AS simhash FROM b GROUP BY 1)"""
PAIRS = f"""{HASHES}, pairs AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.simhash, y.simhash)) AS distance FROM hashes x JOIN hashes y ON x.id < y.id WHERE bit_count(xor(x.simhash, y.simhash)) <= 4)"""


def _hashes(spark, sf_dir):
    return S.simhash(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {HASHES} SELECT id, simhash, lpad(bin(simhash), 32, '0') AS bits FROM hashes")
def shingle_simhash(spark, sf_dir):
    return _hashes(spark, sf_dir).withColumn("bits", S.bit_string(F.col("simhash")))


@query(f"WITH {PAIRS} SELECT a, b, CAST(distance AS INTEGER) AS distance FROM pairs")
def simhash_near_dup(spark, sf_dir):
    return S.near_pairs(written(_hashes(spark, sf_dir), "hashes"), 4)


@query(f"""WITH RECURSIVE {PAIRS}, links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r AS (SELECT a, a AS c FROM links UNION SELECT links.b, r.c FROM r JOIN links ON links.a = r.a WHERE r.c < links.b)
SELECT a AS id, min(c) AS component FROM r GROUP BY 1""")
def near_dup_components(spark, sf_dir):
    return connected_components(S.near_pairs(written(_hashes(spark, sf_dir), "hashes"), 4, stars=True), "a", "b")


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(text, '([A-Za-z]{5,})', '#\\1', 'g')), '(#[a-z]+)', 1)) AS tag FROM conversations WHERE NOT regexp_matches(text, '[^\\x00-\\x7f]')) WHERE length(tag) > 5 GROUP BY 1")
def hashtag_count(spark, sf_dir):
    """Turns in plain ASCII whose long words are made tags."""
    c = table(spark, sf_dir, "conversations").where(~F.col("text").rlike("[^\\x00-\\x7f]")).select(F.regexp_replace("text", "([A-Za-z]{5,})", "#$1").alias("text"))
    return c.select(F.explode(T.hashtags(F.col("text"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT page_id, unnest(['https://t.co/' || page_id, url]) AS url FROM pages WHERE url LIKE 'http%' UNION ALL SELECT page_id, 'https://t.co/' || page_id FROM pages WHERE url NOT LIKE 'http%' OR url IS NULL")
def url_extract(spark, sf_dir):
    """Messages with a short link, and the page's address after a word."""
    body = F.concat_ws(" ", F.lit("read"), F.concat(F.lit("https://t.co/"), F.col("page_id").cast("string")), F.lit("\tor"), "url")
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.urls(body)).alias("url"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, md5(regexp_replace(url, '#.*$', '')) AS key FROM pages WHERE url LIKE 'http%'")
def url_host_clean(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(F.col("url").startswith("http"))
    return p.select("page_id", T.host(F.col("url")).alias("host"), F.md5(T.clean_url(F.col("url"))).alias("key"))


@query("SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.raw_title(F.col("html")).alias("title"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS target FROM pages""")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(pages.link_targets(F.col("html"))).alias("target"))


@query()
def html_articles(spark, sf_dir):
    return pages.articles(table(spark, sf_dir, "pages"))


@query("SELECT p.page_id, p.url FROM pages p WHERE p.url LIKE 'http%' AND regexp_extract(p.url, '^[a-z]+://([^/:?#]+)', 1) NOT IN (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) FROM pages WHERE url LIKE '%utm_source=%' AND url LIKE 'http%')")
def anti_hosts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(F.col("url").startswith("http"))
    bad = p.where(F.col("url").contains("utm_source=")).select(T.host(F.col("url")).alias("host")).distinct()
    return pages.trusted(p, bad).select("page_id", "url")


WORDS = "list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda w: w <> '')"


@query(f"SELECT lang, count(*) AS docs, CAST(sum(len({WORDS})) AS BIGINT) AS words, CAST(count(*) FILTER (WHERE len({WORDS}) > 150) AS BIGINT) AS over_150, CAST(count(*) FILTER (WHERE length(text) > 255) AS BIGINT) AS over_255_chars FROM documents WHERE text IS NOT NULL GROUP BY 1")
def doc_count_stats(spark, sf_dir):
    n = F.size(T.words(F.col("text")))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(n).alias("words"), F.count_if(n > 150).alias("over_150"), F.count_if(F.length("text") > 255).alias("over_255_chars"))


@query(f"SELECT doc_id, CAST(len(list_filter({WORDS.replace('text', 'lower(text)')}, lambda w: regexp_replace(w, '^[^a-z]+|[^a-z]+$', '', 'g') IN ({', '.join(repr(w) for w in T.STOP_WORDS)}))) AS INTEGER) AS stop_words FROM documents WHERE text IS NOT NULL")
def stopword_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.stop_word_count(F.col("text")).alias("stop_words"))


@query("""WITH m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS centre FROM m GROUP BY 1)
SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 6) AS cosine, round(list_distance(CAST(embedding AS DOUBLE[]), centre), 6) AS distance FROM embeddings JOIN c USING (label)""")
def centre_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    met = e.join(centres, "label")
    return met.select("vec_id", "label", F.round(learning.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"), F.round(learning.euclidean(F.col("embedding"), F.col("centre")), 6).alias("distance"))


@query()
def kmeans_distance(spark, sf_dir):
    return learning.cluster(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", 5)[1].drop("v")


@query()
def nb_tagger(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.array("lang").alias("own"))
    model = learning.fit_tagger(docs, "text", "own", idf=True)
    return learning.predict_tags(model, docs.select("doc_id", "text")).select("doc_id", "tag", "tags")


@query()
def embedded_documents(spark, sf_dir):
    return learning.embed(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 100")
def top_words(spark, sf_dir):
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")
    return table(spark, sf_dir, "conversations").select(words).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)
