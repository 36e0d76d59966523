"""From event lines and pages to articles with entities, places and stories' features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import entities as E
from gristmill.operators import pages as P
from gristmill.storage import written

#: Pages that one task parses.
PAGES_PER_TASK = 1000


def source_urls(lines: DataFrame, value: str = "value") -> DataFrame:
    """(url): distinct http links in the last field of tab-separated lines."""
    last = F.element_at(F.split(F.col(value), "\t", -1), -1)
    return lines.select(last.alias("url")).where(F.col("url").startswith("http")).distinct()


def enrich(
    pages: DataFrame,
    gazetteer: DataFrame,
    first_names: Sequence[str] = (),
    places: Sequence[str] = (),
    nicknames: Mapping[str, set[str]] | None = None,
    ident: str = "page_id",
    least_words: int = 0,
) -> DataFrame:
    """Article fields, sentiment, and sorted arrays of canonical persons and organizations and of placed locations, one row a page.

    Pages without any of a kind have an empty array. Places are resolved in the
    light of their page's other places. Pages are counted and spread over as many
    tasks as they ask for; articles and entities are written, so that each page
    is parsed once.
    """
    spread = pages.repartition(max(1, -(-pages.count() // PAGES_PER_TASK)))
    articles = written(P.articles(spread, ident, min_words=least_words), "articles")
    found = written(E.recognise(articles, ident, "body", first_names, places), "entities")
    person = E.dedup_names(found.where("kind = 'person'"), "entity", nicknames)
    company = E.dedup_organisations(found.where("kind = 'organization'"), "entity")
    canonical = person.select(F.lit("person").alias("kind"), "name", "preferred").unionAll(company.select(F.lit("organization"), "name", "preferred"))
    named = found.where("kind <> 'location'").join(canonical, (found["entity"] == canonical["name"]) & (found["kind"] == canonical["kind"])).select(ident, F.col("preferred").alias("entity"), found["kind"])
    placed = E.geo_in_context(found.where("kind = 'location'").withColumnRenamed("entity", "place"), gazetteer, ident)
    located = placed.select(ident, F.col("place").alias("entity"), F.lit("location").alias("kind"))
    return E.merge_entities(articles.withColumn("sentiment", T.sentiment(F.col("body"))), ident, named.unionAll(located))


def joined_streams(pages: DataFrame, records: DataFrame, late: str = "15 minutes", key: str = "url", ts: str = "time") -> DataFrame:
    """Rows of two streams (or tables) with the same key whose times are at most `late` apart; columns of records follow, its time as record_time."""
    other = records.withColumnsRenamed({key: "_key", ts: "record_time"})
    left = pages.withWatermark(ts, late) if pages.isStreaming else pages
    right = other.withWatermark("record_time", late) if other.isStreaming else other
    near = F.expr(f"record_time BETWEEN {ts} - INTERVAL {late} AND {ts} + INTERVAL {late}")
    return left.join(right, (F.col(key) == F.col("_key")) & near).drop("_key")
