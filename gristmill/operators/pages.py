"""Web pages as rows: articles, titles and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.html import article_udf
from gristmill.functions.text import host


def articles(pages: DataFrame, ident: str = "page_id", html: str = "html", url: str = "url", min_words: int = 0) -> DataFrame:
    """(ident, url, article fields): every page's article; with min_words only those with as many words in the body."""
    made = pages.select(ident, F.col(url).alias("url"), article_udf()(F.col(html), F.col(url)).alias("a")).select(ident, "url", "a.*")
    return made if min_words == 0 else made.where(F.size(F.split(F.trim("body"), r"\s+")) >= min_words)


def raw_title(html: Column) -> Column:
    """Text of the first title element, blanks joined; null without one. Stays within the JVM."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def raw_meta(html: Column, name: str) -> Column:
    """Content of the first meta element of a name or property, in double quotes; null without one. Stays within the JVM."""
    found = F.regexp_extract(html, rf'(?i)<meta\s+(?:name|property)="{name}"\s+content="([^"]*)"', 1)
    return F.nullif(F.trim(found), F.lit(""))


def link_targets(html: Column) -> Column:
    """Array of the targets of links in double quotes, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), 1)


def trusted(pages: DataFrame, untrusted: DataFrame, url: str = "url") -> DataFrame:
    """Pages with a valid URL whose host isn't among untrusted (host)."""
    named = pages.withColumn("_host", F.lower(host(F.col(url)))).where("_host IS NOT NULL")
    return named.join(untrusted.select(F.lower("host").alias("_host")), "_host", "left_anti").drop("_host")
