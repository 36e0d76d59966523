"""Entities: recognition by rules, deduplication of names and organisations, and places from a gazetteer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.phonetic import name_keys_udf
from gristmill.storage import written

COMPANY_ENDS = ("Inc", "Ltd", "LLC", "PLC", "Corp", "Corporation", "Company", "Group", "Bank", "University", "Institute", "Agency", "Council", "Ministry")

#: Rank of gazetteer feature codes (smaller is more important) and their kind.
FEATURES = {
    "CONT": (0, "zone"), "ZN": (1, "zone"),
    "PCL": (2, "country"), "PCLD": (2, "country"), "PCLF": (2, "country"), "PCLI": (2, "country"), "PCLIX": (2, "country"), "PCLS": (2, "country"), "PPLC": (2, "city"),
    "PPLG": (3, "city"), "PPLA": (3, "city"), "PPLA2": (3, "city"), "ADM1": (3, "state"),
    "ADM2": (4, "other"), "ADM3": (6, "other"), "PPLA3": (7, "other"),
    "ADM4": (8, "other"), "ADM5": (8, "other"), "SEA": (8, "other"), "MNT": (8, "other"), "MNTS": (8, "other"), "STM": (8, "other"), "CNYN": (8, "other"),
    "PPLA4": (10, "other"), "PPL": (12, "other"),
}


def feature_table(spark) -> DataFrame:
    """(feature, rank, kind) of the ranked feature codes."""
    return spark.createDataFrame([(f, r, k) for f, (r, k) in FEATURES.items()], "feature string, rank int, kind string")


def recognise(df: DataFrame, ident: str, text: str, first_names: Sequence[str] = (), places: Sequence[str] = ()) -> DataFrame:
    """(ident, entity, kind): runs of capitalised words that rules call person, organization or location.

    An approximation without a trained model: a run is a location if it's among
    places, an organization if it ends in a company word, a person from the first
    word on that is among first_names; other runs are left out.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(r"\b(\p{Lu}[\p{L}']+(?: \p{Lu}[\p{L}']+)*)"), 1)
    found = df.select(F.col(ident).alias(ident), F.explode(runs).alias("entity"))
    parts = F.split("entity", " ")
    first = F.array_position(F.transform(parts, lambda w: w.isin(*first_names)), True).cast("int")
    kind = F.when(F.col("entity").isin(*places), "location").when(F.element_at(parts, -1).isin(*COMPANY_ENDS), "organization").when(first > 0, "person")
    named = F.when(kind == "person", F.array_join(F.slice(parts, first, F.size(parts)), " ")).otherwise(F.col("entity"))
    return found.select(ident, named.alias("entity"), kind.alias("kind")).where("kind IS NOT NULL")


def context_dedup(mentions: DataFrame, doc: str = "doc_id", name: str = "name") -> DataFrame:
    """(doc, name, preferred): within a document a word of more than three letters that exactly two names share joins them to the longer.

    Names of equal length: the first in order. Names that share nothing are their own.
    """
    own = mentions.select(F.col(doc).alias("doc"), F.col(name).alias("name")).where("doc IS NOT NULL AND name IS NOT NULL").distinct()
    words = own.select("doc", "name", F.explode(F.array_distinct(F.split(F.lower("name"), r"\s+"))).alias("part")).where(F.length("part") > 3)
    best = F.min(F.struct(-F.length("name"), "name"))["name"]
    shared = words.groupBy("doc", "part").agg(F.count("*").alias("n"), best.alias("preferred"), F.collect_list("name").alias("names")).where("n = 2")
    mapped = shared.select("doc", "preferred", F.explode("names").alias("name")).groupBy("doc", "name").agg(F.min(F.struct(-F.length("preferred"), "preferred"))["preferred"].alias("preferred"))
    return own.join(mapped, ["doc", "name"], "left").select(F.col("doc").alias(doc), F.col("name").alias(name), F.coalesce("preferred", "name").alias("preferred"))


def _most_frequent(name: str, n: str = "n") -> Column:
    """Name of the largest count, the first in order among equals."""
    return F.min(F.struct(-F.col(n), F.col(name)))[name]


def dedup_names(names: DataFrame, name: str = "name", nicknames: Mapping[str, set[str]] | None = None, stop_words: Sequence[str] = T.TITLES) -> DataFrame:
    """(name, preferred): every distinct name and the most frequent variant of the person it stands for.

    Variants have the same cleaned form, or cleaned forms of the same phonetic
    key, where nicknames also count as the full names they may stand for
    (phonetic key to phonetic keys). Names without a letter are their own.
    """
    counted = names.select(F.col(name).alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n")).withColumn("clean", T.clean_name(F.col("name"), stop_words))
    forms = counted.where("clean <> ''").groupBy("clean").agg(F.sum("n").alias("n"), _most_frequent("name").alias("variant"))
    keyed = forms.select("clean", "n", "variant", F.explode(name_keys_udf(nicknames or {})(F.col("clean"))).alias("key"))
    heads = keyed.groupBy("key").agg(F.min(F.struct(-F.col("n"), "clean", "variant")).alias("head"))
    chosen = keyed.join(heads, "key").groupBy("clean").agg(F.min("head")["variant"].alias("preferred"))
    return counted.join(chosen, "clean", "left").select("name", F.coalesce("preferred", "name").alias("preferred"))


def dedup_organisations(names: DataFrame, name: str = "name", stop_words: Sequence[str] = T.COMPANY_WORDS) -> DataFrame:
    """(name, preferred): organisations with the same cleaned form are one, and so are a name of several words and its initials.

    The heavier (more mentions) of the long and the short form gives the name.
    """
    counted = names.select(F.col(name).alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n")).withColumn("clean", T.clean_name(F.col("name"), stop_words))
    forms = counted.where("clean <> ''").groupBy("clean").agg(F.sum("n").alias("n"), _most_frequent("name").alias("variant")).withColumn("short", T.initials(F.col("clean")))
    heads = forms.groupBy("short").agg(_most_frequent("variant").alias("preferred"))
    return counted.join(forms.join(heads, "short").select("clean", "preferred"), "clean", "left").select("name", F.coalesce("preferred", "name").alias("preferred"))


def gazetteer_names(gazetteer: DataFrame) -> DataFrame:
    """(key, geo_id, place, country, state, feature, rank, kind, population, zone): a row for every cleaned name of every ranked place."""
    ranked = gazetteer.join(F.broadcast(feature_table(gazetteer.sparkSession)), "feature")  # 25 rows
    names = F.array_distinct(F.transform(F.array_union(F.array("name"), F.coalesce("names", F.array().cast("array<string>"))), T.clean_place))
    zone = F.element_at(F.col("timezone"), 1) if "timezone" in gazetteer.columns else F.lit(None).cast("string")
    return ranked.select(F.explode(names).alias("key"), "geo_id", F.col("name").alias("place"), "country", F.col("admin").alias("state"), "feature", "rank", "kind", "population", zone.alias("zone")).where("key <> ''")


def geo_best(places: DataFrame, gazetteer: DataFrame, place: str = "place") -> DataFrame:
    """(name, geo_id, place, country, state): for each distinct name the place of least rank, then most people, then least id.

    The join is an equi-join on the cleaned name; AQE and runtime Bloom filters
    cut the gazetteer down where that pays.
    """
    names = places.select(F.col(place).alias("name")).where("name IS NOT NULL").distinct().withColumn("key", T.clean_place(F.col("name")))
    met = names.join(gazetteer_names(gazetteer), "key")
    best = met.groupBy("name").agg(F.min(F.struct("rank", -F.coalesce("population", F.lit(0)), "geo_id", "place", "country", "state")).alias("b"))
    return best.select("name", "b.geo_id", "b.place", "b.country", "b.state")


def geo_in_context(mentions: DataFrame, gazetteer: DataFrame, doc: str = "doc_id", place: str = "place") -> DataFrame:
    """(doc, name, geo_id, place, country, state): the place of each mention, in the light of the document's other mentions.

    Countries among a document's candidates, and the first part of their time
    zone, make its country zones; states among them make state zones. A mention
    takes the candidate that lies in a country zone, then in a state zone with
    evidence from another place, then of least rank, most people and least id.
    Names are cut down to the candidates that can win before mentions meet them.
    """
    own = mentions.select(F.col(doc).alias("doc"), F.col(place).alias("name")).where("doc IS NOT NULL AND name IS NOT NULL").distinct()
    own = written(own.withColumn("key", T.clean_place(F.col("name"))), "mentions")
    named = gazetteer_names(gazetteer).select("key", "kind", "country", F.split("zone", "/")[0].alias("zone"), "state", F.struct("rank", (-F.coalesce("population", F.lit(0))).alias("p"), "geo_id", "place").alias("o"))
    named = written(named, "names")
    signs = named.where("kind = 'country'").select("key", "country", "zone").distinct()
    sets = own.select("doc", "key").distinct().join(signs, "key", "left").groupBy("doc").agg(F.collect_set("country").alias("countries"), F.collect_set("zone").alias("zones"))
    ends = named.where("kind = 'state'").groupBy("key", "country", "state").agg(F.min("o.geo_id").alias("lo"), F.max("o.geo_id").alias("hi"))
    states = own.select("doc", "key").distinct().join(ends, "key").groupBy("doc", "country", "state").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    placed = own.join(_best_two(named), "key").join(sets, "doc").join(states, ["doc", "country", "state"], "left")
    in_country = F.array_contains("countries", F.col("country")) | F.coalesce(F.array_contains("zones", F.col("zone")), F.lit(False))
    in_state = (F.col("lo") != F.col("o.geo_id")) | (F.col("hi") != F.col("o.geo_id"))
    order = F.struct((~in_country).alias("c"), (~F.coalesce(in_state, F.lit(False))).alias("s"), "o.rank", "o.p", "o.geo_id", "o.place", "country", "state")
    best = placed.groupBy("doc", "name").agg(F.min(order).alias("b"))
    return best.select(F.col("doc").alias(doc), "name", "b.geo_id", "b.place", "b.country", "b.state")


def _best_two(named: DataFrame) -> DataFrame:
    """Of the rows of a name, country, zone and state the least o, and the least of another geo_id.

    Only these can win in any document: the rows differ in nothing but o, and a
    state's evidence speaks for all of them but, at most, for its own place.
    """
    group = ["key", "country", "zone", "state"]
    first = named.groupBy(*group).agg(F.min("o").alias("o"))
    one = first.select(*[F.col(c).alias(f"{c}_1") for c in group], F.col("o.geo_id").alias("geo_1"))
    same = F.lit(True)
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_1"))
    second = named.join(one, same).where(~F.col("o.geo_id").eqNullSafe(F.col("geo_1"))).groupBy(*group).agg(F.min("o").alias("o"))
    return first.unionAll(second)


def state_of(df: DataFrame, ident: str, location: str, states: DataFrame) -> DataFrame:
    """(ident, state): the state code (code, name) whose code or name comes first in a free-text location; rows without any are left out."""
    tokens = df.select(F.col(ident).alias(ident), F.posexplode(F.split(F.trim(F.regexp_replace(F.lower(location), r"[^a-z]+", " ")), " ")).alias("pos", "word"))
    listed = states.select("code", F.explode(F.array(F.lower("code"), F.lower("name"))).alias("word"))
    hit = tokens.join(F.broadcast(listed), "word")  # a fixed list of states
    return hit.groupBy(ident).agg(F.min(F.struct("pos", "code"))["code"].alias("state"))


def merge_entities(articles: DataFrame, ident: str, found: DataFrame, kinds: Sequence[str] = ("person", "organization", "location")) -> DataFrame:
    """articles with one sorted array column for each kind of entity; empty arrays where an article has none."""
    lists = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("entity")))).alias(k) for k in kinds]
    per = found.groupBy(ident).agg(*lists)
    out = articles.join(per, ident, "left")
    return out.withColumns({k: F.coalesce(k, F.array().cast("array<string>")) for k in kinds})
