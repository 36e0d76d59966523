"""Text cleaning, extraction and word statistics as column expressions. Null gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"
TITLES = ("mr", "mrs", "ms", "miss", "dr", "sir", "lady", "lord")
COMPANY_WORDS = ("inc", "ltd", "llc", "plc", "corp", "corporation", "company", "co", "group", "limited", "the", "of")
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "a", "that", "it", "for", "on", "are", "as", "with", "be", "this", "was", "by", "or", "at", "from", "an")
SMILEYS = {":)": "happy", ":-)": "happy", ":D": "laugh", ";)": "wink", ":(": "sad", ":-(": "sad"}


def strip_accents(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(c, ACCENTED, PLAIN)


def clean_place(c: Column) -> Column:
    """Place name as a key: no accents, lower case, no dots, other signs as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), r"\.", ""), r"[^a-z0-9]+", " "))


def clean_name(c: Column, stop_words: Sequence[str] = TITLES) -> Column:
    """Name as a key: no accents, camel case split, lower case, letters only, without stop words."""
    split = F.regexp_replace(strip_accents(c), "([a-z])([A-Z])", "$1 $2")
    words = F.split(F.trim(F.regexp_replace(F.lower(split), "[^a-z]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*stop_words) & (w != "")), " ")


def initials(c: Column) -> Column:
    """First letters of a name of several words; a single word stays as it is."""
    words = F.split(F.trim(c), r"\s+")
    return F.when(F.size(words) > 1, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")).otherwise(F.trim(c))


def urls(c: Column) -> Column:
    """Array of the blank-separated pieces that start with http."""
    return F.filter(F.split(c, r"\s+"), lambda w: w.startswith("http"))


def hashtags(c: Column, longer_than: int = 5) -> Column:
    """Array of #tags of unaccented letters in lower case, of more than so many characters with the sign."""
    found = F.regexp_extract_all(F.lower(strip_accents(c)), F.lit("(#[a-z]+)"), 1)
    return F.filter(found, lambda t: F.length(t) > longer_than)


def mentions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(@[A-Za-z0-9_]+)"), 1)


def clean_tweet(c: Column) -> Column:
    """Lower-case words of a short message: no links, mentions, retweet marks, tags' signs, emoji codes, accents or punctuation.

    Letters repeated more than twice are cut to two.
    """
    c = F.regexp_replace(c, r"https?://\S+", " ")
    c = F.regexp_replace(c, r"(^|\s)RT(\s|$)", " ")
    c = F.regexp_replace(c, r"@[A-Za-z0-9_]+:?", " ")
    c = F.regexp_replace(c, r":[a-z_]+:", " ")
    c = F.lower(strip_accents(c))
    c = F.regexp_replace(c, r"[^a-z0-9\s]", " ")
    c = F.regexp_replace(c, r"([a-z])\1{2,}", "$1$1")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def emoji_codes(c: Column) -> Column:
    """Array of the names in :short_codes:."""
    return F.regexp_extract_all(c, F.lit(":([a-z_]+):"), 1)


def emoji_tone(codes: Column) -> Column:
    """Mean tone of known emoji names: 1 laughing, 0.7 happy, 0.6 winking, 0.3 sad, 0 angry; null without any."""
    tones = {"laugh": 1.0, "joy": 1.0, "happy": 0.7, "smile": 0.7, "wink": 0.6, "sad": 0.3, "cry": 0.3, "angry": 0.0, "rage": 0.0}
    table = F.create_map(*[F.lit(x) for pair in tones.items() for x in pair])
    known = F.filter(F.transform(codes, lambda k: F.try_element_at(table, k)), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known))


def words(c: Column) -> Column:
    """Array of the white-space separated words."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def stop_word_count(c: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Number of words, without punctuation at their ends, that are stop words."""
    bare = F.transform(words(F.lower(c)), lambda w: F.regexp_replace(w, r"^[^a-z]+|[^a-z]+$", ""))
    return F.size(F.filter(bare, lambda w: w.isin(*stop_words)))


def tokens(c: Column, stop_words: Sequence[str] = STOP_WORDS, longer_than: int = 3) -> Column:
    """Array of lower-case words of unaccented letters only, longer than so many, no stop words."""
    found = F.split(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z]+", " "), " ")
    return F.filter(found, lambda w: (F.length(w) > longer_than) & ~w.isin(*stop_words))


def clean_url(c: Column) -> Column:
    """``#!`` as the crawler's query parameter, no fragment."""
    escaped = F.regexp_replace(c, "#!", F.when(c.contains("?"), "&_escaped_fragment_=").otherwise("?_escaped_fragment_="))
    return F.regexp_replace(escaped, "#.*$", "")


def host(c: Column) -> Column:
    """Host of a valid URL, else null."""
    return F.try_parse_url(c, F.lit("HOST"))


def tag_list(c: Column) -> Column:
    """Array of the names in ``<a><b>``."""
    return F.regexp_extract_all(c, F.lit("<([^<>]+)>"), 1)


def lenient_time(c: Column) -> Column:
    """Timestamp of an ISO-8601 text, with or without time; null where it can't be read."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def day_month_year(c: Column) -> Column:
    """Date of dd/MM/yyyy; null where it can't be read."""
    return F.to_date(F.try_to_timestamp(c, F.lit("dd/MM/yyyy")))


POSITIVE = ("good", "great", "best", "better", "love", "happy", "win", "success", "strong", "excellent", "wonderful", "hope", "safe", "gain", "positive")
NEGATIVE = ("bad", "worst", "worse", "hate", "sad", "lose", "loss", "fail", "failure", "weak", "terrible", "fear", "kill", "war", "crisis", "negative")


def stem(word: Column) -> Column:
    """Lower-case word without plural, -ing and -ed endings; a light stemmer, not a dictionary.

    The rest keeps at least three letters with a vowel among them; a doubled
    consonant before a dropped ending becomes single.
    """
    w = F.regexp_replace(F.lower(word), r"'s?$", "")
    w = F.when(w.rlike(r"^.{2,}ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike(r"(ss|x|ch|sh)es$"), F.regexp_replace(w, "es$", "")).when(w.rlike(r"^.{2,}[^su]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)
    cut = F.regexp_replace(w, r"^(.*[aeiouy].*)(ing|ed)$", "$1")
    cut = F.when(F.length(cut) >= 3, F.regexp_replace(cut, r"([bdfgmnprt])\1$", "$1")).otherwise(w)
    return F.when(w.rlike("(ing|ed)$"), cut).otherwise(w)


def stems(c: Column, stop_words: Sequence[str] = STOP_WORDS, longer_than: int = 3) -> Column:
    """Array of the stems of tokens()."""
    return F.transform(tokens(c, stop_words, longer_than), stem)


def sentiment(c: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """Mean over sentences of a class from 0 (very negative) to 4; 2.0 for null and for texts without words.

    A sentence's class is 2 and its positive less its negative words, within
    the bounds: an approximation by word lists.
    """
    classes = F.transform(
        F.sentences(c),
        lambda s: F.greatest(F.lit(0), F.least(F.lit(4), F.lit(2) + F.size(F.filter(s, lambda w: F.lower(w).isin(*positive))) - F.size(F.filter(s, lambda w: F.lower(w).isin(*negative))))).cast("double"),
    )
    return F.coalesce(F.when(F.size(classes) > 0, F.aggregate(classes, F.lit(0.0), lambda a, b: a + b) / F.size(classes)), F.lit(2.0))
