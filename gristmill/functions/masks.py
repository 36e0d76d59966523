"""Character masks of field values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def low_grain(value: Column) -> Column:
    """Runs of a-z, A-Z, 0-9 and tabs become a, A, 9 and T (``ABC-12`` is ``A-9``)."""
    for pattern, mark in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "9"), ("\t+", "T")):
        value = F.regexp_replace(value, pattern, mark)
    return value


def high_grain(value: Column) -> Column:
    """Like low_grain for every single character (``ABC-12`` is ``AAA-99``)."""
    for pattern, mark in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "9"), ("\t", "T")):
        value = F.regexp_replace(value, pattern, mark)
    return value


def pop_check(value: Column) -> Column:
    """0 for null or blank values, 1 for others."""
    return F.when(F.length(F.trim(F.coalesce(value, F.lit("")))) == 0, "0").otherwise("1")


def characters(value: Column) -> Column:
    """Array of the value's characters; empty for null and empty values."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), ""), lambda c: c != "")


def character_class(c: Column) -> Column:
    """J ideographic, ^ control, T white space, 9 digit, A or a letter, U anything else."""
    return (
        F.when(c.rlike(r"\p{IsIdeographic}"), "J")
        .when(c.rlike(r"\p{Cc}"), "^")
        .when(c.rlike(r"\p{IsWhite_Space}"), "T")
        .when(c.rlike(r"\p{Nd}"), "9")
        .when(c.rlike(r"\p{Lu}"), "A")
        .when(c.rlike(r"\p{L}"), "a")
        .otherwise("U")
    )


def class_masks(value: Column) -> Column:
    """Array with one class for every character."""
    return F.transform(characters(value), character_class)


def hex_mask(value: Column) -> Column:
    """Array with the hexadecimal UTF-8 bytes of every character."""
    return F.transform(characters(value), lambda c: F.hex(F.encode(c, "UTF-8")))


def unicode_mask(value: Column) -> Column:
    """Array with U+XXXX of every character of the basic plane, and its surrogates' halves joined beyond it."""
    return F.transform(characters(value), lambda c: F.concat(F.lit("U+"), F.hex(F.encode(c, "UTF-16BE"))))
