"""Obfuscation, deterministic substitution and encryption of fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def obfuscate(value: Column, rule: str, mark: str = "#") -> Column:
    """Replaces part of a value by marks; null stays null.

    Rules: ``none``; ``all``; ``a,b`` the characters from position a up to b
    (from 0, b left out) and ``a,len`` from a to the end; ``prefix`` all through
    the last blank; ``suffix`` all from the last blank on. Bounds beyond the
    value are cut to it, and a value without a blank is left as it is by
    ``prefix`` and replaced wholly by ``suffix``.
    """
    n = F.length(value)
    last_blank = n - F.coalesce(F.nullif(F.instr(F.reverse(value), " "), F.lit(0)), n + 1) + 1  # 0 if there is none
    if rule == "none":
        return value
    if rule == "all":
        start, end = F.lit(0), n
    elif rule == "prefix":
        start, end = F.lit(0), last_blank
    elif rule == "suffix":
        start, end = F.greatest(last_blank - 1, F.lit(0)), n
    else:
        a, b = rule.split(",")
        start = F.least(F.lit(max(int(a), 0)), n)
        end = n if b.strip() == "len" else F.least(F.lit(max(int(b), 0)), n)
    end = F.greatest(start, end)
    return F.concat(F.substring(value, F.lit(1), start), F.repeat(F.lit(mark), end - start), F.substring(value, end + 1, n))


def pick(value: Column, choices: Sequence[str], salt: str = "") -> Column:
    """One of the choices by a hash of salt and value: equal values get equal choices. Null stays null."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt + "|"), value).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.when(value.isNotNull(), F.element_at(F.array(*[F.lit(c) for c in choices]), (h % len(choices) + 1).cast("int")))


def digits(value: Column, shape: str, salt: str = "") -> Column:
    """Text like shape with every 9 replaced by a digit that depends on salt and value (a card number, a phone number)."""
    parts = []
    for k, c in enumerate(shape):
        h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|{k}|"), value).cast("binary")), 1, 8), 16, 10).cast("bigint")
        parts.append((h % 10).cast("string") if c == "9" else F.lit(c))
    return F.when(value.isNotNull(), F.concat(*parts))


#: The policy for records of name, surname, address, city, postcode, phone and card.
OBFUSCATE_ALL = {"first_name": "none", "surname": "all", "address": "0,1", "city": "none", "postcode": "prefix", "phone": "prefix", "card": "prefix"}


def apply_policy(df: DataFrame, policy: Mapping[str, str]) -> DataFrame:
    """df with every column of the policy obfuscated by its rule; other columns unchanged."""
    return df.withColumns({c: obfuscate(F.col(c), rule) for c, rule in policy.items()})


def mix_policy(df: DataFrame, names: Sequence[str], streets: Sequence[str], postcodes: Sequence[str], salt: str = "") -> DataFrame:
    """Substituted names, streets, postcodes and cards; obfuscated surnames, cities and phones."""
    return df.withColumns(
        {
            "first_name": pick(F.col("first_name"), names, salt),
            "surname": obfuscate(F.col("surname"), "all"),
            "address": pick(F.col("address"), streets, salt),
            "city": obfuscate(F.col("city"), "all"),
            "postcode": pick(F.col("postcode"), postcodes, salt),
            "phone": obfuscate(F.col("phone"), "prefix"),
            "card": digits(F.col("card"), "9999 9999 9999 9999", salt),
        }
    )


def encrypt(value: Column, key: Column) -> Column:
    """AES-CBC with a random start block before the cipher text; key is 16, 24 or 32 bytes and comes from the caller."""
    return F.aes_encrypt(value, key, F.lit("CBC"), F.lit("PKCS"))


def decrypt(value: Column, key: Column) -> Column:
    return F.aes_decrypt(value, key, F.lit("CBC"), F.lit("PKCS")).cast("string")
