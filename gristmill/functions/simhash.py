"""Simhash of word pairs, Hamming distance and bit masks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32


def shingles(text: Column) -> Column:
    """Array of all runs of two blank-separated words; of the text itself if it has one word."""
    w = F.split(text, " ")
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) < 2, F.array(text)).otherwise(pairs)


def shingle_hash(c: Column) -> Column:
    """First 32 bits of the MD5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("bigint")


def simhash(df: DataFrame, ident: str, text: str, weighted: bool = False) -> DataFrame:
    """(id, simhash): 32-bit simhash of every row with a text, as a non-negative bigint.

    A bit is 1 if more shingles have it than don't. Weighted: the i-th of n
    shingles counts n - i, so the text's beginning counts most. Rows are tallied
    where they are read, a batch at a time; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros(len(batch), np.int64)
            for i, t in enumerate(batch.column(1)):
                made[i] = _of_text(t.as_py(), weighted)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["id", "simhash"])

    kind = df.schema[ident].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, simhash bigint")


def _of_text(text: str, weighted: bool) -> int:
    words = text.split(" ")
    n = max(1, len(words) - 1)
    tally = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # shingles of a long text, a part at a time
        end = min(n, at + (1 << 16))
        parts = [text] if len(words) < 2 else [f"{a} {b}" for a, b in zip(words[at:end], words[at + 1 : end + 1])]
        heads = np.frombuffer(b"".join([md5(x.encode(), usedforsecurity=False).digest()[:4] for x in parts]), np.uint8)
        bits = np.unpackbits(heads.reshape(-1, 4), axis=1)
        if weighted:
            weight = n - np.arange(at, end)
            tally += 2 * (weight @ bits.astype(np.int64)) - weight.sum()
        else:
            tally += 2 * bits.sum(0, dtype=np.int64) - len(bits)
    return int("".join("1" if x > 0 else "0" for x in tally), 2)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bit_string(c: Column) -> Column:
    """The 32 bits as text, highest first."""
    return F.lpad(F.bin(c), BITS, "0")


def masks(bits: int = BITS) -> list[int]:
    """All masks of at most two bits: 1 + 32 + 496 of them."""
    return [0, *(1 << i for i in range(bits)), *((1 << i) | (1 << j) for i in range(bits) for j in range(i))]


def near_pairs(hashes: DataFrame, distance: int = 4, ident: str = "id", simhash: str = "simhash", agree: int | None = None, stars: bool = False) -> DataFrame:
    """(a, b, distance): pairs of different ids, a < b, whose hashes differ in at most so many bits.

    By the pigeonhole principle two such hashes agree in at least `agree` of
    distance + agree blocks of bits, so each hash is sent to a bucket for every
    choice of so many blocks (with agree 3, 35 buckets of about 14 bits; the 529
    masks of at most two bits do the same with 15 times the rows). A larger
    agree makes more rows and smaller buckets: by default it is the least of 3
    to 8 at which a bucket has some 64 of the distinct hashes. With stars, rows
    of equal hashes are paired with the one of least id only, which is enough
    for components. No side is broadcast: the buckets' rows come of files a
    hundred times smaller, whose size says nothing of theirs.
    """
    if stars:
        hashes = hashes.select(F.col(ident).alias("id"), F.col(simhash).alias("h"))
        heads = hashes.groupBy("h").agg(F.min("id").alias("id"))
        spokes = hashes.join(heads.select("h", F.col("id").alias("a")).hint("merge"), "h").where("id <> a").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
        return near_pairs(heads, distance, "id", "h", agree).unionAll(spokes)
    distinct = hashes.select(F.col(simhash).alias("h")).distinct()
    if agree is None:
        bits = max(0, ceil(log2(max(1, distinct.count()) / 64)))
        agree = next((a for a in range(3, 8) if BITS * a // (distance + a) >= bits), 8)
    n = distance + agree
    cuts = [round(k * BITS / n) for k in range(n + 1)]
    keep = [((1 << hi) - (1 << lo)) for lo, hi in zip(cuts, cuts[1:])]
    choices = [sum(c) for c in combinations(keep, agree)]
    blocks = F.array(*[F.struct(F.lit(k).alias("k"), F.col("h").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(choices)])
    spread = distinct.select("h", F.explode(blocks).alias("block"))
    x, y = spread.alias("x"), spread.alias("y")
    far = x.join(y.hint("merge"), (F.col("x.block") == F.col("y.block")) & (F.col("x.h") < F.col("y.h"))).select(F.col("x.h").alias("g"), F.col("y.h").alias("h"))
    far = far.where(hamming(F.col("g"), F.col("h")) <= distance).distinct().unionAll(distinct.select(F.col("h").alias("g"), "h"))
    left = hashes.select(F.col(ident).alias("p"), F.col(simhash).alias("g"))
    right = hashes.select(F.col(ident).alias("q"), F.col(simhash).alias("h"))
    met = far.join(left.hint("merge"), "g").join(right.hint("merge"), "h").where((F.col("g") != F.col("h")) | (F.col("p") < F.col("q")))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), hamming(F.col("g"), F.col("h")).alias("distance")).where("a <> b")


def near_hash(hashes: DataFrame, wanted: int, distance: int = 4, ident: str = "id", simhash: str = "simhash") -> DataFrame:
    """(id, distance): rows whose hash differs from a given one in at most so many bits; one scan."""
    d = hamming(F.col(simhash), F.lit(wanted).cast("bigint"))
    return hashes.select(F.col(ident).alias("id"), d.alias("distance")).where(F.col("distance") <= distance)
