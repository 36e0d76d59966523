"""Exact duplicates by composable polynomial fingerprints and chunkwise comparison.

A text's fingerprint is the polynomial of its bytes modulo two primes. Chunks
of 4 KB are hashed side by side; the fingerprint of a concatenation follows
from those of its parts, ``f(AB) = f(A) * B**len(B) + f(B)``, so a text of any
length needs no more memory than a few chunks. Texts of equal fingerprint and
length are then compared byte by byte, chunk by chunk, so the result is exact.

Shuffles: the fingerprints (16 bytes a row, combined before the shuffle), and
the rows whose fingerprint occurs more than once. All other rows stay where
they were read: a table of bits (bounded in size) tells every task
which fingerprints may be repeated, and only rows that pass it are sent. A
fingerprint with many rows is compared in portions first, at most about the
square root of its rows in each, and between the portions' distinct texts
afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._arrays import slices, text_buffers
from gristmill.llm._bits import bit_table, passing
from gristmill.llm._frames import fresh, quoted
from gristmill.storage import written

CHUNK = 4096
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)
#: Rows of one fingerprint that one task compares at first; the square root of all its rows if that is more.
PORTION = 2000


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo prime, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return out


_WITHIN = [_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES)]


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
    """Fingerprint of the concatenation of two byte strings, from their fingerprints."""
    return tuple((x * pow(b, right_length, p) + y) % p for x, y, b, p in zip(left, right, BASES, PRIMES))


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each prime, the fingerprint of every text (0 for an empty one)."""
    sizes = offsets[1:] - offsets[:-1]
    counts = -(-sizes // CHUNK)
    first = np.concatenate(([0], np.cumsum(counts)))
    total = int(first[-1])
    text = np.repeat(np.arange(len(sizes)), counts)
    starts = offsets[:-1][text] + (np.arange(total) - first[:-1][text]) * CHUNK
    ends = np.minimum(starts + CHUNK, offsets[1:][text])
    out = []
    parts = [np.zeros(total, np.uint64) for _ in PRIMES]
    for a in range(0, total, 256):
        s, e = starts[a : a + 256], ends[a : a + 256]
        chunk = data[s[0] : e[-1]].astype(np.uint64) + np.uint64(1)
        left = np.repeat(e - s[0], e - s) - 1 - np.arange(len(chunk))
        for part, within, p in zip(parts, _WITHIN, PRIMES):
            part[a : a + 256] = np.add.reduceat(within[left] * chunk, s - s[0]) % np.uint64(p)
    full = text.copy() if total else np.zeros(0, np.int64)
    after = first[1:][full] - 2 - np.arange(total)  # whole chunks between this one and the last
    last = after < 0
    tail = (ends - starts)[last]
    for part, b, p in zip(parts, BASES, PRIMES):
        prime = np.uint64(p)
        jump = _powers(pow(b, CHUNK, p), p, int(after.max(initial=0)) + 1)
        head = np.zeros(len(sizes), np.uint64)
        np.add.at(head, full[~last], part[~last] * jump[after[~last]] % prime)
        value = np.zeros(len(sizes), np.uint64)
        within = _powers(b, p, CHUNK + 1)[tail]
        value[full[last]] = (head[full[last]] % prime * within + part[last]) % prime
        out.append(value)
    return out


def _fingerprint_columns(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    marks, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in slices(column):
        data, offsets = text_buffers(column[a:b])
        high, low = fingerprints(data, offsets)
        marks.append(((high << np.uint64(32)) | low).astype(np.int64))
        sizes.append(offsets[1:] - offsets[:-1])
    none = column.is_null().to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate(marks), mask=none), pa.array(np.concatenate(sizes), mask=none)


def _marker(text: str, keep: list[str], names: list[str], bits=None, hits: bool = True):
    """Adds fingerprint and length to rows; with a table of bits only to those that pass it, or to the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            mark, size = _fingerprint_columns(column)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            out = pa.RecordBatch.from_arrays([*kept, mark, size], names=[*keep, *names])
            if bits is not None:
                hit = passing(bits.value, mark.fill_null(0).to_numpy()) & column.is_valid().to_numpy(zero_copy_only=False)
                out = out.filter(pa.array(hit if hits else ~hit))
            yield out

    return run


def _same(a: memoryview, b: memoryview) -> bool:
    """Whether two texts are equal, read 64 KB at a time until the first difference."""
    return len(a) == len(b) and all(a[i : i + 65536] == b[i : i + 65536] for i in range(0, len(a), 65536))


def _comparer(keys: list[str], text: str):
    """Reads rows sorted by keys and yields those that are the first of a distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, []
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            view = memoryview(data)
            first = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keys]
            for i, key in enumerate(zip(*columns)):
                if key != now:
                    now, seen = key, []
                value = view[offsets[i] : offsets[i + 1]]
                first.append(not any(_same(t, value) for t in seen))
                if first[-1]:
                    seen.append(memoryview(bytes(value)))
            yield batch.filter(pa.array(first, pa.bool_()))

    return run


def _linker(keys: list[str], head: str | None):
    """Reads rows (keys, id, text, rows, head) sorted by keys and yields which row each one equals.

    Every distinct text under a key gets a number, the head. With head None a
    row of a split fingerprint that is first keeps its text, for the comparison
    with the other portions' heads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, []
        for batch in batches:
            texts, ids = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("id"))
            data, offsets = text_buffers(texts)
            view = memoryview(data)
            first, of, number = [], [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keys]
            for i, (key, own) in enumerate(zip(zip(*columns), ids.to_pylist())):
                if key != now:
                    now, seen = key, []
                value = view[offsets[i] : offsets[i + 1]]
                match = next((k for k, (_, t) in enumerate(seen) if _same(t, value)), len(seen))
                first.append(match == len(seen))
                if first[-1]:
                    seen.append((own, memoryview(bytes(value))))
                number.append(match)
                of.append(seen[match][0])
            found = {"id": ids, "of": pa.array(of, ids.type), "first": pa.array(first, pa.bool_())}
            if head is None:
                split = pc.and_(found["first"], batch.column(batch.schema.get_field_index("split")))
                found |= {"head": pa.array(number, pa.int64()), "text": pc.if_else(split, texts, pa.scalar(None, texts.type))}
            else:
                found["head"] = batch.column(batch.schema.get_field_index(head))
            kept = {c: batch.column(batch.schema.get_field_index(c)) for c in ("mark", "size", "portion", "split")}
            yield pa.RecordBatch.from_pydict(found | kept)

    return run


def _marked(docs: DataFrame, text: str, ident: str, keep: list[str]):
    """Rows that have a fingerprint, a length and no other row with both; those with others, by portion; the added columns' names."""
    mark, size, portion, rows = fresh(docs, "mark", "size", "portion", "rows")
    t = docs.schema[text]
    narrow = docs.select(F.col(quoted(text)).alias("text")).mapInArrow(_marker("text", [], [mark, size]), f"{mark} bigint, {size} bigint")
    twice = written(
        narrow.where(F.col(mark).isNotNull()).groupBy(mark, size).agg(F.count("*").alias(rows)).where(F.col(rows) > 1), "fingerprints"
    )
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(twice.select(mark), twice.count()))
    schema = ", ".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in keep) + f", {mark} bigint, {size} bigint"
    chosen = docs.select(*map(quoted, keep))
    passed = chosen.mapInArrow(_marker(t.name, keep, [mark, size], bits), schema).join(twice, [mark, size], "left")
    others = chosen.mapInArrow(_marker(t.name, keep, [mark, size], bits, False), schema)
    alone = others.select(*map(quoted, keep)).unionAll(passed.where(F.col(rows).isNull()).select(*map(quoted, keep)))
    portions = F.ceil(F.col(rows) / F.greatest(F.lit(PORTION), F.ceil(F.sqrt(rows))))
    cand = passed.where(F.col(rows).isNotNull()).withColumn(portion, F.pmod(F.xxhash64(quoted(ident)), portions))
    return alone, cand, mark, size, portion, rows


def _sorted(cand: DataFrame, keys: list[str], ident: str) -> DataFrame:
    return cand.repartition(*keys).sortWithinPartitions(*keys, F.col(quoted(ident)).asc_nulls_last())


def drop_exact_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Rows of docs with one row for every distinct text, all columns unchanged.

    Of equal texts the row with the smallest ident stays (null last; among rows
    of the same ident any one). Rows with null text are all kept; empty texts
    equal each other. Texts are compared whole, so no other row is dropped.
    """
    alone, cand, mark, size, portion, rows = _marked(docs, text, ident, docs.columns)
    name = docs.schema[text].name
    first = _sorted(cand, [mark, size, portion], ident).mapInArrow(_comparer([mark, size, portion], name), cand.schema)
    split = F.col(rows) > PORTION
    final = _sorted(first.where(split), [mark, size], ident).mapInArrow(_comparer([mark, size], name), cand.schema)
    names = [*map(quoted, docs.columns)]
    return alone.unionAll(first.where(~split).select(*names)).unionAll(final.select(*names))


def exact_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, duplicate_of) for every row that drop_exact_duplicates removes.

    duplicate_of is the ident of the row that stays, so of rows with equal
    ident and text all but one are listed with their own ident; null idents
    come last and are listed like others. The same conventions for null, empty
    and repeated rows hold. Rows are told apart by their place among the equal
    ones of a portion, never by ident.
    """
    keep = list(dict.fromkeys((ident, text)))
    kind = docs.schema[ident].dataType.simpleString()
    _, cand, mark, size, portion, rows = _marked(docs, text, ident, keep)
    named = cand.select(
        F.col(mark).alias("mark"), F.col(size).alias("size"), F.col(portion).cast("bigint").alias("portion"), (F.col(rows) > PORTION).alias("split"),
        F.col(quoted(ident)).alias("id"), F.col(quoted(text)).alias("text"),
    )
    shape = f"id {kind}, of {kind}, first boolean, head bigint"
    place = "mark bigint, size bigint, portion bigint, split boolean"
    near = written(_sorted(named, ["mark", "size", "portion"], "id").mapInArrow(_linker(["mark", "size", "portion"], None), f"{shape}, text string, {place}"), "portions")
    heads = _sorted(near.where("first AND split"), ["mark", "size"], "id")
    top = heads.mapInArrow(_linker(["mark", "size"], "head"), f"{shape}, {place}").select("mark", "size", "portion", "head", F.col("of").alias("final"), F.col("first").alias("stays"))
    whole = near.where("NOT split AND NOT first").select("id", "of")
    parts = near.where("split").drop("text").join(top, ["mark", "size", "portion", "head"]).where("NOT (first AND stays)").select("id", F.col("final").alias("of"))
    return whole.unionAll(parts).select(F.col("id").alias("doc_id"), F.col("of").alias("duplicate_of"))
