"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, scored through memory maps.

Words are runs of printing bytes with A-Z folded; a text of n words has
``order - 1`` begin marks before it and one end mark after it. An n-gram is
known by a 64-bit hash of its words' hashes.

Counting goes from the highest order down. Tasks count the n-grams of their
texts and send them, combined, to the shard of their hash. A shard sums up its
n-grams and writes them; for every n-gram it then sends one message to the
n-gram without its first word (one more distinct continuation) and one to the
n-gram without its last (its count, for the context's total and the numbers of
words seen once, twice, more often). An n-gram that starts with a begin mark
keeps the count of its occurrences at every order. These go, again combined, to the shards of
the next lower order, and so on down to single words. Every order is spread by
hash, so frequent words load no task more than others. What is shuffled, and
the model, grow with the corpus' distinct n-grams.

A shard is a file of sorted 64-bit hashes and the numbers that belong to them.
Workers map it into memory and look up a batch's n-grams in sorted order; a
worker keeps ``HELD`` files open at most, however many shards there are.

To score the very texts that the model is made of, ``score_own`` never stores it
whole, and counts them once. All n-grams that score a word end with that word
and the one before it, so the words before split the work into parts, which
follow each other. Within a part, each word goes with the four before it to the
shard of the two words before it. The shard finds the numbers of all levels
above 2; words whose context occurs once need none. It answers every record
that it got with one that has these numbers in the same order, so that they are
looked up by place, not by key. Of levels 2 and 1 tables are left. When all
parts are counted the discounts are known, and the texts are read once more to
work out their log probabilities. Words that are frequent in a sample are sent
as 3 bytes, others as their hashes. A shard holds the records of its words in
memory; where a record would be much larger than others (a repeated run, a very
frequent pair) it has each n-gram once, with its count.
"""

from __future__ import annotations

import json
import os
import shutil
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from glob import glob

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._arrays import U, lengths_of, mix, owners, slices, text_buffers, word_hashes
from gristmill.llm._frames import parallelism, quoted
from gristmill.storage import mounted, new_folder, write_once

#: Words of the longest n-grams, those of a usual production model.
ORDER = 5
#: Bigrams that a counting task combines before it sends them on; of longer n-grams fewer, so that it holds as many words.
COMBINE = 3_000_000
#: Words of a text that are handled at a time.
BLOCK = 300_000
#: Bytes of text whose n-grams make up one shard, about; a task adds up one shard at a time.
SHARD_BYTES = 16 << 20
#: Shards that a worker has mapped at a time; each takes an open file, of which a process commonly has 1024.
HELD = 512
#: Parts that score_own handles one after the other, and the bytes of text from which on one more is worth another reading of them.
PARTS = 6
PART_BYTES = 16 << 20
#: Bytes of text that score_own keeps in a row, and words of a row that are sent at a time.
ROW_BYTES = 8 << 20
PIECE = 2_000_000
#: Words that are sent as a number instead of their hash, at most, and rows that they are counted in, about.
FREQUENT, SAMPLE = 1 << 19, 8
_RARE = 0xFFFFFF
BEGIN = U(0xB5297A4D3F84D5A7)
END = U(0x68E31DA41B56C4E9)
_STEP = U(0xD6E8FEB86659FD93)
_FIELDS = ("count", "total", "once", "twice", "more")
_codec = pa.Codec("zstd", 1)


def sequences(words: np.ndarray, offsets: np.ndarray, order: int, begin: int = BEGIN, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Every text's words with its begin and end marks, and offsets."""
    counts = lengths_of(offsets)
    out_offsets = np.concatenate(([0], np.cumsum(counts + order)))
    out = np.full(out_offsets[-1], begin, words.dtype)
    out[np.arange(len(words)) + np.repeat(out_offsets[:-1] + order - 1 - offsets[:-1], counts)] = words
    out[out_offsets[1:] - 1] = end
    return out, out_offsets


def _ends(offsets: np.ndarray, order: int) -> np.ndarray:
    """Places in sequences of all but the begin marks."""
    end = np.ones(offsets[-1], bool)
    for k in range(order - 1):
        end[offsets[:-1] + k] = False
    return np.flatnonzero(end)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        column = batch.column(0)
        for a, b in slices(column):
            yield word_hashes(*text_buffers(column[a:b]))


def _keeper(row_bytes: int):
    """One row for some texts: a number of its own, their words' hashes, compressed, and their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column(0)
            for a, b in slices(column, row_bytes):
                words, offsets = word_hashes(*text_buffers(column[a:b]))
                distinct, place, count = np.unique(words, return_inverse=True, return_counts=True)
                often = np.argsort(-count)
                rank = np.empty(len(often), "<u4")
                rank[often] = np.arange(len(often))
                planes = np.ascontiguousarray(rank[place].view(np.uint8).reshape(-1, 4).T)  # frequent words have small numbers: most upper bytes are 0
                raw = np.array([b - a, len(distinct)], "<i8").tobytes() + offsets.astype("<i8").tobytes() + distinct[often].tobytes() + planes.tobytes()
                ids = b"".join(batch.column(1)[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_closed(raw)], pa.binary()), pa.array([ids], pa.binary())], names=["number", "words", "ids"])
                number += 1 << 16  # the places between are for the row's pieces

    return run


_KEPT = "number bigint, words binary, ids binary"


def _closed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def _opened(blob: pa.Buffer) -> pa.Buffer:
    return _codec.decompress(blob.slice(8), int.from_bytes(blob.slice(0, 8).to_pybytes(), "little"))


def _kept(blob: pa.Scalar, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and marks that occur in a row, its sequences as places in them, and each text's offsets."""
    raw = _opened(blob.as_buffer())
    texts, distinct = np.frombuffer(raw, "<i8", 2).tolist()
    offsets = np.frombuffer(raw, "<i8", texts + 1, 16)
    at = 24 + 8 * texts
    known = np.concatenate((np.frombuffer(raw, U, distinct, at), np.array([BEGIN, END])))
    planes = np.frombuffer(raw, np.uint8, -1, at + 8 * distinct).reshape(4, -1)
    number = planes[0].astype(np.uint32)
    for k in (1, 2, 3):
        if distinct > 256**k:
            number |= planes[k].astype(np.uint32) << np.uint32(8 * k)
    return known, *sequences(number, offsets, order, distinct, distinct + 1)


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given by their words' hashes, first word first."""
    key = np.zeros(len(columns[0]), U)
    for c in columns:
        key = key * _STEP + c
    return mix(key)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Number of the hash range that a key lies in."""
    return (((key >> U(32)) * U(shards)) >> U(32)).astype(np.int64)


def _add_up(key: np.ndarray, columns: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order with their words, and the sums of their numbers."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(n[order], first) if len(first) else n[:0] for n in numbers]
    return key[first], [c[order[first]] for c in columns], sums


def _packed(columns: list[np.ndarray], numbers: list[np.ndarray]) -> bytes:
    """One compressed record of n-grams, ordered by first word so that it costs few bytes."""
    order = np.argsort(columns[0])
    columns = [c[order] for c in columns]
    columns[0] = np.diff(columns[0], prepend=U(0))
    parts, head = [], [len(order)]
    for n in numbers:
        n = n[order]
        width = next(w for w in (1, 2, 4, 8) if not len(n) or int(n.max()) < 2 ** (8 * w))
        parts.append(n.astype(f"<u{width}").tobytes())
        head.append(width)
    return _closed(np.array(head, "<i8").tobytes() + b"".join(c.tobytes() for c in columns) + b"".join(parts))


def _unpacked(blob: bytes, words: int, fields: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw = _codec.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n, *widths = np.frombuffer(raw, "<i8", 1 + fields).tolist()
    at = 8 * (1 + fields)
    columns = [np.frombuffer(raw, U, n, at + 8 * n * k) for k in range(words)]
    columns[0] = np.cumsum(columns[0])
    at += 8 * n * words
    numbers = []
    for w in widths:
        numbers.append(np.frombuffer(raw, f"<u{w}", n, at).astype(U))
        at += n * w
    return columns, numbers


def _sent(key: np.ndarray, columns: list[np.ndarray], numbers: list[np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    """One record for every shard; keys are in order."""
    cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    for s in range(shards):
        a, b = cut[s], cut[s + 1]
        if a < b:
            yield s, _packed([c[a:b] for c in columns], [n[a:b] for n in numbers])


_SENT = "shard int, grams binary"


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "grams"])


def _counter(order: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([h[k] for h in held]) for k in range(order)]
            held.clear()
            key, columns, sums = _add_up(gram_key(columns), columns, [np.ones(len(columns[0]), U)])
            return _batch(list(_sent(key, columns, sums, shards)))

        for words, offsets in _words(batches):
            seq, offsets = sequences(words, offsets, order)
            ends = _ends(offsets, order)
            for at in range(0, len(ends), BLOCK):
                last = ends[at : at + BLOCK]
                held.append([seq[last - order + 1 + k] for k in range(order)])
                n += len(last)
                if n * order >= 2 * COMBINE:
                    n = 0
                    yield flush()
        if held:
            yield flush()

    return run


def _write_shard(name: str, key: np.ndarray, numbers: list[np.ndarray]) -> None:
    """One file: how many n-grams, the width of each kind of number, the keys, the numbers, each filled up to 8 bytes."""
    widths = [next(w for w in (1, 2, 4, 8) if int(n.max()) < 2 ** (8 * w)) for n in numbers]
    parts = [np.array([len(key), *widths], "<i8").tobytes(), key.tobytes()]
    for n, w in zip(numbers, widths):
        parts.append(n.astype(f"<u{w}").tobytes() + bytes(-len(n) * w % 8))
    write_once(name, b"".join(parts))


def _map_shard(name: str, fields: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The arrays of a shard's file, mapped; none if nothing was stored."""
    if not os.path.exists(name):
        return {}
    raw = np.memmap(name, np.uint8, "r")
    n, *widths = raw[: 8 * (1 + len(fields))].view("<i8").tolist()
    at, found = 8 * (1 + len(fields)), {}
    for field, w in zip(("key", *fields), (8, *widths)):
        found[field] = raw[at : at + n * w].view(f"<u{w}")
        at += n * w + -n * w % 8
    return found


def _by_shard(batches: Iterator[pa.RecordBatch], words: int, fields: int) -> Iterator[tuple[int, list]]:
    """Every shard's unpacked records; rows are ordered by shard."""
    now, parts = -1, []
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if shard != now and parts:
                yield now, parts
                parts = []
            now = shard
            parts.append(_unpacked(blob.as_py(), words, fields))
    if parts:
        yield now, parts


def _summer(level: int, order: int, shards: int, folder: str | None, least: int):
    """Adds up one shard of a level, writes it (given a folder), and yields its count-of-counts row and the records for the level below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = 1 if level == order else len(_FIELDS)
        for shard, parts in _by_shard(batches, level, fields):
            yield added(shard, parts, fields)

    def added(shard: int, parts: list, fields: int) -> pa.RecordBatch:
        columns = [np.concatenate([p[0][k] for p in parts]) for k in range(level)]
        numbers = [np.concatenate([p[1][k] for p in parts]) for k in range(fields)]
        parts.clear()
        key, columns, numbers = _add_up(gram_key(columns), columns, numbers)
        count = numbers[0]
        name = f"{folder}/{level}/{shard:06d}"
        stored = count >= least if level == order else np.ones(len(key), bool)
        if folder and stored.any():
            _write_shard(name, key[stored], [n[stored] for n in numbers])
        rows = [_tally(level, count)]
        if level > 1:
            real = count > 0
            rows += _below([x[real] for x in columns], count[real], shards)
        return _batch(rows)

    return run


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of every row's group of equal keys, and one row of each group."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _merger(shards: int):
    """Adds up records of single words and sends them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_shard(batches, 1, len(_FIELDS)):
            column = np.concatenate([p[0][0] for p in parts])
            numbers = [np.concatenate([p[1][k] for p in parts]) for k in range(len(_FIELDS))]
            yield _batch(list(_sent(*_add_up(gram_key([column]), [column], numbers), shards)))

    return run


def _tally(level: int, count: np.ndarray, alone: int = 0) -> tuple[int, bytes]:
    """Count-of-counts row; alone: n-grams seen once that aren't in count."""
    of = [int((count == k).sum()) + alone * (k == 1) for k in (1, 2, 3, 4)] + [int((count > 0).sum()) + alone, int(count.sum()) + alone]
    return -level, np.array(of, "<i8").tobytes()


def _below(columns: list[np.ndarray], count: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """What n-grams tell those without their first and without their last word."""
    zero, one = np.zeros(len(count), U), np.ones(len(count), U)
    # only begin marks come before an n-gram that starts with one, so its count is that of its occurrences
    suffix = [np.where(columns[1] == BEGIN, count, one), zero, zero, zero, zero]
    context = [zero, count, (count == U(1)).astype(U), (count == U(2)).astype(U), (count > U(2)).astype(U)]
    both = [np.concatenate((a, b)) for a, b in zip(columns[1:], columns[:-1])]
    return _sent(*_add_up(gram_key(both), both, [np.concatenate((a, b)) for a, b in zip(suffix, context)]), shards)


class _Codes:
    """Numbers below 2**24 for the frequent words of a sample; others get _RARE, and their hashes are sent beside it."""

    def __init__(self, name: str):
        self.hashes, self.sorted, self.number = np.fromfile(name, U).reshape(3, -1)

    def of(self, known: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.sorted, known), len(self.sorted) - 1)
        return np.where(self.sorted[place] == known, self.number[place], U(_RARE)).astype("<u4")

    def packed(self, code: np.ndarray, rare: np.ndarray, count: np.ndarray | None) -> bytes:
        """One record of n-grams, a row for each of their words; rare: the hashes of those without a number, row by row."""
        planes = np.ascontiguousarray(code.view(np.uint8).reshape(*code.shape, 4)[:, :, :3].transpose(2, 0, 1))
        counts = b"" if count is None else count.astype("<i8").tobytes()
        head = np.array([code.shape[1], len(counts), *np.count_nonzero(code == _RARE, axis=1)], "<i8")
        return _closed(head.tobytes() + planes.tobytes() + rare.tobytes() + counts)

    def unpacked(self, blobs: list[pa.Buffer], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes and hashes, a row for each word of the n-grams, and counts, of all records; and where each of them begins."""
        planes, rare, counts, cut = [], [[] for _ in range(words)], [], [0]
        for blob in blobs:
            raw = _opened(blob)
            n, counted, *some = np.frombuffer(raw, "<i8", 2 + words).tolist()
            at = 8 * (2 + words)
            planes.append(np.frombuffer(raw, np.uint8, 3 * words * n, at).reshape(3, words, n))
            at += 3 * words * n
            for k in range(words):
                rare[k].append(np.frombuffer(raw, U, some[k], at))
                at += 8 * some[k]
            counts.append(np.frombuffer(raw, "<i8", n, at) if counted else np.ones(n, np.int64))
            cut.append(cut[-1] + n)
        lowest, middle, highest = np.concatenate(planes, axis=2)
        planes.clear()
        code = lowest | middle.astype("<u4") << np.uint32(8) | highest.astype("<u4") << np.uint32(16)
        hashes = self.hashes[np.minimum(code, np.uint32(len(self.hashes) - 1))]
        for k in range(words):
            hashes[k][code[k] == _RARE] = np.concatenate(rare[k])
        return code, hashes, np.concatenate(counts), np.array(cut)


def _code_maker(name: str, order: int, most: int):
    """Writes the table of _Codes for the words of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = [np.array([BEGIN])], [np.ones(1, np.int64)]
        for batch in batches:
            for blob in batch.column(0):
                words, seq, _ = _kept(blob, order)
                known.append(words)
                count.append(np.bincount(seq, minlength=len(words)))
        words = np.concatenate(known)
        group, first = _grouped(words)
        total = np.bincount(group, np.concatenate(count))
        hashes = words[first][np.argsort(-total, kind="stable")[:most]]
        number = np.argsort(hashes)
        write_once(name, np.stack([hashes, hashes[number], number.astype(U)]).tobytes())
        yield _batch([])

    return run


@dataclass(frozen=True)
class _Layout:
    """How score_own spreads the n-grams of its texts: counting and scoring must do alike."""

    path: str
    order: int
    parts: int
    shards: int
    piece: int

    def codes(self) -> _Codes:
        return _Codes(f"{self.path}/codes")

    def pieces(self, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Places in a row's sequences that are scored, some at a time."""
        ends = _ends(offsets, self.order)
        for k, at in enumerate(range(0, len(ends), self.piece)):
            yield k, ends[at : at + self.piece]

    def grams(self, seq: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The words of the n-grams that end at these places, a row for each."""
        return seq[last + np.arange(1 - self.order, 1)[:, None]]

    def spread(self, known: np.ndarray, seq: np.ndarray, ends: np.ndarray, part: int) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """For each shard the places whose n-grams go there, and, if their record has each n-gram once, which places stand for which.

        So has a record that is much larger than others.
        """
        mine = shard_of(known, self.parts) == part
        last = ends[mine[seq[ends - 1]]]
        shard = shard_of(gram_key([known[seq[last - 2]], known[seq[last - 1]]]), self.shards)
        last = last[np.argsort(shard.astype(np.uint16) if self.shards <= 2**16 else shard, kind="stable")]
        cut = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=self.shards))))
        most = 3 * len(ends) // (self.parts * self.shards) + 100
        for s in np.flatnonzero(np.diff(cut)).tolist():
            own = last[cut[s] : cut[s + 1]]
            yield s, own, *(_grouped(gram_key(list(known[self.grams(seq, own)]))) if len(own) > most else (None, None))

    def answers(self, part: int, shard: int) -> str:
        return f"{self.path}/answers-{part}/{shard:06d}"


_NUMBERED = "shard int, number bigint, grams binary"


def _numbered(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["shard", "number", "grams"])


def _part_sender(layout: _Layout, part: int):
    """Sends the n-grams whose last word but one is in the part, a record for each piece and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = layout.codes()
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                known, seq, offsets = _kept(blob, layout.order)
                code = codes.of(known)
                for k, ends in layout.pieces(offsets):
                    rows = []
                    for s, own, back, first in layout.spread(known, seq, ends, part):
                        grams = layout.grams(seq, own if first is None else own[first])
                        sent = code[grams]
                        rows.append((s, number + k, codes.packed(sent, known[grams[sent == _RARE]], None if back is None else np.bincount(back))))
                    yield _numbered(rows)

    return run


def _numbered_by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[pa.Buffer]]]:
    """Every shard's records; rows are ordered by shard."""
    now, numbers, blobs = None, [], []
    for batch in batches:
        for shard, number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if shard != now and blobs:
                yield now, numbers, blobs
                numbers, blobs = [], []
            now = shard
            numbers.append(number)
            blobs.append(blob.as_buffer())
    if blobs:
        yield now, numbers, blobs


def _upper_summer(layout: _Layout, part: int):
    """Adds up the levels above 2 of one shard, which has all n-grams with the same two words before the last.

    Writes the answers to its records; yields count-of-counts rows and the
    records of level 2. A word whose context occurs once, at some level, is
    the only one to follow it there and at all levels above: its numbers are
    those of one n-gram seen once, and aren't written.
    """
    order = layout.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = layout.codes()
        for shard, numbers, blobs in _numbered_by_shard(batches):
            yield added(codes, shard, numbers, blobs)

    def added(codes: _Codes, shard: int, numbers: list[int], blobs: list[pa.Buffer]) -> pa.RecordBatch:
        code, words, count, cut = codes.unpacked(blobs, order)
        blobs.clear()
        live, key, levels = np.arange(words.shape[1]), gram_key([words[-3], words[-2]]), {}
        for level in range(3, order + 1):
            if level > 3:
                key = gram_key([key, words[-level][live]])
            context, _ = _grouped(key)
            again = np.bincount(context, count[live], 1)[context] > 1
            live, key, context = live[again], key[again], context[again]
            levels[level] = again, live, context, *_grouped(gram_key([key, words[-1][live]]))
        # count becomes what each n-gram adds to the one without its first word, at one of the places where it is
        rows, kinds = [], {}
        for level in range(order, 2, -1):
            _, live, context, gram, first = levels[level]
            c = np.bincount(gram, count[live], len(first)).astype(np.int64)
            of = context[first]
            total, once, twice, more = (np.bincount(of, w).astype(np.int64) if len(of) else c for w in (c, c == 1, c == 2, c > 2))
            rest = total - once - 2 * twice - 3 * more  # mostly 0
            kinds[level] = [_narrowed(c)[gram], *(_narrowed(x)[context] for x in (rest, once, twice, more))]
            alone = len(count) - len(live)
            rows.append((-level, 0, _tally(level, c, alone)[1]))
            count[live] = 0
            count[live[first]] = np.where(words[1 - level][live[first]] == BEGIN, c, 1)
        _write_answers(layout.answers(part, shard), numbers, cut, levels, kinds)
        some = np.flatnonzero(count)
        key = gram_key([words[-2][some], words[-1][some]])
        at = np.argsort(key)
        key, some = key[at], some[at]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count, some, target = np.add.reduceat(count[some], new), some[new], shard_of(key[new], layout.shards)
        code, words = code[-2:, some], words[-2:, some]
        bounds = np.searchsorted(target, np.arange(layout.shards + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[s], bounds[s + 1])
            rows.append((s, 0, codes.packed(np.ascontiguousarray(code[:, own]), words[:, own][code[:, own] == _RARE], count[own])))
        return _numbered(rows)

    return run


def _narrowed(numbers: np.ndarray) -> np.ndarray:
    most = int(numbers.max()) if len(numbers) else 0
    return numbers.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if most < 2 ** (8 * w)))


def _write_answers(name: str, numbers: list[int], cut: np.ndarray, levels: dict, kinds: dict) -> None:
    """One file: how many records, their numbers in order, where they begin and end, and they themselves.

    For every level above 2 a record says which of the words that have numbers
    at the level below have some at this one, and has these numbers byte by byte.
    """
    planes = {level: [x.view(np.uint8).reshape(len(x), x.itemsize).T for x in kinds[level]] for level in kinds}
    bounds = [cut, *(np.searchsorted(levels[level][1], cut) for level in sorted(levels))]
    blobs = {}
    for r, number in enumerate(numbers):
        spans = [slice(b[r], b[r + 1]) for b in bounds]
        raw = [np.array([s.stop - s.start for s in spans] + [len(p) for level in sorted(levels) for p in planes[level]], "<i8").tobytes()]
        for below, span, level in zip(spans, spans[1:], sorted(levels)):
            raw.append(np.packbits(levels[level][0][below]).tobytes())
            raw += [p[:, span].tobytes() for p in planes[level]]
        blobs[number] = _closed(b"".join(raw))
    ordered = sorted(blobs)
    at = np.cumsum([8 * (2 + 2 * len(ordered)), *(len(blobs[k]) for k in ordered)])
    write_once(name, np.array([len(ordered), *ordered, *at], "<i8").tobytes() + b"".join(blobs[k] for k in ordered))


def _answer(raw: pa.Buffer, order: int) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """For each level above 2 what a record of _write_answers says."""
    uppers = order - 2
    head = np.frombuffer(raw, "<i8", 1 + 6 * uppers).tolist()
    at, flags, kinds = 8 * len(head), [], []
    for k in range(uppers):
        below, n = head[k : k + 2]
        flags.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-below // 8), at), count=below).view(bool))
        at += -(-below // 8)
        fields = []
        for w in head[1 + uppers + 5 * k : 6 + uppers + 5 * k]:
            planes = np.frombuffer(raw, np.uint8, w * n, at).reshape(w, n)
            fields.append(sum(p.astype(float) * 256.0**j for j, p in enumerate(planes)))
            at += w * n
        kinds.append(fields)
    return flags, kinds


def _pair_summer(layout: _Layout, part: int):
    """Adds up one shard of level 2, writes its counts above 1, and yields its count-of-counts row and the records of level 1; passes on the rows of the levels above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = layout.codes()
        for shard, _, blobs in _numbered_by_shard(batches):
            if shard < 0:
                yield _batch([(shard, b.to_pybytes()) for b in blobs])
                continue
            _, words, count, _ = codes.unpacked(blobs, 2)
            key, columns, (count,) = _add_up(gram_key(list(words)), list(words), [count.astype(U)])
            if (stored := count > 1).any():  # every pair that is asked for was counted, so one that isn't found occurs once
                _write_shard(f"{layout.path}/pairs-{part}/{shard:06d}", key[stored], [count[stored]])
            yield _batch([_tally(2, count), *_below(columns, count, layout.shards)])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+ from the counts of counts; (0.5, 1, 1.5) where these are too few to tell."""
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 <= x <= k for x, k in zip(d, (1, 2, 3))):
            return d
    return 0.5, 1.0, 1.5


def _tallies(records: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the count-of-counts rows (48 bytes a shard) by level."""
    out: dict[int, np.ndarray] = {}
    for r in records.where("shard < 0").collect():
        out[-r["shard"]] = out.get(-r["shard"], 0) + np.frombuffer(r["grams"], "<i8")
    return out


def _level(tally: np.ndarray) -> dict:
    n1, n2, n3, n4, grams, total = (int(x) for x in tally)
    return {"discounts": discounts(n1, n2, n3, n4), "counts": [n1, n2, grams - n1 - n2], "grams": grams, "total": total}


def _spread(records: DataFrame, tasks: int, which: str = "shard >= 0") -> DataFrame:
    return records.where(which).repartitionById(tasks, F.expr(f"cast(pmod(shard, {tasks}) as int)")).sortWithinPartitions("shard")


def _write(df: DataFrame, path: str | None = None) -> None:
    """Run df, to Parquet if a path is given, and remove its shuffle files at once: they would stay until the driver collects garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.parquet(path) if path else df.write.format("noop").mode("overwrite").save()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def train(docs: DataFrame, order: int = ORDER, least: int = 1, text: str = "text", folder: str | None = None) -> str:
    """Count all texts and write the model; returns its folder (below the shared folder if None is given).

    least: n-grams of the highest order seen less often are counted in every
    statistic but not stored; their mass goes to the lower order, so that
    probabilities still sum to 1. Null texts aren't counted, empty ones are
    (one end mark). Repeated rows count each time.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "language-model")
    path = mounted(folder)
    texts = docs.select(F.col(quoted(text)).alias("text")).where("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = parallelism(docs) * max(1, order - 1)  # long n-grams are more and larger: as much for a task as with bigrams
    shards = max(tasks, -(-size // SHARD_BYTES))
    records = texts.mapInArrow(_counter(order, shards), _SENT)
    levels = {}
    for level in range(order, 0, -1):
        _write(_spread(records, tasks).mapInArrow(_summer(level, order, shards, path, least), _SENT), f"{folder}/sent-{level}")
        records = spark.read.schema(_SENT).parquet(f"{folder}/sent-{level}")
        shutil.rmtree(f"{path}/sent-{level + 1}", ignore_errors=True)  # read to the end
        levels[level] = _level(_tallies(records).get(level, np.zeros(6, np.int64)))
    write_once(f"{path}/model.json", json.dumps({"order": order, "shards": shards, "least": least, "levels": levels}).encode())
    return folder


@dataclass
class Model:
    """Reader of a model folder; files are mapped when needed, those not used for longest are closed."""

    folder: str

    def __post_init__(self):
        self.path = mounted(self.folder)
        with open(f"{self.path}/model.json") as f:
            meta = json.load(f)
        self.order, self.shards, self.least = meta["order"], meta["shards"], meta["least"]
        self.levels = {int(k): v for k, v in meta["levels"].items()}
        self._maps: OrderedDict[tuple[int | str, int], dict[str, np.ndarray]] = OrderedDict()

    def _name(self, level: int | str, shard: int) -> str:
        return f"{self.path}/{level}/{shard:06d}"

    def _fields(self, level: int | str) -> tuple[str, ...]:
        return _FIELDS if level in range(1, self.order) else _FIELDS[:1]

    def _shard(self, level: int | str, shard: int) -> dict[str, np.ndarray]:
        at = (level, shard)
        if at in self._maps:
            self._maps.move_to_end(at)
        else:
            if len(self._maps) >= HELD:
                self._maps.popitem(last=False)
            self._maps[at] = _map_shard(self._name(level, shard), self._fields(level))
        return self._maps[at]

    def look_up(self, level: int | str, key: np.ndarray) -> list[np.ndarray]:
        """Numbers of n-grams (count, and below the highest order the context's numbers); 0 for unknown ones."""
        order = np.argsort(key)
        asked = key[order]
        new = np.concatenate(([True], asked[1:] != asked[:-1])) if len(asked) else np.zeros(0, bool)
        distinct = asked[new]
        fields = self._fields(level)
        found = [np.zeros(len(distinct)) for _ in fields]
        cut = np.searchsorted(shard_of(distinct, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = cut[s], cut[s + 1]
            held = self._shard(level, s) if a < b else {}
            if held:
                place = np.minimum(np.searchsorted(held["key"], distinct[a:b]), len(held["key"]) - 1)
                hit = np.flatnonzero(held["key"][place] == distinct[a:b])
                for out, field in zip(found, fields):
                    out[a + hit] = held[field][place[hit]]
        back = np.empty(len(key), np.int64)
        back[order] = np.cumsum(new) - 1
        return [f[back] for f in found]

    def log_probabilities(self, seq: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the words at positions last of seq, given the words before them."""
        base = self.levels[1]
        p = np.full(len(last), 1 / (base["grams"] + 1))
        total, n1, n2, n3 = float(base["total"]), *map(float, base["counts"])
        context = [np.full(len(last), x) for x in (total, n1, n2, n3)]
        for level in range(1, self.order + 1):
            c = self.look_up(level, gram_key([seq[last - level + 1 + k] for k in range(level)]))[0]
            d1, d2, d3 = self.levels[level]["discounts"]
            total, n1, n2, n3 = context
            lost = (1.0 if level == self.order and self.least > 1 else d1) * n1
            lost = lost + ((2.0 if level == self.order and self.least > 2 else d2) * n2) + d3 * n3
            some = np.maximum(total, 1)
            discounted = np.maximum(c - np.where(c > 2, d3, np.where(c > 1, d2, d1)), 0) * (c > 0)
            p = np.where(total > 0, discounted / some + lost / some * p, p)
            if level < self.order:
                context = self.look_up(level, gram_key([seq[last - level + k] for k in range(level)]))[1:]
        return np.log(p)


def score(docs: DataFrame, folder: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row under the model in folder.

    n_tokens counts the words and the end mark, log_prob is the natural log of
    their probability. A null text has 0 tokens, null log_prob and null
    perplexity. Repeated rows and null ids are scored like any others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder)
        for batch in batches:
            column = batch.column(1)
            n, logs = [np.zeros(0, np.int64)], [np.zeros(0)]
            for a, b in slices(column):
                seq, offsets = sequences(*word_hashes(*text_buffers(column[a:b])), model.order)
                real = np.ones(len(seq), bool)
                for k in range(model.order - 1):
                    real[offsets[:-1] + k] = False
                last = np.flatnonzero(real)
                tokens = lengths_of(offsets) - model.order + 1
                each = [model.log_probabilities(seq, last[at : at + BLOCK]) for at in range(0, len(last), BLOCK)]
                logs.append(np.add.reduceat(np.concatenate(each), np.cumsum(tokens) - tokens))
                n.append(tokens)
            tokens, log = np.concatenate(n), np.concatenate(logs)
            none = column.is_null().to_numpy(zero_copy_only=False)
            tokens[none] = 0
            perplexity = np.exp(-log / np.maximum(tokens, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens), pa.array(log, mask=none), pa.array(perplexity, mask=none)],
                names=["doc_id", "n_tokens", "log_prob", "perplexity"],
            )

    kind = docs.schema[ident].dataType.simpleString()
    narrow = docs.select(F.col(quoted(ident)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, log_prob double, perplexity double")


def score_own(docs: DataFrame, order: int = ORDER, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """What score gives under the model that train makes of the same rows, with the n-grams of a part of it on disk at a time."""
    if order < 3:
        return score(docs, train(docs, order, text=text), text, ident)
    spark = docs.sparkSession
    folder = new_folder(spark, "own-scores")
    path = mounted(folder)
    keyed = F.unhex(F.md5(F.col(quoted(text)).cast("binary")))
    texts = docs.select(F.col(quoted(text)).alias("text"), keyed.alias("id")).where("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(PARTS, max(1, -(-size // PART_BYTES)))
    tasks = parallelism(docs)
    shards = max(tasks, -(-2 * size // (parts * SHARD_BYTES)))
    layout = _Layout(path, order, parts, shards, PIECE)
    read = lambda name, schema: spark.read.schema(schema).parquet(name)

    _write(texts.mapInArrow(_keeper(ROW_BYTES), _KEPT), f"{folder}/kept")
    kept = read(f"{folder}/kept", _KEPT)
    step = max(1, len(glob(f"{path}/kept/*.parquet")) // SAMPLE)
    sample = kept.where(F.col("number").isin([(k * step) << 40 for k in range(SAMPLE)]))
    _write(sample.select("words").repartition(1).mapInArrow(_code_maker(f"{path}/codes", order, FREQUENT), _SENT))

    tallies: dict[int, np.ndarray] = {level: np.zeros(6, np.int64) for level in range(1, order + 1)}

    def tallied(name: str) -> DataFrame:
        for level, row in _tallies(read(name, _SENT)).items():
            tallies[level] = tallies[level] + row
        return read(name, _SENT)

    words = None
    for part in range(parts):
        grams = kept.select("number", "words").mapInArrow(_part_sender(layout, part), _NUMBERED)
        pairs = _spread(grams, tasks).mapInArrow(_upper_summer(layout, part), _NUMBERED)
        _write(_spread(pairs, tasks, "true").mapInArrow(_pair_summer(layout, part), _SENT), f"{folder}/words-{part}")
        more = tallied(f"{folder}/words-{part}")
        if part < parts - 1:  # add up what is known of single words, so that it stays small
            both = more.where("shard >= 0") if words is None else more.where("shard >= 0").union(words)
            _write(_spread(both, tasks).mapInArrow(_merger(shards), _SENT), f"{folder}/merged-{part}")
            words = read(f"{folder}/merged-{part}", _SENT)
            for name in (f"words-{part}", f"merged-{part - 1}"):
                shutil.rmtree(f"{path}/{name}", ignore_errors=True)
    _write(_spread(more if words is None else more.union(words), tasks).mapInArrow(_summer(1, order, shards, path, 1), _SENT), f"{folder}/sent-1")
    tallied(f"{folder}/sent-1")
    levels = {level: _level(row) for level, row in tallies.items()}
    _write(kept.mapInArrow(_own_scorer(layout, levels), _SUMS), f"{folder}/scores")
    for name in os.listdir(path):
        if name == "codes":
            os.remove(f"{path}/{name}")
        elif name != "scores":
            shutil.rmtree(f"{path}/{name}", ignore_errors=True)
    sums = read(f"{folder}/scores", _SUMS).dropDuplicates(["id"])
    rows = docs.select(F.col(quoted(ident)).alias("doc_id"), keyed.alias("id"))
    out = rows.join(sums, "id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_tokens"), F.col("log").alias("log_prob"), F.exp(-F.col("log") / F.col("n")).alias("perplexity"))


_SUMS = "id binary, n bigint, log double"


class _Own(Model):
    """Reader of what score_own has counted."""

    def __init__(self, layout: _Layout, levels: dict[int, dict]):
        self.layout, self.levels = layout, levels
        self.path, self.order, self.shards, self.least = layout.path, layout.order, layout.shards, 1
        self._maps = OrderedDict()

    def _name(self, level: int | str, shard: int) -> str:
        return f"{self.path}/{level}/{shard:06d}"

    def _fields(self, level: int | str) -> tuple[str, ...]:
        return _FIELDS if level == 1 else _FIELDS[:1]

    def answer(self, part: int, shard: int, number: int) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        at = (f"answers-{part}", shard)
        if at in self._maps:
            self._maps.move_to_end(at)
        else:
            if len(self._maps) >= HELD:
                self._maps.popitem(last=False)
            self._maps[at] = {"raw": np.memmap(self.layout.answers(part, shard), np.uint8, "r")}
        raw = self._maps[at]["raw"]
        n = int(raw[:8].view("<i8")[0])
        numbers, begin = raw[8 : 8 + 8 * n].view("<i8"), raw[8 + 8 * n : 16 + 16 * n].view("<i8")
        k = int(np.searchsorted(numbers, number))
        return _answer(_opened(pa.py_buffer(raw[begin[k] : begin[k + 1]])), self.order)

    def _kept_share(self, level: int, c: np.ndarray) -> np.ndarray:
        """Counts without the discounts."""
        d = np.array([0, *self.levels[level]["discounts"]])
        return np.maximum(c - d[np.minimum(c, 3).astype(np.int8)], 0)

    def _lost(self, level: int, once: np.ndarray, twice: np.ndarray, more: np.ndarray) -> np.ndarray:
        d1, d2, d3 = self.levels[level]["discounts"]
        return d1 * once + d2 * twice + d3 * more

    def singles(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each word alone; total and lost mass of what follows it."""
        count, total, once, twice, more = self.look_up(1, gram_key([known]))
        base = self.levels[1]
        lost = float(self._lost(1, *map(float, base["counts"])))
        p = (self._kept_share(1, count) + lost / (base["grams"] + 1)) / max(base["total"], 1)
        return p, np.maximum(total, 1), self._lost(2, once, twice, more)

    def logs(self, known: np.ndarray, seq: np.ndarray, ends: np.ndarray, part: int, number: int, singles: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Places of a piece whose word before is in the part, and the logs of their words' probabilities."""
        places, last, back, flags, kinds, n = [], [], [], [], [], 0
        for s, own, group, first in self.layout.spread(known, seq, ends, part):
            places.append(own)
            last.append(own if first is None else own[first])
            back.append(n + (np.arange(len(own)) if first is None else group))
            n += len(last[-1])
            f, k = self.answer(part, s, number)
            flags.append(f)
            kinds.append(k)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0)
        last = np.concatenate(last)
        before, word = seq[last - 1], seq[last]
        p, total, lost = singles
        (c,) = self.look_up(f"pairs-{part}", gram_key([known[before], known[word]]))
        p = (self._kept_share(2, np.maximum(c, 1)) + lost[before] * p[word]) / total[before]
        some = np.arange(n)
        for level in range(3, self.order + 1):
            again = np.concatenate([f[level - 3] for f in flags])
            c, rest, once, twice, more = (np.concatenate([k[level - 3][j] for k in kinds]) for j in range(5))
            some = some[again]
            total = rest + once + 2 * twice + 3 * more
            of = (self._kept_share(level, c) + self._lost(level, once, twice, more) * p[some]) / total
            one = self.levels[level]["discounts"][0]
            p *= one
            p += max(1 - one, 0)
            p[some] = of
        return np.concatenate(places), np.log(p)[np.concatenate(back)]


def _own_scorer(layout: _Layout, levels: dict[int, dict]):
    """A text's words and end mark, and the sum of their log probabilities; a text is known by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Own(layout, levels)
        for batch in batches:
            for number, blob, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                known, seq, offsets = _kept(blob, layout.order)
                singles = model.singles(known)
                text = owners(offsets).astype(np.int32)
                log = np.zeros(len(offsets) - 1)
                for k, ends in layout.pieces(offsets):
                    for part in range(layout.parts):
                        places, values = model.logs(known, seq, ends, part, number + k, singles)
                        log += np.bincount(text[places], values, len(log))
                ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(log), [None, ids.as_buffer()]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(lengths_of(offsets) - layout.order + 1), pa.array(log)], names=["id", "n", "log"])

    return run
