"""Numpy routines over the text buffers of Arrow batches.

All of them work on whole columns: bytes of all texts in one array, with one
offset per text. Null texts count as empty here; callers that treat null
differently look at the column's validity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240229)
#: Which bytes belong to words: all above the blank, or only letters, digits and bytes of multi-byte characters.
PRINTED = np.arange(256) > 32
ALNUM = (np.arange(256) >= 128) | np.array([chr(i).isalnum() and i < 128 for i in range(256)])
#: Random 64-bit value for every byte, and the same with A-Z folded to a-z.
BYTES = _rng.integers(0, 2**64, 256, dtype=U)
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]
BASE = int(_rng.integers(0, 2**63, dtype=U)) * 2 + 1
UNBASE = pow(BASE, -1, 2**64)
CHUNK = 1 << 20
_POWERS, _BACK = np.full(CHUNK, U(BASE), U), np.full(CHUNK, U(UNBASE), U)
for _p in (_POWERS, _BACK):
    _p[0] = 1
    np.cumprod(_p, out=_p)
STEP = U(int(_rng.integers(0, 2**63, dtype=U)) * 2 + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets into them, starting at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about limit bytes; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, room = 0, limit
    for i, size in enumerate(sizes.tolist()):
        if i > start and size > room:
            yield start, i
            start, room = i, limit
        room -= size
    if start < len(sizes):
        yield start, len(sizes)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLDED, inside: np.ndarray = PRINTED
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (a run of bytes of a text that are inside) and each text's offsets into them.

    Bytes are read CHUNK at a time; the polynomial of a word that goes on in the
    next chunk is continued there, so memory grows with the words only.
    """
    made, before = [np.zeros(0, U)], np.zeros(len(offsets), np.int64)
    begun, length = None, 0  # polynomial and bytes so far of a word that the last chunk cut
    for a in range(0, len(data), CHUNK):
        part = data[a : a + CHUNK]
        n = len(part)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = inside[part]
        solid[0] = a > 0 and inside[data[a - 1]]
        solid[-1] = a + n < len(data) and inside[data[a + n]]
        edge = np.zeros(n + 1, bool)
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + n, "right")] - a] = True
        starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        before += np.searchsorted(starts, offsets - a)
        if begun is not None:
            starts = np.concatenate(([0], starts))
        cut = len(starts) > len(ends)
        if cut:
            ends = np.append(ends, n)
        total = np.zeros(n + 1, U)
        np.cumsum(_POWERS[:n] * table[part], out=total[1:])
        words = (total[ends] - total[starts]) * _BACK[starts]
        if begun is not None:
            words[:1] = words[:1] * np.full(1, pow(BASE, length, 2**64), U) + begun
        if cut:
            length = n - int(starts[-1]) + (length if begun is not None and len(starts) == 1 else 0)
            begun, words = words[-1:], words[:-1]
        else:
            begun = None
        made.append(mix(words))
    return np.concatenate(made), before


def lengths_of(offsets: np.ndarray) -> np.ndarray:
    return offsets[1:] - offsets[:-1]


def owners(offsets: np.ndarray) -> np.ndarray:
    """Index of the text that each element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), lengths_of(offsets))


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of CHUNK elements, and the index of the text that each of them belongs to."""
    for a in range(0, int(offsets[-1]), CHUNK):
        b = min(a + CHUNK, int(offsets[-1]))
        yield a, b, owners(np.clip(offsets, a, b))


def windows(values: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k values inside one text, with each text's offsets into them.

    A text of fewer than k values, but at least one, gives one hash of all of them.
    """
    counts = lengths_of(offsets)
    short = counts < k
    made = np.where(short, np.minimum(counts, 1), counts - k + 1)
    out_offsets = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(out_offsets[-1], U)
    for a, b, text in blocks(out_offsets):
        first = np.arange(a, b) + (offsets[:-1] - out_offsets[:-1])[text]
        last = offsets[1:][text]
        own = out[a:b]
        for j in range(k):
            at = first + j
            inside = at < last
            own[inside] = own[inside] * STEP + values[at[inside]]
        own[:] = mix(own)
    return out, out_offsets


def char_ngrams(
    column: pa.Array, sizes: tuple[int, ...], bits: int, lower: bool = True, padded: bool = False, own: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (below 2**bits) and text index of every character n-gram of the given sizes.

    own: only n-grams that begin before this code point count (for one text).

    N-grams run over code points and never cross from one text to the next.
    Control characters count as blanks; padded puts a blank before every text,
    so that its first word begins like any other.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if lower:
        column = pc.utf8_lower(column)
    if padded:
        column = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string()))
    data, _ = text_buffers(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    points = np.maximum(points, np.uint32(32))
    counts = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    buckets, docs = [], []
    rolled = np.zeros(len(points), np.uint32)
    step = np.uint32(0x01000193)
    spread = points * np.uint32(0x9E3779B1)
    for n in range(1, max(sizes) + 1):
        if len(points) < n:
            break
        rolled = (rolled[: len(points) - n + 1] * step) ^ spread[n - 1 :]
        if n in sizes:
            whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
            h = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            if own is not None:
                whole[own:] = False
            buckets.append((h >> np.uint32(32 - bits))[whole])
            docs.append(doc[: len(doc) - n + 1][whole])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(docs)


def gram_parts(column: pa.Array, sizes: tuple[int, ...], bits: int, lower: bool = True, padded: bool = False, limit: int = 500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What char_ngrams gives, for row ranges (first, end, buckets, text indexes from first) of about limit bytes.

    A longer text is cut between characters, and each of its parts but the last
    reads on into the next one as far as n-grams reach; it comes as several
    ranges of that one row, which together have every n-gram once.
    """
    for a, b in slices(column, limit):
        data, offsets = text_buffers(column[a:b])
        if b - a > 1 or len(data) <= limit:
            yield a, b, *char_ngrams(column[a:b], sizes, bits, lower, padded)
            continue
        at = 0
        while at < len(data):
            end = _boundary(data, min(at + limit, len(data)))
            reach = end
            for _ in range(max(sizes) - 1):
                reach = _boundary(data, min(reach + 1, len(data)))
            part = pa.array([data[at:reach].tobytes().decode("utf-8", "replace")], pa.large_string())
            first = padded and at == 0
            count = int(np.count_nonzero(data[at:end] & 0xC0 != 0x80)) + first
            yield a, b, *char_ngrams(part, sizes, bits, lower, first, count)
            at = end


def _boundary(data: np.ndarray, at: int) -> int:
    """The first place from at on where a character begins, or the end."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def distinct_by_doc(bucket: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once for each text, ordered by text and bucket."""
    key = (doc.astype(U) << U(bits)) | bucket.astype(U)
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key & U(2**bits - 1)).astype(np.uint32), (key >> U(bits)).astype(np.int32)


def sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n) if len(doc) else np.zeros(n)
