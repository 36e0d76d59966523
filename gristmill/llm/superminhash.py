"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash gives every shingle a pseudo-random permutation of the signature's
positions; at step j it offers ``j + fraction`` to the j-th position of its
permutation, and a position keeps the least offer. Because all offers of step j
are below those of step j + 1, a text is finished as soon as every position
has an offer: long texts after one step. Steps are taken for all shingles of a
batch at once in numpy.

Texts with equal shingles (any order) are put together first. The rest meet in
buckets of equal bands. Within a bucket every member is compared with the
smallest one, and the groups so found are joined. Members of buckets that still
hold several groups are matched by their rarest shingles: with a set's shingles
ordered by how many members have them, two sets of similarity t must share one
of the first ``(1 - 2t / (1 + t)) n + 1`` of the smaller set (n shingles) and the
first ``(1 - t) n + 1`` of the larger. Pairs that do so, share a bucket and lie in
different groups are compared. So no pair is left out, but thousands of copies
need thousands of comparisons, and members that only have a passage in common
don't meet, as its shingles are the frequent ones. A comparison is the exact
Jaccard similarity of the two shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._arrays import ALNUM, FOLDED, U, blocks, lengths_of, mix, slices, text_buffers, windows, word_hashes
from gristmill.llm._bits import bit_table, passing
from gristmill.llm._frames import fresh, quoted
from gristmill.operators.components import connected_components
from gristmill.storage import written

WORDS = 2
POSITIONS = 128
BANDS = 32
THRESHOLD = 0.6
_EMPTY = U(2**64 - 1)
_LOW56 = U(2**56 - 1)


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of words (lower case, letters and digits) of every text, and offsets."""
    return windows(*word_hashes(*text_buffers(column), FOLDED, ALNUM), words)


def signatures(values: np.ndarray, offsets: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """SuperMinHash of every text, (texts, positions) of step << 56 | fraction; 2**64 - 1 for texts without shingles."""
    n = len(offsets) - 1
    out = np.full((n, positions), _EMPTY, U)
    flat = out.reshape(-1)
    for a, b, doc in blocks(offsets):
        step0 = mix(values[a:b] + U(0x632BE59BD9B4E019))
        place = ((step0 >> U(32)) * U(positions)) >> U(32)
        np.minimum.at(flat, doc * positions + place.astype(np.int64), mix(step0) & _LOW56)
    open_doc = (out == _EMPTY).any(1) & (lengths_of(offsets) > 0)
    chosen = np.flatnonzero(open_doc)
    values, offsets = _distinct(values, offsets, chosen)
    sizes = lengths_of(offsets)
    place = ((mix(values + U(0x632BE59BD9B4E019)) >> U(32)) * U(positions)) >> U(32)
    chosen, names = np.arange(len(chosen)), chosen
    at = 0
    while at < len(chosen):  # groups of texts whose permutations fit in memory
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[chosen[at:]]), 200_000, "right")))
        group = chosen[at:end]
        at = end
        which = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in group])
        owner, value = np.repeat(names[group], sizes[group]), values[which]
        first = place[which].astype(np.int64)
        kind = np.uint8 if positions <= 256 else np.uint16
        perm = np.tile(np.arange(positions, dtype=kind), (len(which), 1))
        rows = np.arange(len(which))
        perm[rows, first], perm[:, 0] = perm[:, 0].copy(), first.astype(kind)
        for j in range(1, positions):
            draw = mix(value + U((0x632BE59BD9B4E019 * (j + 1)) % 2**64))
            k = j + (((draw >> U(32)) * U(positions - j)) >> U(32)).astype(np.int64)
            rows = np.arange(len(value))
            perm[rows, j], perm[rows, k] = perm[rows, k], perm[rows, j].copy()
            np.minimum.at(flat, owner * positions + perm[:, j], (U(j) << U(56)) | (mix(draw) & _LOW56))
            still = (out[owner] == _EMPTY).any(1) if len(value) < 4096 else np.isin(owner, names[group][(out[names[group]] == _EMPTY).any(1)])
            if not still.all():
                owner, value, perm = owner[still], value[still], perm[still]
            if not len(value):
                break
    return out


def _distinct(values: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the chosen texts, each once in a text, and offsets: a value offers the same however often it occurs."""
    sets = [np.unique(values[offsets[d] : offsets[d + 1]]) for d in chosen]
    return np.concatenate([*sets, values[:0]]), np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts, bands) hash of every band of a signature together with its number."""
    n, positions = signature.shape
    parts = signature.reshape(n, bands, positions // bands)
    key = np.zeros((n, bands), U) + mix(np.arange(1, bands + 1, dtype=U))
    for k in range(parts.shape[2]):
        key = mix(key ^ parts[:, :, k])
    return key.astype(np.int64)


def nodes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of every text's shingles, the same for the same shingles in any order."""
    total = np.zeros(len(offsets) - 1, U)
    for a, b, doc in blocks(offsets):
        np.add.at(total, doc, mix(values[a:b] ^ U(0x5851F42D4C957F2D)))
    return mix(total ^ mix(lengths_of(offsets).astype(U))).astype(np.int64)


def _sketcher(words: int, positions: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                values, offsets = shingles(batch.column(1)[a:b], words)
                has = np.flatnonzero(lengths_of(offsets))
                if not len(has):
                    continue
                keys = band_keys(signatures(values, offsets, positions), bands)[has]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b].take(pa.array(has)), pa.array(nodes(values, offsets)[has]), listed],
                    names=["id", "node", "keys"],
                )

    return run


def _setter(words: int, bits):
    """Distinct shingles of the texts whose hash (first column) may be a chosen one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).filter(pa.array(passing(bits.value, batch.column(0).to_numpy())))
            for a, b in slices(column):
                values, offsets = shingles(column[a:b], words)
                sets = [np.unique(values[x:y]).tobytes() for x, y in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(nodes(values, offsets)), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                most = min(len(x), len(y))
                if most < threshold * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= threshold * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicate_groups(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    positions: int = POSITIONS,
    bands: int = BANDS,
    text: str = "text",
    ident: str = "doc_id",
) -> DataFrame:
    """(doc_id, group_id) of every document in a group of at least two; group_id is the group's smallest id.

    Two documents belong together if the Jaccard similarity of their sets of
    word runs is at least threshold, directly or through others. Texts shorter
    than a run have one shingle of all their words; null texts and texts without
    a letter or digit have none and belong to no group. Rows with null id are
    left out. Rows with the same id are one document, which belongs with whatever
    any of its texts belongs with. An empty table gives an empty result. Found with the probability of the bands: 0.988 for a pair at
    similarity 0.6, 0.998 at 0.65.
    """
    kind = docs.schema[ident].dataType.simpleString()
    named = docs.select(F.col(quoted(ident)).alias("id"), F.col(quoted(text)).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    sketches = written(named.mapInArrow(_sketcher(words, positions, bands), f"id {kind}, node bigint, keys array<bigint>"), "sketches")
    alike = written(sketches.groupBy("node").agg(F.min("id").alias("first"), F.any_value("keys").alias("keys")), "distinct")
    spread = alike.select("node", F.explode("keys").alias("key"))
    hubs = spread.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1").select("key", "hub")
    buckets = written(spread.join(hubs, "key"), "buckets")  # a key's rows are never put into one, however many they are
    needed = written(alike.join(buckets.select("node").distinct(), "node", "left_semi").select(F.xxhash64("first").alias("h")).distinct(), "needed")
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(needed, needed.count()))
    texts = named.select(F.xxhash64("id").alias("h"), "text")  # they stay where they are read; those of more ids than needed do no harm
    sets = written(texts.mapInArrow(_setter(words, bits), "node bigint, shingles binary").groupBy("node").agg(F.any_value("shingles").alias("shingles")), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        near = F.least(F.length("x"), F.length("y")) >= F.lit(threshold) * F.greatest(F.length("x"), F.length("y"))
        return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "x", "y").mapInArrow(_verifier(threshold), "a bigint, b bigint")

    stars = written(buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    edges = written(verified(stars), "edges")
    found = connected_components(edges, "a", "b").withColumnRenamed("id", "node")
    placed = written(buckets.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    members = placed.join(split, "key", "left_semi").select("node", "component").distinct()
    rest = _rare_pairs(sets.join(members, "node").select("node", "component", "shingles"), threshold).join(stars, ["a", "b"], "left_anti")
    left, right = (alike.select(F.col("node").alias(c), F.col("keys").alias(k), F.col("first").alias(i)) for c, k, i in (("a", "p", "src"), ("b", "q", "dst")))
    more = written(verified(rest.join(left, "a").join(right, "b").where(F.arrays_overlap("p", "q")).select("a", "b")), "edges")
    links = edges.unionAll(more).join(left, "a").join(right, "b").select("src", "dst").where("src <> dst")
    same = sketches.select("id", "node").join(alike.select("node", "first"), "node").where("id <> first").select("first", "id")
    groups = connected_components(links.unionAll(same), "src", "dst")
    return groups.select(F.col("id").alias("doc_id"), F.col("component").alias("group_id"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            tokens = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
            one = np.full(len(tokens), i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(one)), batch.column(1).take(pa.array(one)), pa.array(tokens), pa.array(np.full(len(tokens), len(tokens)))],
                names=["node", "component", "token", "n"],
            )


def _rare_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of different components, of all members (node, component, shingles) that may reach the threshold.

    Every such pair shares a shingle among the rarest of both; shingles that
    only one member has pair nothing and aren't sent on.
    """
    tokens = written(members.mapInArrow(_listed, "node bigint, component bigint, token bigint, n bigint"), "tokens")
    many = tokens.groupBy("token").agg(F.count("*").alias("members"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("members", "token"))
    ranked = tokens.join(many, "token").withColumn("rank", rank).where("members > 1")
    eps = 1e-9  # of rounding: the bounds may be too wide by one shingle, never too narrow
    probe = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - eps) + 1).select("token", "node", "component", "n", "rank")
    kept = written(probe, "rare")
    index = kept.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - eps) + 1)
    small = index.select("token", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"))
    large = kept.select("token", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"))
    fits = (F.col("cx") != F.col("cy")) & (F.struct("nx", "x") < F.struct(F.col("ny").alias("nx"), F.col("y").alias("x"))) & (F.col("nx") >= F.col("ny") * threshold - eps)
    met = small.join(large, "token").where(fits)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def drop_near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    positions: int = POSITIONS,
    bands: int = BANDS,
    text: str = "text",
    ident: str = "doc_id",
) -> DataFrame:
    """Rows of docs with one document of each group, the one with the smallest id, all columns unchanged.

    Rows that near_duplicate_groups leaves out (null id, nothing to compare)
    all stay. All rows of one id stay or go together.
    """
    groups = written(near_duplicate_groups(docs, threshold, words, positions, bands, text, ident), "groups")
    (gone,) = fresh(docs, "gone")
    drop = groups.where("doc_id <> group_id").select(F.col("doc_id").alias(gone))
    return docs.join(drop, F.col(quoted(ident)) == F.col(gone), "left_anti")
