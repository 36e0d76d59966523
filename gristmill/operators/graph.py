"""Graph measures, ranking, walks and communities over edge tables.

Edges are rows (src, dst[, weight]). Undirected operators first bring edges
into canonical form. Iterative operators write every round to the shared
folder, so that lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, MapType, StructType

from gristmill.storage import flat_columns, flat_file, is_mounted, mapped, mounted, new_folder, put, tasks_for, written

#: Pairs or wedges that are made at once.
AT_ONCE = 1 << 20


def dense_ids(names: DataFrame, name: str) -> DataFrame:
    """(name, id): the distinct non-null values of a column, numbered from 1 in order.

    Ranges of values are numbered side by side; only the ranges' sizes meet.
    """
    rows = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    ordered = written(rows.repartitionByRange("name").sortWithinPartitions("name").withColumn("m", F.monotonically_increasing_id()), "ids")
    numbered = ordered.select("name", F.shiftright("m", 33).alias("part"), (F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = numbered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return numbered.join(F.broadcast(bases), "part").select("name", (F.col("base") + F.col("at") + 1).alias("id"))  # bases: one row a task


def encode_edges(edges: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Edges with both ends replaced by the dictionary's ids; edges with an unknown end are left out."""
    a = dictionary.select(F.col("name").alias("src"), F.col("id").alias("a"))
    b = dictionary.select(F.col("name").alias("dst"), F.col("id").alias("b"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest)


def canonical(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(src, dst, weight) with src < dst: weights of both directions summed (1 an edge without weight), no loops or null ends."""
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("weight"))
    return ends.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, made in one pass."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    pair = F.inline(F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(pair, *rest)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, weighted) of every end of canonical edges."""
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of every triangle of canonical edges, a < b < c.

    Each edge points from the end of smaller degree to the other; wedges are
    built at the small end only, so a hub of n edges doesn't give n squared.
    Edges between whole numbers lie in flat files that workers map into memory,
    and no wedge leaves its task. Other ids, and a shared folder that isn't
    mounted, have the wedges shuffled.
    """
    kind = edges.schema["src"].dataType
    edges = written(edges.select("src", "dst"), "edges")
    count = edges.count()
    tasks = tasks_for(count)
    size = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    named = edges.repartition(tasks, "src").join(size.withColumnsRenamed({"id": "src", "degree": "ds"}), "src")
    named = named.repartition(tasks, "dst").join(size.withColumnsRenamed({"id": "dst", "degree": "dd"}), "dst")
    forward = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    lead = named.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("v"))
    if isinstance(kind, IntegralType) and is_mounted(edges.sparkSession):
        (heads, ends), count = flat_columns(lead.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")), ["u", "v"], count, "lead")
        slices = -(-count // EDGES_A_SLICE)
        rows = edges.sparkSession.range(0, slices, 1, max(1, min(slices, 32), slices // 32))
        return rows.mapInArrow(_closed(heads, ends, EDGES_A_SLICE, AT_ONCE), "a bigint, b bigint, c bigint").select(*[F.col(x).cast(kind) for x in "abc"])
    lead = written(lead, "lead")
    wedge = lead.alias("p").join(lead.alias("q"), (F.col("p.u") == F.col("q.u")) & (F.col("p.v") < F.col("q.v"))).select(F.col("p.u").alias("u"), F.col("p.v").alias("src"), F.col("q.v").alias("dst"))
    found = wedge.join(edges.select("src", "dst"), ["src", "dst"], "left_semi")
    return found.select(F.array_sort(F.array("u", "src", "dst")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


#: Edges whose wedges are closed together.
EDGES_A_SLICE = 1 << 14


def _closed(heads: str, ends: str, size: int, most: int):
    """Arrow function from numbers of slices to (a, b, c): triangles of the directed edges in two flat files, in order.

    size is the edges of a slice, most the wedges made at once. A vertex belongs to the slice where its edges begin. Of its neighbours'
    neighbours those are kept that are its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = mapped(heads), mapped(ends)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                lo, hi = (len(u) if at >= len(u) else int(np.searchsorted(u, u[at], "right" if at and u[at] == u[at - 1] else "left")) for at in (k * size, (k + 1) * size))
                own, near = np.array(u[lo:hi]), np.array(v[lo:hi])
                known, place = np.unique(near, return_inverse=True)
                first = np.searchsorted(u, known, "left")
                many = (np.searchsorted(u, known, "right") - first)[place]
                first = first[place]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else [0]
                found, held = [], 0
                for x, y in zip(cuts, cuts[1:]):
                    if y - x < 2:
                        continue
                    mine = near[x:y]
                    upto = np.cumsum(many[x:y])
                    at = 0
                    while at < y - x:  # wedges of one vertex, a part at a time
                        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
                        n = many[x + at : x + to]
                        total = int(n.sum())
                        if total:
                            far = v[np.repeat(first[x + at : x + to] - np.cumsum(n) + n, n) + np.arange(total)]
                            hit = mine[np.minimum(np.searchsorted(mine, far), len(mine) - 1)] == far
                            if hit.any():
                                mid = np.repeat(mine[at:to], n)[hit]
                                found.append(np.sort(np.stack([np.full(len(mid), own[x]), mid, far[hit]]), axis=0))
                                held += len(mid)
                        at = to
                        if held >= most:
                            yield _triple(found)
                            found, held = [], 0
                if found:
                    yield _triple(found)

    return run


def _triple(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in np.concatenate(found, axis=1)], names=["a", "b", "c"])


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(id, triangles) of the vertices that lie in any."""
    return triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def triangle_edges(edges: DataFrame) -> DataFrame:
    """The edges that lie in a triangle."""
    side = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    kept = triangles(edges).select(F.inline(F.array(side("a", "b"), side("a", "c"), side("b", "c"))))
    return edges.join(kept, ["src", "dst"], "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, targets, weights): neighbour lists in the order of the neighbours' ids."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("dst").alias("t"), F.col("weight").alias("w"))))
    out = both_ways(edges).groupBy(F.col("src").alias("id")).agg(listed.alias("l"))
    return out.select("id", F.col("l.t").alias("targets"), F.col("l.w").alias("weights"))


def shared_features(pairs: DataFrame, item: str, feature: str) -> tuple[DataFrame, DataFrame, int]:
    """(i, f), (src, dst, shared) and their tasks: the distinct items and features, and pairs of items, src < dst, that share any.

    A feature of n items gives n * (n - 1) / 2 pairs; they are counted first, so
    that their number sets the number of tasks. pairs is read twice.
    """
    kind = pairs.schema[feature].dataType
    f = F.to_json(F.struct(feature)) if isinstance(kind, (StructType, ArrayType, MapType)) else F.col(feature)
    rows = pairs.where(F.col(item).isNotNull() & F.col(feature).isNotNull()).select(F.col(item).alias("i"), f.alias("f"))
    own = written(rows.repartition(tasks_for(rows.count()), "f").distinct(), "features")
    sizes = own.groupBy("f").agg(F.count("*").alias("n"))
    tasks = tasks_for(int(sizes.agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0))
    name = own.schema["i"].dataType.simpleString()
    met = own.repartition(tasks, "f").sortWithinPartitions("f", "i").mapInArrow(_pairs_of_runs, f"src {name}, dst {name}, n bigint")
    return own, met.repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.sum("n").alias("shared")), tasks


def _pairs_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (i, f) in the order of f and i to pairs of items of one f, earlier one first; equal pairs met together are combined if that pays."""
    combine, held, rows, limit = True, [], 0, 1 << 17

    def made(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal combine, held, rows, limit
        table = table.combine_chunks()
        code = table.column("f").combine_chunks().dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero(np.diff(code)) + 1
        whole = len(code) if last else int(cuts[-1]) if len(cuts) else 0
        held, rows = [table.slice(whole)], len(code) - whole
        limit = max(1 << 17, 2 * rows)  # a long run isn't looked through for every batch
        starts = np.concatenate(([0], cuts[cuts < whole], [whole]))
        after = np.repeat(starts[1:], np.diff(starts)) - np.arange(whole) - 1  # later rows of the same feature
        upto, item, at = np.cumsum(after), table.column("i").combine_chunks(), 0
        while at < whole:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
            n = after[at:to]
            left = np.repeat(np.arange(at, to), n)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            at = to
            if not len(left):
                continue
            out = pa.table({"src": item.take(pa.array(left)), "dst": item.take(pa.array(right)), "n": pa.array(np.ones(len(left), np.int64))})
            if combine and not pa.types.is_nested(item.type):
                less = out.group_by(["src", "dst"], use_threads=False).aggregate([("n", "sum")]).select(["src", "dst", "n_sum"]).rename_columns(["src", "dst", "n"])
                combine, out = len(less) < 0.8 * len(out), less
            yield from out.combine_chunks().to_batches()

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += len(batch)
        if rows >= limit:
            yield from made(pa.concat_tables(held), False)
    if rows:
        yield from made(pa.concat_tables(held), True)


def containment(pairs: DataFrame, item: str, feature: str, above: float = 0.0) -> DataFrame:
    """(src, dst, shared, weight): items that share features; weight is the shared part of src's features.

    Repeated rows count once. A feature of n items gives n * n pairs.
    """
    own, shared, tasks = shared_features(pairs, item, feature)
    total = own.groupBy("i").agg(F.count("*").alias("n")).repartition(2 * tasks, "i")
    weighted = both_ways(shared).repartition(2 * tasks, "src").join(total, F.col("src") == F.col("i")).select("src", "dst", "shared", (F.col("shared") / F.col("n")).alias("weight"))
    return weighted.where(F.col("weight") > above)


def page_rank(edges: DataFrame, reset: float = 0.1, tolerance: float = 0.001, rounds: int = 100, source=None, weighted: bool = False) -> DataFrame:
    """(id, rank) of every vertex of directed edges; ends when no rank moves by more than tolerance, or after `rounds`.

    Rank goes to the out-edges evenly, or by weight if weighted. Without source
    every vertex has reset, with it only source has (the personalised variant).
    Ranks don't sum to one; what sinks hold is not given on. Null is no vertex.
    Edges are brought to the blocks of their ends once; the ranks of whole
    numbers lie in a flat file that workers map into memory, so that a round
    shuffles nothing. Other ids, and a shared folder that isn't mounted, have
    the edges joined with the ranks in every round.
    """
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    share = written(edges.select("src", "dst", (w / F.sum(w).over(Window.partitionBy("src"))).alias("share")).where("src IS NOT NULL AND dst IS NOT NULL"), "shares")
    ids = written(share.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "vertices")
    if all(isinstance(share.schema[c].dataType, IntegralType) for c in ("src", "dst")) and is_mounted(edges.sparkSession):
        return _ranks_in_blocks(share, ids, reset, tolerance, rounds, source)
    start = F.lit(1.0) if source is None else F.when(F.col("id") == source, 1.0).otherwise(0.0)
    base = F.lit(reset) if source is None else F.when(F.col("id") == source, reset).otherwise(0.0)
    ranks = ids.select("id", start.alias("rank"))
    for _ in range(rounds):
        given = share.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("sum"))
        new = ranks.join(given, F.col("id") == F.col("dst"), "left").select("id", (base + (1 - reset) * F.coalesce("sum", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        made = written(new, "ranks")
        ranks = made.select("id", "rank")
        if tolerance > 0 and not made.where(F.abs(F.col("rank") - F.col("old")) > tolerance).limit(1).count():
            break
    return ranks


def _ranks_in_blocks(share: DataFrame, ids: DataFrame, reset: float, tolerance: float, rounds: int, source: int | None) -> DataFrame:
    """page_rank of edges (src, dst, share): a block has the edges into a range of vertices, a round one task a block."""
    spark, kind = share.sparkSession, ids.schema["id"].dataType
    (known,), count = flat_columns(ids.select(F.col("id").cast("bigint").alias("id")), ["id"], ids.count(), "ids")
    blocks = tasks_for(share.count())
    width = max(1, -(-count // blocks))
    folder = mounted(new_folder(spark, "ranks"))
    os.makedirs(folder)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = mapped(known)
        for batch in batches:
            src, dst = (np.searchsorted(names, batch.column(c).to_numpy()) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array((dst // width).astype(np.int32)), pa.array(dst), pa.array(src), batch.column(2)], names=["block", "dst", "src", "share"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, held, rows = None, None, [], 0

        def flush(last: bool) -> None:
            nonlocal file, held, rows
            if held:
                part = pa.Table.from_batches(held).combine_chunks()
                file = file or pa.ipc.new_stream(f"{folder}/{block}.{token}", part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                file.write_table(part)
                held, rows = [], 0
            if last and file is not None:
                file.close()
                os.replace(f"{folder}/{block}.{token}", f"{folder}/{block}")
                file = None

        token = os.urandom(8).hex()
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if of[lo] != block:
                    flush(True)
                    block = int(of[lo])
                held.append(batch.slice(lo, hi - lo).select(["dst", "src", "share"]))
                rows += hi - lo
                if rows >= 1 << 17:
                    flush(False)
        flush(True)
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["done"])

    placed = share.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"), "share").mapInArrow(place, "block int, dst bigint, src bigint, share double")
    placed.repartitionById(blocks, F.col("block")).sortWithinPartitions("dst", "src").mapInArrow(keep, "done bigint").agg(F.sum("done")).collect()
    at = int(np.searchsorted(mapped(known)[:count], source)) if source is not None else -1
    at = at if source is not None and at < count and mapped(known)[at] == source else -1
    every = spark.range(0, blocks, 1, blocks)

    def turn(old: str | None, new: str) -> float:
        """Write the ranks after a round, and return by how much the farthest moved."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    lo, hi = min(count, k * width), min(count, (k + 1) * width)
                    whole = 1.0 if old is None else reset
                    made = np.full(hi - lo, whole if source is None else 0.0)
                    if lo <= at < hi:
                        made[at - lo] = whole
                    moved = 0.0
                    if old is not None and hi > lo:
                        ranks, sums = mapped(old, np.float64), np.zeros(hi - lo)
                        if os.path.exists(f"{folder}/{k}"):
                            with pa.ipc.open_stream(pa.memory_map(f"{folder}/{k}")) as parts:
                                for part in parts:
                                    dst, src, given = (c.to_numpy() for c in part.columns)
                                    low = int(dst[0])
                                    some = np.bincount(dst - low, ranks[src] * given)
                                    sums[low - lo : low - lo + len(some)] += some
                        made += (1 - reset) * sums
                        moved = float(np.max(np.abs(made - ranks[lo:hi])))
                    put(new, lo, made)
                    yield pa.RecordBatch.from_arrays([pa.array([moved])], names=["moved"])

        return every.mapInArrow(run, "moved double").agg(F.max("moved")).first()[0]

    path = flat_file(f"{folder}/rank-0", count)
    turn(None, path)
    for step in range(1, rounds + 1):
        before, path = path, flat_file(f"{folder}/rank-{step}", count)
        moved = turn(before, path)
        os.remove(before)
        if tolerance > 0 and moved <= tolerance:
            break

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ranks = mapped(known), mapped(path, np.float64)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                lo, hi = min(count, k * width), min(count, (k + 1) * width)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names[lo:hi])), pa.array(np.array(ranks[lo:hi]))], names=["id", "rank"])

    return every.mapInArrow(told, "id bigint, rank double").select(F.col("id").cast(kind).alias("id"), "rank")


def normalised_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, similarity, weight): the edge's weight, and one over the number of out-edges of src."""
    return edges.select("src", "dst", F.col("weight").alias("similarity"), (F.lit(1.0) / F.count("*").over(Window.partitionBy("src"))).alias("weight"))


def hops(edges: DataFrame, landmarks: DataFrame, limit: int = 1000) -> DataFrame:
    """(id, hops): fewest edges from every vertex to the nearest landmark; unreachable ones are left out.

    edges are undirected; landmarks has id. Each round visits the frontier's neighbours only.
    Links between whole numbers lie in flat files that workers map into memory; other ids, and a
    shared folder that isn't mounted, have the links joined with the frontier.
    """
    links = written(both_ways(edges.select("src", "dst")).where("src IS NOT NULL AND dst IS NOT NULL"), "links")
    near = lambda f: links.join(f.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"))
    linked = lambda f: f.join(links.select(F.col("src").alias("id")), "id", "left_semi")
    kind = links.schema["src"].dataType
    if isinstance(kind, IntegralType) and is_mounted(edges.sparkSession):
        (heads, ends), _ = flat_columns(links.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")), ["src", "dst"], links.count(), "links")
        near = lambda f: f.select(F.col("id").cast("bigint").alias("id")).mapInArrow(_neighbours(heads, ends, AT_ONCE), "id bigint").select(F.col("id").cast(kind).alias("id"))
        linked = lambda f: f.select(F.col("id").cast("bigint").alias("id")).mapInArrow(_linked(heads), "id bigint").select(F.col("id").cast(kind).alias("id"))
    frontier = written(linked(landmarks.select("id").where("id IS NOT NULL").distinct()).select("id", F.lit(0).alias("hops")), "frontier")
    seen = frontier
    for step in range(1, limit):
        frontier = written(near(frontier).distinct().join(seen, "id", "left_anti").select("id", F.lit(step).alias("hops")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def _neighbours(heads: str, ends: str, most: int):
    """Arrow function from ids to their neighbours by two flat files in the order of the first; most is the neighbours made at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = mapped(heads), mapped(ends)
        for batch in batches:
            ids = np.sort(batch.column(0).to_numpy())
            first = np.searchsorted(u, ids, "left")
            upto = np.cumsum(np.searchsorted(u, ids, "right") - first)
            total = int(upto[-1]) if len(upto) else 0
            for lo in range(0, total, most):  # neighbours of one id may be cut
                at = np.arange(lo, min(total, lo + most))
                of = np.searchsorted(upto, at, "right")
                far = v[first[of] + at - np.where(of > 0, upto[of - 1], 0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(far))], names=["id"])

    return run


def _linked(heads: str):
    """Arrow function that keeps the ids in a flat file in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = mapped(heads)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(u):
                yield batch.filter(pa.array(u[np.minimum(np.searchsorted(u, ids), len(u) - 1)] == ids))

    return run


def landmark_distance(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(id, distance): hops to the nearest landmark over the most there are, at most 1."""
    found = written(hops(edges, landmarks), "hops")
    deepest = found.agg(F.greatest(F.max("hops"), F.lit(1)).alias("most"))
    return found.crossJoin(F.broadcast(deepest)).select("id", F.least(F.col("hops") / F.col("most"), F.lit(1.0)).alias("distance"))


def _unit(*parts: str | Column) -> Column:
    """Number in [0, 1) from a hash of the parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def random_walks(edges: DataFrame, starts: DataFrame, landmarks: DataFrame, steps: int, walks: int = 1, seed: int = 0) -> DataFrame:
    """(start, walk, id, steps): where each walk ends: at the first landmark, at a vertex without out-edges, or after so many steps.

    A walk leaves along an out-edge by weight; the draw is a hash of seed,
    start, walk and step, so results repeat. starts and landmarks have id.
    """
    upto = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("src")
    part = F.sum("weight").over(upto) / F.sum("weight").over(whole)
    ranked = edges.select("src", "dst", part.alias("upto"), F.row_number().over(Window.partitionBy("src").orderBy(F.desc("dst"))).alias("last"))
    table = ranked.groupBy("src").agg(F.sort_array(F.collect_list(F.struct(F.when(F.col("last") == 1, 1.0).otherwise(F.col("upto")).alias("upto"), "dst"))).alias("out"))
    table = written(table, "walk-table")
    stops = written(landmarks.select("id").distinct(), "landmarks")
    now = starts.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), "id", F.lit(0).alias("steps"))
    flag = lambda df: df.join(stops.withColumn("stop", F.lit(True)), "id", "left").withColumn("done", F.coalesce("stop", F.lit(False))).drop("stop")
    now = written(flag(now), "walks")
    ended = now.where("done")
    for step in range(1, steps + 1):
        draw = _unit(str(seed), F.col("start"), F.col("walk"), str(step))
        moved = now.where("NOT done").join(table, F.col("id") == F.col("src"), "left").withColumn("draw", draw)
        chosen = F.filter("out", lambda e: e["upto"] > F.col("draw"))[0]["dst"]
        there = moved.select("start", "walk", F.coalesce(chosen, F.col("id")).alias("id"), F.when(F.col("out").isNull(), F.col("steps")).otherwise(F.lit(step)).alias("steps"), F.col("out").isNull().alias("stuck"))
        now = written(flag(there).withColumn("done", F.col("done") | F.col("stuck") | F.lit(step == steps)).drop("stuck"), "walks")
        ended = ended.unionByName(now.where("done"))
        if now.where("NOT done").isEmpty():
            break
    return ended.select("start", "walk", "id", "steps")


# Communities


def _at_both_ends(edges: DataFrame, a: DataFrame, b: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges joined with rows of their src and of their dst, in as many tasks as they ask for."""
    if tasks is None:
        edges = written(edges, "edges")
        tasks = tasks_for(edges.count())
    return edges.repartition(tasks, "src").join(a, "src").repartition(tasks, "dst").join(b, "dst")


def community_sizes(members: DataFrame) -> DataFrame:
    """(community, size) of (id, community)."""
    return members.groupBy("community").agg(F.count("*").alias("size"))


def community_stats(edges: DataFrame, members: DataFrame, tasks: int | None = None) -> DataFrame:
    """(community, size, internal, external, density): edges inside and across; density is 2 * internal / size squared.

    edges are canonical, members has (id, community). An edge between two
    communities is external to both. tasks is how many the edges are brought to;
    if it's unknown they are written and counted.
    """
    a = members.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    sides = _at_both_ends(edges.select("src", "dst"), a, b, tasks)
    inside = F.col("ca") == F.col("cb")
    counted = sides.select(inside.alias("inside"), F.explode(F.when(inside, F.array("ca")).otherwise(F.array("ca", "cb"))).alias("community"))
    per = counted.groupBy("community").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external"))
    out = community_sizes(members).join(per, "community", "left").na.fill(0, ["internal", "external"])
    return out.withColumn("density", 2 * F.col("internal") / (F.col("size") * F.col("size")).cast("double"))


def in_large_communities(edges: DataFrame, members: DataFrame, above: int = 3) -> DataFrame:
    """Edges with an end in a community of more than so many members, with column mutation: whether the ends' communities differ."""
    large = community_sizes(members).where(F.col("size") > above)
    named = members.join(large, "community", "left").select("id", "community", F.col("size").isNotNull().alias("large"))
    a = named.select(F.col("id").alias("src"), F.col("community").alias("ca"), F.col("large").alias("la"))
    b = named.select(F.col("id").alias("dst"), F.col("community").alias("cb"), F.col("large").alias("lb"))
    met = _at_both_ends(edges, a, b).where("la OR lb")
    return met.withColumn("mutation", F.col("ca") != F.col("cb")).drop("ca", "cb", "la", "lb")


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """Sum of each community's share of edge weight inside it less the square of its share of degrees."""
    a = members.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    sides = edges.join(a, "src").join(b, "dst")
    part = sides.select(F.inline(F.array(F.struct(F.col("ca").alias("c"), F.when(F.expr("ca = cb"), F.col("weight")).otherwise(0).alias("i"), F.col("weight").alias("k")), F.struct(F.col("cb").alias("c"), F.when(F.expr("ca = cb"), F.col("weight")).otherwise(0).alias("i"), F.col("weight").alias("k")))))
    per = part.groupBy("c").agg(F.sum("i").alias("i"), F.sum("k").alias("k"))
    total = F.sum("k").over(Window.partitionBy())
    row = per.select((F.col("i") / total - F.pow(F.col("k") / total, 2)).alias("q")).agg(F.sum("q").alias("q")).first()
    return float(row["q"] or 0.0)


def _moved(state: DataFrame, links: DataFrame, total: float, lower: bool) -> DataFrame:
    """One pass of local moving: every vertex looks for the community of largest gain among its neighbours' and its own."""
    sigma = state.groupBy("community").agg(F.sum(F.col("k") + F.col("internal")).alias("sigma"))
    near = links.join(state.select(F.col("id").alias("dst"), F.col("community").alias("near")), "dst").groupBy(F.col("src").alias("id"), "near").agg(F.sum("weight").alias("link"))
    scored = near.join(state, "id").join(sigma.withColumnRenamed("community", "near"), "near")
    own = F.col("near") == F.col("community")
    ki = F.col("k") + F.col("internal")
    gain = F.col("link") + F.when(own, F.col("internal")).otherwise(0) - ki * (F.col("sigma") - F.when(own, ki).otherwise(0)) / F.lit(float(total))
    best = scored.withColumn("gain", gain).where("gain > 0").groupBy("id").agg(F.max(F.struct("gain", "near")).alias("b"))
    target = F.coalesce(F.col("b.near"), F.col("community"))
    allowed = target < F.col("community") if lower else target > F.col("community")
    out = state.join(best, "id", "left").withColumn("changed", allowed)
    return out.select("id", F.when(F.col("changed"), target).otherwise(F.col("community")).alias("community"), "k", "internal", "changed")


def louvain(edges: DataFrame, min_progress: int = 1, progress_counter: int = 1, rounds: int = 100, levels: int = 20) -> DataFrame:
    """(level, id, community): the Louvain communities of canonical weighted edges at every level, level 0 first.

    A vertex moves to the neighbouring community of the largest modularity
    gain, ties to the larger id; passes let it move to lower ids only, then to
    higher ids only, in turns, until progress stalls. Then communities become
    vertices whose inner weight counts twice. It ends where a level has too few
    passes or raises the modularity by no more than 0.001.
    """
    edges = written(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "edges")
    top = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")).select("id", F.col("id").alias("community"), "k", F.lit(0.0).alias("internal"), F.lit(False).alias("changed"))
    state = written(top, "louvain")
    origin = state.select("id", F.col("id").alias("node"))
    out, last_q, links, level = None, -1.0, written(both_ways(edges), "links"), 0
    while level < levels:
        total = state.agg(F.sum("k").alias("t")).first()["t"] or 0.0
        if not total:
            break
        updated, before, stop, count, even = -min_progress, 0, 0, 0, False
        while True:
            count, even = count + 1, not even
            state = written(_moved(state, links, total, even), "louvain")
            moved = state.where("changed").count()
            updated = moved if even else updated + moved
            if not even:
                stop += updated >= before - min_progress
                before = updated
            if stop > progress_counter or not (even or (updated > 0 and count < rounds)):
                break
        members = origin.join(state.select(F.col("id").alias("node"), "community"), "node").select("id", "community")
        members = written(members, "members")
        q = modularity(edges, members)
        one = members.select(F.lit(level).alias("level"), "id", "community")
        out = one if out is None else out.unionAll(one)
        if count // 2 <= 2 and level or q <= last_q + 0.001:
            break
        last_q, level = q, level + 1
        place = state.select("id", "community")
        a, b = place.withColumnsRenamed({"id": "src", "community": "ca"}), place.withColumnsRenamed({"id": "dst", "community": "cb"})
        merged = links.join(a, "src").join(b, "dst").groupBy("ca", "cb").agg(F.sum("weight").alias("weight"))
        inner = merged.where("ca = cb").select(F.col("ca").alias("id"), F.col("weight").alias("extra"))  # both directions: counted twice
        held = state.groupBy("community").agg(F.sum("internal").alias("held")).withColumnRenamed("community", "id")
        links = written(merged.where("ca <> cb").select(F.col("ca").alias("src"), F.col("cb").alias("dst"), "weight"), "links")
        k = links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
        fresh = held.join(inner, "id", "left").join(k, "id", "left")
        state = written(fresh.select("id", F.col("id").alias("community"), F.coalesce("k", F.lit(0.0)).alias("k"), (F.col("held") + F.coalesce("extra", F.lit(0.0))).alias("internal"), F.lit(False).alias("changed")), "louvain")
        origin = members.select("id", F.col("community").alias("node"))
    if out is None:
        return state.select(F.lit(0).alias("level"), "id", "community")
    return out


def _centres(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(id, community): where the communities start, by the order of (coefficient, degree, id).

    A vertex below a local maximum joins it if that is its highest neighbour. A
    vertex whose highest neighbour is below another one starts a community; all
    vertices next to such starts join the highest of them that is above them.
    """
    rank = F.struct("coefficient", "degree", "id")
    ranked = written(vertices.select("id", rank.alias("r")), "ranked")
    above = links.join(ranked.withColumnsRenamed({"id": "src", "r": "rs"}), "src").join(ranked.withColumnsRenamed({"id": "dst", "r": "rd"}), "dst").where("rd > rs").select("src", "dst", "rd")
    above = written(above, "above")
    best = written(above.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("rd", "dst"))["dst"].alias("best")), "best")
    second = best.join(best.select(F.col("id").alias("best"), F.lit(True).alias("below")), "best", "left")
    first = second.select("id", "best", F.coalesce("below", F.lit(False)).alias("starts"))
    first = written(ranked.select("id").join(first, "id", "left"), "first")
    starts = first.where("starts").select(F.col("id").alias("dst"))
    joined = above.join(starts, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.max(F.struct("rd", "dst"))["dst"].alias("start"))
    own = F.when(F.col("starts") | F.col("best").isNull(), F.col("id")).otherwise(F.col("best"))
    return first.join(joined, "id", "left").select("id", F.coalesce("start", own).alias("community"))


def _cohesion(state: DataFrame, edges: DataFrame, tri: DataFrame, stats: DataFrame) -> DataFrame:
    """state with wcc: how far each vertex closes its triangles inside its community."""
    c = lambda name: state.select(F.col("id").alias(name), F.col("community").alias(f"c_{name}"))
    inside = tri.join(c("a"), "a").join(c("b"), "b").join(c("c"), "c").where("c_a = c_b AND c_b = c_c")
    txc = inside.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("txc"))
    same = edges.join(c("src"), "src").join(c("dst"), "dst").where("c_src = c_dst")
    near = same.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("near"))
    full = state.join(txc, "id", "left").join(near, "id", "left").join(stats.select("community", "size"), "community").na.fill(0, ["txc", "near"])
    bottom = F.col("triangles") * (F.col("size") - 1 + F.col("degree") - F.col("near")).cast("double")
    wcc = F.when(bottom > 0, F.col("txc") * F.col("degree") / bottom).otherwise(0.0)
    return full.select("id", "community", "triangles", "degree", wcc.alias("wcc"))


def _total(state: DataFrame, vertices: int) -> float:
    per = state.groupBy("community").agg((F.count("*") * F.sum("wcc")).alias("x"))
    return float(per.agg(F.sum("x")).first()[0] or 0.0) / max(vertices, 1)


def _join_gain(w: float, n: int) -> Column:
    """Gain of total cohesion when a vertex with d_in edges into a community and d_out others joins it."""
    size, density, to, away = (F.col(c).cast("double") for c in ("size", "density", "d_in", "d_out"))
    rim = (F.col("external") - to) / size  # edges of a member across the boundary
    others = size - 1
    closed = others * (size - 2) * F.pow(density, 3)
    ratio = lambda top, bottom: F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
    met = density * (to - 1)
    linked = ratio((1 + rim + density * others) * met, (size + rim) * (closed + met + w * (away + rim * (rim - 1) * (1 + density))))
    unlinked = ratio(closed * (rim + density * others), (closed + rim * w * (rim - 1 + density * others)) * (size + rim) * (others + rim))
    shared = density * to * (to - 1)
    joining = ratio(shared * (to + away), (shared + w * away * (to + away - 1)) * (size + away))
    return (to * linked - (size - to) * unlinked + joining) / float(n)


def wcc_communities(edges: DataFrame, sigma: float = 0.001, rounds: int = 20, min_changed: int = 0) -> DataFrame:
    """(id, community) that raise the weighted community clustering of canonical edges.

    Edges outside triangles are left out, and so are vertices without any.
    Vertices start in communities around locally clustered centres and then, all
    at once in every round, leave theirs or move to a neighbour's, whichever
    gains most. It ends when the total gains no more than sigma, and keeps the
    communities before that round.
    """
    used = written(triangle_edges(edges).select("src", "dst"), "edges")
    tri = written(triangles(used), "triangles")
    links = written(both_ways(used), "links")
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    count = tri.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    vertices = written(count.join(degree, "id").withColumn("coefficient", F.col("degree") / F.col("triangles")), "vertices")
    n = vertices.count()
    members = written(_centres(vertices, links), "members")
    facts = vertices.select("id", "triangles", "degree")
    tasks = tasks_for(used.count())
    stats = written(community_stats(used, members, tasks), "stats")
    state = written(_cohesion(members.join(facts, "id"), used, tri, stats), "cohesion")
    total = _total(state, n)
    for _ in range(rounds):
        near = links.join(state.select(F.col("id").alias("dst"), F.col("community").alias("near")), "dst").groupBy(F.col("src").alias("id"), "near").agg(F.count("*").alias("d_in"))
        scored = near.join(state.select("id", "community", "degree"), "id").withColumn("d_out", F.col("degree") - F.col("d_in"))
        scored = scored.join(stats.withColumnRenamed("community", "near"), "near").withColumn("gain", _join_gain(total, n))
        own = F.col("near") == F.col("community")
        best = scored.groupBy("id").agg((-F.sum(F.when(own, F.col("gain")).otherwise(0.0))).alias("leave"), F.max(F.when(~own, F.struct("gain", "near"))).alias("b"))
        move = F.coalesce(F.col("leave") + F.col("b.gain"), F.lit(0.0))
        new = F.when((F.col("leave") > F.greatest(move, F.lit(0.0))), F.col("id")).when(move > 0, F.col("b.near")).otherwise(F.col("community"))
        next_members = written(state.join(best, "id", "left").select("id", new.alias("new"), "community"), "members")
        changed = next_members.where("new <> community").count()
        moved = next_members.select("id", F.col("new").alias("community"))
        next_stats = written(community_stats(used, moved, tasks), "stats")
        next_state = written(_cohesion(moved.join(facts, "id"), used, tri, next_stats), "cohesion")
        next_total = _total(next_state, n)
        if next_total - total <= sigma or changed <= min_changed:
            break
        state, stats, total = next_state, next_stats, next_total
    return state.select("id", "community")


def name_pairs(df: DataFrame, ident: str, names: str) -> DataFrame:
    """(ident, src, dst): all pairs of an array's elements, earlier one first."""
    pair = F.flatten(F.transform(names, lambda a, i: F.transform(F.slice(F.col(names), i + 2, F.size(names)), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return df.where(F.size(names) > 1).select(F.col(ident).alias(ident), F.inline(pair))


def export_nodes(members: DataFrame, dictionary: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(id, name, community): members with the names of their ids (null for unknown ones)."""
    return members.join(dictionary.select("id", "name"), "id", "left").select("id", "name", "community", *columns)
