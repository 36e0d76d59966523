"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted by one executor task on a bounded sample of the vectors
(TRAIN_ROWS, those with the smallest hash of the id; fewer if they would take
more than TRAIN_BYTES): every node of more vectors than a leaf may have is
split into BRANCH parts by Lloyd's iterations, until there is a leaf for about
every LEAF vectors of the whole table, or one for every FEWEST of the sample,
whatever is less. Every vector of the table is then placed in its leaf, so the
index has them all; leaves of a large table are larger.

A query walks the tree best bin first: a priority queue holds the nodes seen by
their centre's distance, and the nearest is opened until enough leaves are
visited. How many are enough is calibrated: for a sample of queries the true
neighbours are found by brute force over the whole table, and the number of
visits widens until the share of them in visited leaves reaches the target.

Queries meet the vectors in tasks of sibling leaves: a query is sent once to
each parent of leaves that it visits, with the list of them. A parent's queries
are cut into portions of QUERIES and its vectors into blocks of BLOCK, and each
portion meets each block in a task of its own. So a leaf of a third of all
vectors (copies of one, which no tree can tell apart) or a parent that all
queries ask for takes more tasks, not larger ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._frames import quoted
from gristmill.storage import written

K = 10
BRANCH = 16
LEAF = 256
ITERATIONS = 6
RECALL = 0.95
#: The tree is fitted on at most so many vectors and bytes of them; a leaf has FEWEST of them or more on average.
TRAIN_ROWS = 1 << 18
TRAIN_BYTES = 128 << 20
FEWEST = 8
#: Queries whose true neighbours calibrate the number of visits.
CALIBRATION = 400
#: Queries and vectors of one parent that one task compares.
QUERIES = 4096
BLOCK = 65536


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


@dataclass
class Tree:
    centres: np.ndarray  # (nodes, dimension); node 0 is the root
    children: dict[int, np.ndarray] = field(default_factory=dict)
    sizes: np.ndarray | None = None  # vectors of the table in every node, if it is a leaf

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector: always on to the nearest child."""
        at = np.zeros(len(x), np.int64)
        todo = np.arange(len(x)) if 0 in self.children else np.zeros(0, np.int64)
        while len(todo):
            order = todo[np.argsort(at[todo], kind="stable")]
            nodes, starts = np.unique(at[order], return_index=True)
            for node, rows in zip(nodes.tolist(), np.split(order, starts[1:])):
                kids = self.children[node]
                at[rows] = kids[_squared(x[rows], self.centres[kids]).argmin(1)]
            inner = np.fromiter((int(n) in self.children for n in at[todo]), bool, len(todo))
            todo = todo[inner]
        return at

    def leaves(self, q: np.ndarray, visits: int | None = None, least: int = 0) -> list[int]:
        """The first leaves in best-bin-first order (all of them without visits), more if these have fewer than least vectors."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (visits is None or len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            kids = self.children.get(node)
            if kids is None:
                out.append(node)
                held += 0 if self.sizes is None else int(self.sizes[node])
                continue
            d = self.centres[kids] - q
            for distance, kid in zip(np.einsum("ij,ij->i", d, d).tolist(), kids.tolist()):
                heapq.heappush(queue, (distance, kid))
        return out

    def parents(self) -> np.ndarray:
        """Parent of every node; the root's is itself."""
        out = np.zeros(len(self.centres), np.int64)
        for node, kids in self.children.items():
            out[kids] = node
        return out


def grow(x: np.ndarray, most: int, branch: int = BRANCH, iterations: int = ITERATIONS) -> Tree:
    """Tree over the rows of x, whose leaves have at most `most` rows unless these are all equal."""
    centres, children = [x.mean(0) if len(x) else np.zeros(x.shape[1], np.float32)], {}
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= most:
            continue
        own = x[rows]
        seeds = np.unique(own[np.linspace(0, len(own) - 1, 4 * branch).astype(int)], axis=0)
        if len(seeds) < 2:
            seeds = np.unique(own, axis=0)
        k = min(branch, len(seeds), max(2, -(-len(rows) // max(1, most))))
        if k < 2 or len(seeds) < 2:
            continue
        c = seeds[np.linspace(0, len(seeds) - 1, k).astype(int)].astype(np.float32)
        for _ in range(iterations):
            near = np.concatenate([_squared(own[a : a + 8192], c).argmin(1) for a in range(0, len(own), 8192)])
            n = np.bincount(near, minlength=len(c))
            order = np.argsort(near, kind="stable")
            c = np.add.reduceat(own[order].astype(np.float64), np.cumsum(n[n > 0]) - n[n > 0])
            c = (c / n[n > 0][:, None]).astype(np.float32)
        near = np.concatenate([_squared(own[a : a + 8192], c).argmin(1) for a in range(0, len(own), 8192)])
        kept = np.unique(near)
        if len(kept) < 2:
            continue
        children[node] = np.arange(len(centres), len(centres) + len(kept))
        for kid, part in zip(children[node].tolist(), kept.tolist()):
            centres.append(c[part])
            todo.append((kid, rows[near == part]))
    return Tree(np.array(centres, np.float32), children)


def build_tree(vectors: DataFrame, rows: int, dimension: int, leaf: int = LEAF) -> Tree:
    """Tree for a table of so many rows (h, id, vec), fitted on a sample of it; h is any hash that spreads the ids."""
    sample = min(rows, TRAIN_ROWS, max(1, TRAIN_BYTES // (4 * dimension)))
    leaves = max(1, min(rows // leaf, sample // FEWEST))
    if leaves < 2:
        return Tree(np.zeros((1, dimension), np.float32))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), _matrix(b.column(1))) for b in batches if len(b)]
        if parts:
            x = np.concatenate([p[1] for p in parts])[np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")]
            tree = grow(x, max(1, len(x) // leaves))
            nodes = np.repeat(np.array(list(tree.children), np.int64), [len(k) for k in tree.children.values()])
            kids = np.concatenate([*tree.children.values(), np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (tree.centres, nodes, kids)], names=["centres", "nodes", "kids"])

    chosen = vectors.orderBy("h", "id").limit(sample).select("h", "vec")
    (got,) = chosen.coalesce(1).mapInArrow(fitted, "centres binary, nodes binary, kids binary").collect()  # at most 1 / FEWEST of the sample's bytes and a little more
    nodes, kids = np.frombuffer(got["nodes"], np.int64), np.frombuffer(got["kids"], np.int64)
    first = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1]))) if len(nodes) else np.zeros(0, np.int64)
    return Tree(np.frombuffer(got["centres"], np.float32).reshape(-1, dimension), dict(zip(nodes[first].tolist(), np.split(kids, first[1:]))) if len(nodes) else {})


def _placer(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents = tree.value.parents()
        for batch in batches:
            if len(batch):
                leaf = tree.value.descend(_matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([pa.array(parents[leaf]), pa.array(leaf), *batch.columns], names=["parent", "leaf", "h", "id", "vec"])

    return run


def _nearest(q: np.ndarray, own, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every query the positions in x of its k nearest of another id, and their squared distances; ties by id."""
    step = max(1, (4 << 20) // max(1, len(x)))
    x = x.astype(np.float64)
    for a in range(0, len(q), step):
        d = _squared(q[a : a + step].astype(np.float64), x)
        d[own[a : a + step][:, None] == ids] = np.inf
        for row in d:
            pick = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
            pick = pick[np.isfinite(row[pick])]
            pick = pick[np.lexsort((ids[pick], row[pick]))][:k]
            yield pick, row[pick]


def _true_neighbours(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = queries.value
        for batch in batches:
            if not len(batch):
                continue
            ids = np.array(batch.column(1).to_pylist())
            leaf = batch.column(0).to_numpy()
            n, rows, distances = [], [], []
            for i, (pick, d) in enumerate(_nearest(q, own, _matrix(batch.column(2)), ids, k)):
                n += [i] * len(pick)
                rows.append(pick)
                distances.append(d)
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), batch.column(1).take(pa.array(at)), pa.array(leaf[at]), pa.array(np.concatenate(distances))], names=["q", "id", "leaf", "d"])

    return run


def calibrate(queries: DataFrame, placed: DataFrame, tree: Tree, kind: str, k: int = K, recall: float = RECALL, sample: int = CALIBRATION) -> int:
    """Leaf visits at which a sample of queries finds the share `recall` of its true neighbours."""
    rows = queries.orderBy("h", "id").limit(sample).select("id", "vec").toArrow()
    if not len(rows):
        return 1
    own, q = np.array(rows.column("id").to_pylist()), _matrix(rows.column("vec").combine_chunks())
    shared = placed.sparkSession.sparkContext.broadcast((own, q))
    near = placed.select("leaf", "id", "vec").mapInArrow(_true_neighbours(shared, k), f"q int, id {kind}, leaf bigint, d double")
    order = Window.partitionBy("q").orderBy("d", "id")
    truth = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "leaf").collect()
    place = [{leaf: i for i, leaf in enumerate(tree.leaves(v))} for v in q]
    ranks = np.array([place[r["q"]][r["leaf"]] for r in truth])
    visits = 1
    while len(ranks) and (ranks < visits).mean() < recall:
        visits += max(1, visits // 4)
    return visits


def _router(tree, visits: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents = tree.value.parents()
        for batch in batches:
            if not len(batch):
                continue
            rows, groups, leaves, ends = [], [], [], [0]
            for i, v in enumerate(_matrix(batch.column(2))):
                own = np.array(tree.value.leaves(v, visits, k + 1), np.int64)
                own = own[np.argsort(parents[own], kind="stable")]
                start = np.flatnonzero(np.concatenate(([True], parents[own][1:] != parents[own][:-1])))
                rows += [i] * len(start)
                groups += parents[own[start]].tolist()
                leaves.append(own)
                ends += (ends[-1] + np.append(start[1:], len(own))).tolist()
            taken = pa.array(np.array(rows, np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(leaves)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(groups, np.int64)), *(batch.column(c).take(taken) for c in range(3)), listed], names=["parent", "h", "id", "vec", "leaves"])

    return run


def _searcher(k: int):
    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        kind = queries.column("id").type
        out_id, out_near = [], []
        if len(queries) and len(vectors):
            own, ids = np.array(queries.column("id").to_pylist()), np.array(vectors.column("id").to_pylist())
            x, q = (_matrix(t.column("vec").combine_chunks()) for t in (vectors, queries))
            leaf = vectors.column("leaf").to_numpy()
            listed = queries.column("leaves").combine_chunks()
            asked, ends = listed.flatten().to_numpy(), np.cumsum(pc.list_value_length(listed).to_numpy())
            alike: dict[bytes, list[int]] = {}  # queries that visit the same leaves here are answered together
            for i, (start, end) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
                alike.setdefault(np.sort(asked[start:end]).tobytes(), []).append(i)
            for leaves, mine in alike.items():
                inside = np.flatnonzero(np.isin(leaf, np.frombuffer(leaves, np.int64)))
                here = ids[inside]
                for i, (pick, d) in zip(mine, _nearest(q[mine], own[mine], x[inside], here, k)):
                    out_id.append(own[i].item())
                    out_near.append([{"d": float(e), "id": here[p].item()} for p, e in zip(pick, d)])
        near = pa.list_(pa.struct([("d", pa.float64()), ("id", kind)]))
        return pa.table({"id": pa.array(out_id, kind), "near": pa.array(out_near, near)})

    return run


def nearest_neighbours(
    table: DataFrame, queries: str | None = None, k: int = K, recall: float = RECALL, ident: str = "vec_id", vector: str = "embedding", leaf: int = LEAF
) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the k nearest other vectors, by Euclidean distance, of every vector that is a query.

    queries: SQL condition on the table's columns that query rows fulfil; None
    makes every row a query. All rows are searched. Approximate: of the true
    neighbours about the share `recall` is found. Equal distances rank by id.
    Left out are rows with null id or vector, with null or non-finite elements,
    or of another length than most rows have; of rows with the same id the
    smallest vector counts, and one query row makes the id a query. With fewer
    than k + 1 vectors the lists are shorter, with one or none the result is
    empty.
    """
    kind = table.schema[ident].dataType.simpleString()
    asks = F.lit(True) if queries is None else F.coalesce(F.expr(queries), F.lit(False))
    usable = table.select(F.col(quoted(ident)).alias("id"), F.col(quoted(vector)).cast("array<float>").alias("vec"), asks.alias("asks")).where(
        "id IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e18)"
    )
    sizes = usable.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = max(1, sizes[0]["d"]) if sizes else 1
    distinct = usable.where(F.size("vec") == dimension).groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks"))
    vectors = written(distinct.select(F.xxhash64("id").alias("h"), "id", "vec", "asks"), "vectors")
    tree = build_tree(vectors, vectors.count(), dimension, leaf)
    shared = table.sparkSession.sparkContext.broadcast(tree)
    placed = written(vectors.select("h", "id", "vec").mapInArrow(_placer(shared), f"parent bigint, leaf bigint, h bigint, id {kind}, vec array<float>"), "placed")
    tree.sizes = np.zeros(len(tree.centres), np.int64)
    for r in placed.groupBy("leaf").count().toLocalIterator():  # at most as many as nodes
        tree.sizes[r["leaf"]] = r["count"]
    sized = table.sparkSession.sparkContext.broadcast(tree)
    asking = vectors.where("asks").select("h", "id", "vec")
    visits = calibrate(asking, placed, tree, kind, k, recall)
    routed = written(asking.mapInArrow(_router(sized, visits, k), f"parent bigint, h bigint, id {kind}, vec array<float>, leaves array<bigint>"), "routed")
    blocks = placed.groupBy("parent").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    portions = routed.groupBy("parent").agg(F.ceil(F.count("*") / QUERIES).alias("portions"))
    cuts = written(blocks.join(portions, "parent"), "cuts")  # a row a parent
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.col("h"), F.col(c))
    asked = routed.join(cuts, "parent").select("parent", part("portions").alias("portion"), every("blocks").alias("block"), "id", "vec", "leaves")
    held = placed.join(cuts, "parent").select("parent", every("portions").alias("portion"), part("blocks").alias("block"), "leaf", "id", "vec")
    keys = ("parent", "portion", "block")
    met = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_searcher(k), f"id {kind}, near array<struct<d: double, id: {kind}>>")
    best = met.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select(F.col("id").alias("vec_id"), F.posexplode("near").alias("pos", "n")).select(
        "vec_id", F.col("n.id").alias("neighbour_id"), (F.col("pos") + 1).alias("rank"), F.sqrt("n.d").alias("distance")
    )
