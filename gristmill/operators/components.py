"""Connected components by union-find within partitions and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.storage import written

#: Edges that one task contracts.
EDGES_PER_TASK = 2_000_000


def union_find(pairs) -> dict:
    """Smallest member of the group of every node that occurs in pairs."""
    parent: dict = {}

    def root(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        ra, rb = root(a), root(b)
        if ra != rb:
            low, high = (ra, rb) if ra < rb else (rb, ra)
            parent[high] = low
    return {x: root(x) for x in parent}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = None

    def pairs():
        nonlocal kind
        for batch in batches:
            kind = batch.column(0).type
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    groups = union_find(pairs())
    if groups:
        yield pa.RecordBatch.from_arrays([pa.array(list(groups), kind), pa.array(list(groups.values()), kind)], names=["id", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every node of an edge; component is the group's smallest id.

    Edges are undirected; loops make a group of one, edges with a null end are
    left out, repeated edges do no harm. Every task replaces its edges by stars
    around the smallest id it knows; then each star edge goes to the tasks of
    both its ends, until no centre has a smaller neighbour. Every round is
    written to the shared folder, so lineage stays short.
    """
    kind = edges.schema[src].dataType.simpleString()
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    stars = written(ends.mapInArrow(_contract, f"id {kind}, component {kind}"), "components")
    tasks = max(1, -(-stars.count() // EDGES_PER_TASK))
    if tasks == 1:
        return stars.repartition(1).mapInArrow(_contract, stars.schema)
    while True:
        spokes = stars.where("id <> component")
        both = stars.unionAll(spokes.select(F.col("component").alias("id"), F.col("id").alias("component")))
        stars = written(both.repartition(tasks, "id").mapInArrow(_contract, stars.schema).distinct(), "components")
        spokes = stars.where("id <> component")
        torn = stars.groupBy("id").count().where("count > 1").select("id")
        chained = spokes.select("component").join(spokes.select(F.col("id").alias("component")), "component", "left_semi")
        if torn.unionAll(chained).isEmpty():
            return stars
