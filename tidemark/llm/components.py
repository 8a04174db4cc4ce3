"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, flat_labels, join_labels, releasing

#: Edges that one task contracts.
GROUP_EDGES = 1 << 17


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every vertex.

    ``edges`` has long columns ``a`` and ``b``; direction, repeats, self-loops and rows with a
    null end don't matter. Returns ``id, component`` for every vertex that has a link to another
    one; a vertex that has none isn't in the result. An empty edge list gives an empty table.

    Groups of a bounded number of edges are contracted first, each by itself. Then a round sends each vertex's larger neighbours to the smallest id it knows, then does the same
    for smaller neighbours. Minima are taken by partial aggregation and joins (which Spark can
    split), so a vertex with a third of all edges is no single task. Each round is checkpointed;
    rounds go on until one changes nothing, which takes the square of the logarithm of the vertices
    at most.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    e = cut(_contracted(e, e.count()).distinct())
    before = _state(e)
    while before[0]:
        e = cut(_small_star(_large_star(e)))
        now = _state(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _contracted(e: DataFrame, edges: int) -> DataFrame:
    """Stars of the components that the edges of each of some even groups make up by themselves: many
    links among few vertices become a few for each vertex before they are shuffled by vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = np.arange(len(ids))
            join_labels(label, at[: len(u)], at[len(u) :])
            root = ids[flat_labels(label)]
            apart = root != ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(root[apart])], ["u", "v"])

    return e.repartition(max(1, -(-edges // GROUP_EDGES))).mapInArrow(releasing(run), "u long, v long")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        e.select(F.col("v").alias("x"), F.col("u").alias("y"))
    )
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    return both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    kept = least.select("u", F.col("m").alias("v"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(moved).distinct()
