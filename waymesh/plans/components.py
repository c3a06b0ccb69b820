"""Connected components of an edge table as a DataFrame fixpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.session import materialize


#: Pairs that are few enough to be joined in one task, some 10 MB; more are joined by rounds until they are.
FEW = 1 << 18


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return row["n"], row["h"]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, component) of all pairs (u, v) of a task."""
    rows = list(batches)
    if not rows:
        return
    pairs = pa.Table.from_batches(rows)
    nodes = pc.unique(pa.chunked_array([*pairs["u"].chunks, *pairs["v"].chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    root = union_pairs(len(nodes), *(pc.index_in(pairs[c], nodes).to_numpy() for c in "uv"))
    low = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(low)), nodes.take(pa.array(root[low]))], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """Rows (node, component) for every node that an edge joins to another one.

    The component is its smallest node. Each round hangs every node's larger
    neighbours, then its smaller ones, under the smallest of them (the large-star
    and small-star steps of Kiveris et al. 2014), until no pair changes or `few` pairs are
    left, which one task joins. Pairs are no more than edges and nodes. Minima are
    partially aggregated and the joins are plain equi-joins of materialized tables,
    so that a node with very many neighbours can be split at run time. Self-loops
    and rows with a null end are ignored; no edges give no rows.
    """
    pairs = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    kind = pairs.schema["u"].dataType.simpleString()
    before = _state(pairs)
    for _ in range(max_rounds):
        if before[0] <= few:
            return materialize(pairs.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"))
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        rest = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = _state(pairs)
        if after == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def union_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest item that each of `n` items is joined to by the pairs (a, b), within one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        while not np.array_equal(short := after[after], after):
            after = short
        if np.array_equal(after, root):
            return root
        root = after
