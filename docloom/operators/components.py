"""Connected components of an edge table, without any of it on the driver.

Alternating large-star and small-star steps: every step rewires edges towards the smallest known neighbour, so the
number of rounds grows with the logarithm of the longest path, and hot nodes only meet map-side combined minima. Before
each round every partition contracts its own edges to stars, which leaves at most one row a node and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import discard, materialize


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of ``n`` numbered nodes over the edges ``a, b``."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars around their smallest nodes."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    ends = pa.Table.from_batches(held)
    nodes = pa.concat_arrays([c for name in ("a", "b") for c in ends[name].chunks]).dictionary_encode()
    order = pc.sort_indices(nodes.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    number = rank[nodes.indices.to_numpy()]
    label = _labels(number[: ends.num_rows], number[ends.num_rows :], len(order))
    names = nodes.dictionary.take(order)
    child = np.flatnonzero(label != np.arange(len(label)))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(child)), names.take(pa.array(label[child]))], ["a", "b"])


def _star(edges: DataFrame, keep: Column) -> DataFrame:
    """Link the neighbours that ``keep`` selects, and the node itself, to the smallest of node and neighbours."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("low"))
    smallest = smallest.select("u", F.least("u", "low").alias("m"))
    rewired = edges.join(smallest, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rewired.where("a <> b").distinct()


def _round(current: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = _star(both, F.col("v") > F.col("u"))
    down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("a"), F.col("m").alias("b"))
    return _star(down, F.lit(True)).union(lowest).where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """Rows ``node, component`` for every node of an edge; component is the smallest node reachable.

    Nulls and self-loops are ignored, repeated and reversed edges count once, no edges give no rows. The driver only
    sees one truth value per round: whether every node has one parent and no parent is a child."""
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    edge = pairs.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    kind = edge.schema["a"].dataType.simpleString()
    current = materialize(edge.mapInArrow(_contract, f"a {kind}, b {kind}"), "edges")
    for _ in range(max_rounds):
        roles = current.select(F.col("a").alias("node"), F.lit(1).alias("child")).union(current.select("b", F.lit(0)))
        odd = roles.groupBy("node").agg(F.sum("child").alias("parents"), F.min("child").alias("root")).where("parents > 1 or (parents = 1 and root = 0)")
        if odd.isEmpty():
            break
        previous, current = current, materialize(_round(current).mapInArrow(_contract, f"a {kind}, b {kind}"), "edges")
        discard(previous)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
