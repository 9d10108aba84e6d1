"""Exact search over vectors: blocks of queries against blocks of items."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.bm25 import rank_within
from docloom.operators.tiles import whole_tiles

#: Queries and items in a block, queries multiplied at once, and partitions over which the pairs of blocks are spread.
QUERY_BLOCK, ITEM_BLOCK, AT_ONCE, MOST_PARTS = 4096, 8192, 512, 20_000


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(vector: Column) -> Column:
    """The vector at unit length; null for a zero vector."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length))


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` numbers, none null or NaN, not all zero."""
    fit = (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fit, F.lit(False))


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    x = pa.concat_arrays(vectors.chunks)
    x = x.flatten().to_numpy().astype(np.float64).reshape(len(x), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _search_tiles(batches: Iterator[pa.RecordBatch], top: int, decimals: int) -> Iterator[pa.RecordBatch]:
    """The best items of a block for every query of a block."""
    for table in whole_tiles(batches):
        tiles = table["tile"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]]))
        for lo, hi in zip(starts, [*starts[1:], len(tiles)]):
            rows = table.slice(lo, hi - lo)
            n = int((rows["role"].to_numpy() == 0).sum())
            if not n or n == len(rows):
                continue
            queries, items = (np.array(x["id"].to_pylist(), object) for x in (rows.slice(0, n), rows.slice(n)))
            x, y = _unit(rows["embedding"].slice(0, n)), _unit(rows["embedding"].slice(n))
            for at in range(0, n, AT_ONCE):
                sims = np.round(x[at : at + AT_ONCE] @ y.T, decimals)
                sims[queries[at : at + AT_ONCE, None] == items[None, :]] = -np.inf
                keep = min(top, sims.shape[1])
                # everything that ties with the last place stays: ids decide later
                floor = np.partition(sims, -keep, axis=1)[:, -keep][:, None]
                q, i = np.nonzero((sims >= floor) & (sims > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(queries[q + at], pa.string()), pa.array(items[i], pa.string()), pa.array(sims[q, i])], ["qid", "item_id", "score"])


def search(queries: DataFrame, items: DataFrame, top: int = 5, decimals: int = 6) -> DataFrame:
    """Rows ``qid, item_id, score, rank``: for every query vector the ``top`` items of highest cosine; an item never
    finds itself (same id), ties go to the smaller id. Both tables are ``id, embedding`` with usable vectors.

    Queries and items are dealt to blocks by their hashes; every block of queries meets every block of items in a task,
    which passes on the best. No vector reaches the driver, and a task holds a block of each."""
    left, right = (t.select(F.col("id").cast("string").alias("id"), "embedding") for t in (queries, items))
    blocks = {"q": max(1, -(-left.count() // QUERY_BLOCK)), "i": max(1, -(-right.count() // ITEM_BLOCK))}
    own = lambda side: F.pmod(F.xxhash64("id"), F.lit(blocks[side])).alias(side)
    every = lambda side: F.explode(F.sequence(F.lit(0), F.lit(blocks[side] - 1))).alias(side)
    rows = left.select(own("q"), every("i"), F.lit(0).alias("role"), "id", "embedding").unionByName(right.select(every("q"), own("i"), F.lit(1).alias("role"), "id", "embedding"))
    tiles = rows.select((F.col("q") * blocks["i"] + F.col("i")).cast("long").alias("tile"), "role", "id", "embedding")
    tiles = tiles.repartition(min(blocks["q"] * blocks["i"], MOST_PARTS), "tile").sortWithinPartitions("tile", "role")
    found = tiles.mapInArrow(partial(_search_tiles, top=top, decimals=decimals), "qid string, item_id string, score double")
    return rank_within(found, ["qid"], [F.col("score").desc(), F.col("item_id")], top)


def require_match(chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """The vectors, or an error if a chunk has none, one belongs to no chunk, or one hasn't ``dim`` numbers."""
    a, b = chunks.select("chunk_id").distinct(), vectors.select("chunk_id", (F.size("embedding") == dim).alias("fits"))
    both = a.withColumn("c", F.lit(True)).join(b, "chunk_id", "full")
    found = both.agg(F.count_if(F.col("fits").isNull()).alias("without"), F.count_if(F.col("c").isNull()).alias("foreign"), F.count_if(~F.col("fits")).alias("unfit")).first()
    if any(found):
        raise ValueError(f"{found.without} chunks without vector, {found.foreign} vectors without chunk, {found.unfit} of another length")
    return vectors
