"""The most similar vectors of every vector, by a permutation index.

A bounded sample of vectors serves as pivots. A vector is represented by its ``ORDER`` nearest pivots in order, and posted
in the inverted files of all pairs of its ``POSTED`` nearest: two similar vectors order the pivots alike and so meet in
some file. Candidates are ranked by the footrule distance of their orders, and those near enough are reranked by their
exact cosine. How near that is, is measured on pairs made from the pivots at just the least cosine wanted, so nothing is
cut by number: not files, not candidates. Only identifiers and orders are posted; vectors are fetched for candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from docloom.operators.tiles import meetings, whole_tiles
from docloom.session import discard, materialize

#: Nearest pivots in a vector's order, and of them those whose pairs it is posted under.
ORDER, POSTED = 24, 7
#: Pivots: about twice the square root of the vectors, between these bounds, so files stay as large as they are.
LEAST_PIVOTS, MOST_PIVOTS = 64, 2048
#: The share of pairs at just the least cosine whose footrule distance counts as near.
NEAR = 0.995
#: Vectors of a file that are compared at once.
TILE = 4096
_MADE = 16  # pairs made from each pivot


def _vector_keys(dim: int):
    """Column function: a hash of each usable vector; null for vectors that are null, of another length, hold a null or
    NaN, or are all zero."""

    @F.arrow_udf(BinaryType())
    def keys(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            x = None
            if v.is_valid and len(v) == dim and not v.values.null_count:
                x = np.asarray(v.values, np.float32)
                x = None if not np.isfinite(x).all() or not x.any() else x + np.float32(0)
            out.append(None if x is None else xxhash.xxh3_128_digest(x.tobytes()))
        return pa.array(out, pa.binary())

    return keys


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length."""
    x = vectors.flatten().to_numpy().astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, nearest first, the smaller number of equally near ones."""
    near = vectors @ pivots.T
    k = min(ORDER, len(pivots))
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.lexsort((top, -np.take_along_axis(near, top, 1)), axis=1)
    return np.take_along_axis(top, order, 1).astype(np.int16)


_PLACED = StructType([StructField("pairs", ArrayType(IntegerType())), StructField("perm", BinaryType())])


def _permutations(pivots: np.ndarray):
    """Column function: the files of each vector, and its order as bytes."""

    @F.arrow_udf(_PLACED)
    def nearest(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.struct([("pairs", pa.list_(pa.int32())), ("perm", pa.binary())]))
        found = _orders(_matrix(vectors, pivots.shape[1]), pivots)
        first = np.sort(found[:, : min(POSTED, found.shape[1])].astype(np.int32), axis=1)
        a, b = np.triu_indices(first.shape[1], 1)
        pairs = (first[:, a] << 16) | first[:, b]
        lists = pa.ListArray.from_arrays(np.arange(len(pairs) + 1, dtype=np.int32) * pairs.shape[1], pairs.ravel())
        return pa.StructArray.from_arrays([lists, pa.array([row.tobytes() for row in found], pa.binary())], ["pairs", "perm"])

    return nearest


def _weights(orders: np.ndarray, pivots: int) -> np.ndarray:
    """For every order how far each pivot stands before its end; 0 for pivots that it doesn't hold."""
    k = orders.shape[1]
    out = np.zeros((len(orders), pivots), np.int8)
    np.put_along_axis(out, orders.astype(np.int64), np.arange(k, 0, -1, dtype=np.int8)[None, :].repeat(len(orders), 0), 1)
    return out


def footrule(orders: np.ndarray, weights: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Footrule distances of orders ``i`` and ``j``: summed differences in rank, where a pivot that an order doesn't hold
    ranks behind its last. With weights w, that is sum(w) over both less twice the sum of the smaller ones."""
    k = orders.shape[1]
    there = weights[j[..., None], orders[i]]
    return k * (k + 1) - 2 * np.minimum(there, np.arange(k, 0, -1, dtype=np.int8)).sum(-1, dtype=np.int32)


def near_distance(pivots: np.ndarray, least: float) -> int:
    """The footrule distance within which ``NEAR`` of all pairs at a cosine of ``least`` lie, from such pairs made of the
    pivots and random directions."""
    rng = np.random.default_rng(29)
    x = np.repeat(pivots, _MADE, 0)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    cosine = min(max(least, -1.0), 1.0)
    orders = np.concatenate([_orders(v, pivots) for v in (x, cosine * x + math.sqrt(1 - cosine**2) * noise)])
    n = np.arange(len(x))
    return int(np.quantile(footrule(orders, _weights(orders, len(pivots)), n, n + len(x)), NEAR))


def _post(placed: DataFrame) -> DataFrame:
    """Rows ``tile, role, id, pair, perm``: every vector in the files of all pairs of its nearest pivots. A file is one
    tile, or a tile for every two of its blocks."""
    rows = placed.select("id", F.explode("pairs").alias("pair"), "perm")
    large = rows.groupBy("pair").agg(F.count("*").alias("size")).where(F.col("size") > TILE)
    large = materialize(large, "large")
    if large.isEmpty():
        return rows.select(F.col("pair").cast("long").alias("tile"), F.lit(0).alias("role"), "id", "pair", "perm")
    small = rows.join(large, "pair", "left_anti").select(F.col("pair").cast("long").alias("tile"), F.lit(0).alias("role"), "id", "pair", "perm")
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    dealt = rows.join(large, "pair").select("id", "pair", "perm", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    role = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return small.unionByName(dealt.select(F.xxhash64("pair", low, high).alias("tile"), role.alias("role"), "id", "pair", "perm"))


def _compare(batches: Iterator[pa.RecordBatch], pivots: int, posted: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows ``x, y, distance``: pairs of vectors of a file whose footrule distance is at most ``most``, each pair only in
    the first of the files it shares."""
    for table in whole_tiles(batches):
        tile, role, ids, pair = (table[c].to_numpy() for c in ("tile", "role", "id", "pair"))
        orders = np.frombuffer(b"".join(table["perm"].to_pylist()), np.int16).reshape(len(tile), -1)
        weights = _weights(orders, pivots)

        def possible(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return footrule(orders, weights, i, j) <= most

        for i, j in meetings(tile, role, possible):
            a, b = orders[i, :posted].astype(np.int32), orders[j, :posted]
            both = np.sort(np.where((a[:, :, None] == b[:, None, :]).any(2), a, 1 << 15), axis=1)
            first = (both[:, 0] << 16) | both[:, 1] == pair[i]
            i, j = i[first], j[first]
            x, y = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(footrule(orders, weights, i, j))], ["x", "y", "distance"])


def _cosine(dim: int):
    @F.arrow_udf(DoubleType())
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((_matrix(a, dim) * _matrix(b, dim)).sum(1)) if len(a) else pa.array([], pa.float64())

    return cosine


def most_similar(df: DataFrame, key: str, vector: str, dim: int = 64, k: int = 5, least: float = 0.85) -> DataFrame:
    """Rows ``key, neighbor_id, similarity``: for every usable vector up to ``k`` others of highest cosine, rounded to 6
    decimals and at least ``least``; ties go to the smaller id.

    Equal vectors are indexed once and share their neighbours, whatever their number; only the ``k + 1`` smallest ids of
    a group of copies are carried, as no more can ever be asked for. Vectors that are null, of another length, hold a
    null, NaN or infinity, or are all zero don't count; repeated rows count once, null keys don't; fewer than two usable
    vectors give no rows; other columns are ignored, whatever their names. Pivots are a hash sample of at most
    ``MOST_PIVOTS`` vectors, the only vectors that reach the driver."""
    rows = df.select(F.col(key).cast("string").alias("name"), F.col(vector).alias("embedding")).where("name is not null")
    # written before it is filtered: a filter on a function's result would run the function twice
    rows = materialize(rows.withColumn("key", _vector_keys(dim)("embedding")), "vectors").where("key is not null")
    alike = rows.groupBy("key").agg(F.min("embedding").alias("embedding")).withColumn("id", F.monotonically_increasing_id())
    alike = materialize(alike, "distinct")
    members = rows.groupBy("name").agg(F.min("key").alias("key")).join(alike.select("key", "id"), "key").select("name", "id")
    members = materialize(members, "members")
    count = alike.count()
    pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * math.isqrt(count)))
    sample = alike.orderBy(F.xxhash64("key", F.lit(23)), "key").limit(pivots).select("embedding").toArrow()
    found = members.where("false").select(F.col("id").alias("query"), F.col("id").alias("near"), F.lit(0.0).alias("sim"))
    if count > 1:
        matrix = _matrix(sample["embedding"].combine_chunks(), dim)
        posted = min(POSTED, len(matrix))
        placed = materialize(alike.select("id", _permutations(matrix)("embedding").alias("p")), "permutations")
        tiles = _post(placed.select("id", "p.*")).repartition("tile").sortWithinPartitions("tile")
        compare = partial(_compare, pivots=len(matrix), posted=posted, most=near_distance(matrix, least))
        near = tiles.mapInArrow(compare, "x long, y long, distance int")
        vectors = alike.select("id", "embedding")
        both = near.join(vectors.select(F.col("id").alias("x"), F.col("embedding").alias("ex")), "x")
        both = both.join(vectors.select(F.col("id").alias("y"), F.col("embedding").alias("ey")), "y")
        scored = materialize(both.select("x", "y", F.round(_cosine(dim)("ex", "ey"), 6).alias("sim")), "reranked").where(F.col("sim") >= least)
        discard(placed)
        found = scored.select(F.col("x").alias("query"), F.col("y").alias("near"), "sim").unionByName(scored.select(F.col("y").alias("query"), F.col("x").alias("near"), "sim"))

    order = Window.partitionBy("id").orderBy("name")
    heads = members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    heads = materialize(heads, "heads")
    near = found.join(heads.withColumnRenamed("id", "near"), "near")
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("sim").desc(), F.col("names")[0]))).where(F.col("n") <= k)
    spread = ranked.select("query", F.transform("names", lambda i: F.struct((-F.col("sim")).alias("s"), i.alias("name"))).alias("c"))
    others = spread.groupBy("query").agg(F.flatten(F.collect_list("c")).alias("others"))
    own = heads.select("id", F.transform("names", lambda i: F.struct(F.lit(-1.0).alias("s"), i.alias("name"))).alias("own"))
    lists = own.join(others.withColumnRenamed("query", "id"), "id", "left").select("id", F.when(F.col("others").isNull(), F.col("own")).otherwise(F.concat("own", "others")).alias("c"))
    lists = lists.where(F.size("c") > 1)
    result = members.join(lists, "id").select("name", F.slice(F.array_sort(F.filter("c", lambda x: x["name"] != F.col("name"))), 1, k).alias("c"))
    return result.select(F.col("name").alias(key), F.explode("c").alias("c")).select(key, F.col("c.name").alias("neighbor_id"), (-F.col("c.s")).alias("similarity"))
