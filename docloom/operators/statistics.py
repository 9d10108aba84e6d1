"""Is a difference real: paired bootstrap, McNemar's test, samples and shares."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import chi_square_p
from docloom.operators.bm25 import rank_within
from docloom.session import materialize


def paired_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows ``qid, diff`` (b less a) of two tables ``qid, recall``; they must have the same questions."""
    both = a.select("qid", F.col("recall").alias("ra")).join(b.select("qid", F.col("recall").alias("rb")), "qid", "full")
    if both.where("ra is null or rb is null").limit(1).count():
        raise ValueError("the runs don't have the same questions")
    return both.select("qid", (F.col("rb") - F.col("ra")).alias("diff"))


def bootstrap_interval(diffs: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row ``mean, low, high``: the mean difference and its 95 % interval by a Poisson bootstrap.

    Every question enters every resample with a Poisson(1) weight. Questions of equal difference enter a resample with the
    sum of their weights, a Poisson number of their count, so what is spread over the resamples is the histogram of
    differences (few values, as recalls are shares of a few documents), not the questions."""
    counts = diffs.groupBy(F.round("diff", 12).alias("diff")).agg(F.count("*").alias("n"))
    rows = counts.select("diff", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    means = rows.mapInArrow(partial(_resampled, seed=seed), "b int, weighted double, weight double").groupBy("b")
    means = means.agg(F.try_divide(F.sum("weighted"), F.sum("weight")).alias("m")).where("m is not null")
    ordered = means.agg(F.array_sort(F.collect_list("m")).alias("m"))
    bounds = ordered.select(F.get("m", F.floor(F.size("m") * 0.025).cast("int")).alias("low"), F.get("m", F.floor(F.size("m") * 0.975).cast("int")).alias("high"))
    return diffs.agg(F.avg("diff").alias("mean")).join(F.broadcast(bounds))


def _resampled(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """A Poisson number for every difference, count and resample, the same wherever it is drawn."""
    for batch in batches:
        diff, n, b = (c.to_numpy() for c in batch.columns)
        keys = zip(diff.view(np.int64).tolist(), b.tolist())
        weight = np.array([np.random.default_rng([seed, d & 0xFFFFFFFF, (d >> 32) & 0xFFFFFFFF, r]).poisson(k) for (d, r), k in zip(keys, n.tolist())], float)
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(weight * diff), pa.array(weight)], ["b", "weighted", "weight"])


def mcnemar(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``wins, losses, ties, chi2, p_value`` of b against a by the questions whose recall rose or fell, with
    continuity correction; p is 1 where nothing differs."""
    both = a.select("qid", F.col("recall").alias("x")).join(b.select("qid", F.col("recall").alias("y")), "qid")
    counts = both.agg(F.count_if(F.col("y") > F.col("x")).alias("wins"), F.count_if(F.col("y") < F.col("x")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"))
    n = F.col("wins") + F.col("losses")
    chi2 = F.coalesce(F.try_divide(F.pow(F.abs(F.col("wins") - F.col("losses")) - 1, F.lit(2)), n), F.lit(0.0))
    return counts.withColumn("chi2", F.round(chi2, 6)).withColumn("p_value", F.round(chi_square_p(F.col("chi2")), 6))


def proportion_interval(rows: DataFrame, verdict: str) -> DataFrame:
    """Rows ``verdict, n, share, half_width``: shares with their normal 95 % half width."""
    counts = rows.groupBy(verdict).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    share = F.col("n") / total
    return counts.select(verdict, "n", F.round(share, 6).alias("share"), F.round(1.96 * F.sqrt(share * (1 - share) / total), 6).alias("half_width"))


def stable_order(key: str, seed: int = 42) -> Column:
    """A fixed random order: the hash of seed and key as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))


def stratified_sample(rows: DataFrame, key: str, stratum: str, size: int, seed: int = 42) -> DataFrame:
    """About ``size`` rows in proportion to the strata: rounded shares, the rest taken from or given to the largest
    stratum; within a stratum in a fixed random order."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    quota = counts.select(stratum, "n", F.floor(F.col("n") * size / total + 0.5).alias("q"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc(), F.col(stratum))).alias("place"))
    fixed = F.col("q") + F.when(F.col("place") == 1, size - F.sum("q").over(Window.partitionBy())).otherwise(0)
    quota = quota.select(stratum, fixed.alias("quota"))
    # no stratum needs more than the sample's size, so each is ranked in parts first and no task sorts a whole one
    parts = rows.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(64)))
    first = rank_within(parts, [stratum, "__salt"], [stable_order(key, seed), F.col(key)], size, "__place").drop("__salt", "__place")
    ordered = rank_within(first, [stratum], [stable_order(key, seed), F.col(key)], size, "place")
    return ordered.join(F.broadcast(quota), stratum).where(F.col("place") <= F.col("quota")).drop("place", "quota")


def random_sample(rows: DataFrame, key: str, size: int, without: list[DataFrame], seed: int = 42) -> DataFrame:
    """``size`` rows in a fixed random order, none whose key is in one of the other tables."""
    for other in without:
        rows = rows.join(other.select(key).distinct(), key, "left_anti")
    return rows.orderBy(stable_order(key, seed), key).limit(size)


def shard_bounds(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """Rows ``shard, first, last, n``: contiguous ranges of the ordered keys, the rest going to the first shards.

    Ranges of the keys are numbered by their sizes and then within, so no task orders all rows."""
    parts = rows.select(key).distinct().repartitionByRange(key).withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "ranges")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    placed = parts.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1).join(F.broadcast(before.drop("n")), "part")
    at, size, rest = F.col("i") + F.col("before"), F.floor(F.col("total") / shards), F.col("total") % shards
    small = F.greatest(size, F.lit(1))
    shard = F.when(at < rest * (size + 1), F.floor(at / (size + 1))).otherwise(rest + F.floor((at - rest * (size + 1)) / small))
    return placed.groupBy((shard + 1).cast("int").alias("shard")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))


def shuffled_keys(keys: list[str], seed: int = 42) -> list[str]:
    """Keys in the order of Python's seeded generator, for results that must equal earlier ones; driver side, for the
    few groups a split has."""
    out = sorted(keys)
    random.Random(seed).shuffle(out)
    return out
