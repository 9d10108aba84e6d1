"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over the training time 0..1, piecewise linear between knots. Its integral, times all
tokens, is the source's cumulative token demand. The texts of a source stand in a random but fixed order; a text whose
tokens begin at c in that order is wanted when the demand reaches c, so inverting the demand gives its position, and
sorting by position (a range sort) gives the training order. A source whose demand exceeds its tokens goes through its
order again, at most as often as its cap allows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docloom.llm.encode import default_path, token_counts
from docloom.session import materialize

MAX_SOURCES = 10_000
#: How much the weight of the scarcest source may rise and fall over time around its share.
TILT = 0.5

Knots = list[tuple[float, float]]


@dataclass(frozen=True)
class Source:
    """What is wanted of a source, what it has, and when it comes."""

    name: str
    share: float
    max_repeats: int
    texts: int = 0
    tokens: int = 0
    largest: int = 0
    demand: float = 0.0
    knots: tuple = ((0.0, 1.0), (1.0, 1.0))


def read_targets(table: DataFrame) -> list[Source]:
    """The rows of ``source, target_share, max_repeats``; refused if there are too many, or a share is negative."""
    rows = table.select("source", "target_share", "max_repeats").where("source is not null").distinct().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES or len({r.source for r in rows}) < len(rows):
        raise ValueError("too many sources, or a source with several targets")
    if any((r.target_share or 0) < 0 or (r.max_repeats or 0) < 0 for r in rows):
        raise ValueError("negative shares or repeats")
    return sorted((Source(r.source, r.target_share or 0.0, r.max_repeats or 0) for r in rows), key=lambda s: s.name)


def plan_demand(sources: list[Source], total: int | None = None) -> list[Source]:
    """Token demand and schedule of every source.

    Shares are taken among the sources that have tokens, as an absent source can't contribute. Without ``total`` the mix
    is as large as it can be with exact shares; with it, a source gives at most its tokens times its repeats. Sources
    that are repeated more come later: their weight rises from start to end, that of the others falls, and the weights
    always sum to one."""
    there = [s for s in sources if s.tokens and s.share and s.max_repeats]
    whole = sum(s.share for s in there)
    if not there:
        return sources
    most = {s.name: s.tokens * s.max_repeats for s in there}
    size = total if total is not None else min(most[s.name] * whole / s.share for s in there)
    demand = {s.name: min(size * s.share / whole, most[s.name]) for s in there}
    epochs = {s.name: demand[s.name] / s.tokens for s in there}
    mean = sum(s.share / whole * epochs[s.name] for s in there)
    spread = max(abs(e - mean) for e in epochs.values()) or 1.0
    out = []
    for s in sources:
        tilt = TILT * (epochs[s.name] - mean) / spread if s.name in epochs else 0.0
        out.append(replace(s, demand=demand.get(s.name, 0.0), knots=((0.0, 1 - tilt), (1.0, 1 + tilt))))
    return out


def invert_demand(knots: Knots, parts: np.ndarray) -> np.ndarray:
    """The times at which the integral of a piecewise linear weight reaches ``parts`` of its whole."""
    t, w = (np.asarray(x, float) for x in zip(*knots))
    if len(t) < 2 or t[0] != 0 or t[-1] != 1 or (np.diff(t) <= 0).any() or (w < 0).any():
        raise ValueError("knots must rise from time 0 to time 1, with weights of 0 or more")
    area = np.concatenate([[0], np.cumsum(np.diff(t) * (w[1:] + w[:-1]) / 2)])
    if not area[-1]:
        raise ValueError("a schedule without weight")
    wanted = np.clip(parts, 0, 1) * area[-1]
    i = np.clip(np.searchsorted(area, wanted, "right") - 1, 0, len(t) - 2)
    slope, rest = (w[i + 1] - w[i]) / (t[i + 1] - t[i]), wanted - area[i]
    # the root of slope / 2 x^2 + w x = rest, in a form that holds for a slope of 0
    root = np.sqrt(np.maximum(w[i] ** 2 + 2 * slope * rest, 0))
    return np.clip(t[i] + np.where(rest > 0, 2 * rest / np.maximum(w[i] + root, 1e-300), 0), 0, 1)


def _positions(sources: list[Source]):
    table = {s.name: s.knots for s in sources}

    @F.arrow_udf(DoubleType())
    def position(names: pa.Array, parts: pa.Array) -> pa.Array:
        source, part = np.asarray(names.to_pylist(), object), parts.to_numpy(zero_copy_only=False)
        out = np.zeros(len(part))
        for name in set(source):
            out[source == name] = invert_demand(table[name], part[source == name])
        return pa.array(out)

    return position


def _lookup(sources: list[Source], values: dict[str, float], kind: str) -> Column:
    pairs = [x for s in sources for x in (F.lit(s.name), F.lit(values[s.name]).cast(kind))]
    return F.element_at(F.create_map(*pairs), F.col("source"))


def eligible_texts(df: DataFrame, sources: list[str], key: str, text: str, source: str, path: str | None = None, seed: int = 17) -> DataFrame:
    """Rows ``id, source, key, h, n`` of the different texts with tokens of the named sources: each belongs to the smallest
    of them that has it and is named by its smallest key there; ``h`` orders them, ``n`` counts tokens."""
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = rows.where(F.col("source").isin(sources)) if sources else rows.where("false")
    counted = rows.select(F.struct("source", "key").alias("name"), F.xxhash64("text", F.lit(seed)).alias("h"), F.unhex(F.md5("text")).alias("id"), token_counts(path or default_path())("text").alias("n"))
    texts = counted.groupBy("id").agg(F.min("name").alias("name"), F.min("h").alias("h"), F.min("n").alias("n"))
    # filtered only now: a filter on the counted column would count twice
    return texts.where("n > 0").select("id", "name.source", "name.key", "h", "n")


def mix_sources(df: DataFrame, targets: DataFrame, key: str, text: str, source: str, total: int | None = None, path: str | None = None, schedules: dict[str, Knots] | None = None, seed: int = 17) -> tuple[DataFrame, list[Source]]:
    """Rows ``position, source, key, copy, n_tokens`` in training order, and the plan they follow.

    ``position`` is the training time in 0..1. Equal texts are one text, of the smallest target source that has it, named
    by its smallest key there, so no text is used more often than ``max_repeats`` whatever its copies. Texts without a
    token (null and empty ones) and texts of no target source aren't used; null keys stay null; other columns are ignored.

    Running sums are taken within buckets of the hash order of a source, on top of the sums of the buckets before them
    (one row a source and bucket), so no task sees a whole source."""
    wanted = read_targets(targets)
    texts = materialize(eligible_texts(df, [s.name for s in wanted], key, text, source, path, seed), "texts")
    have = {r.source: r for r in texts.groupBy("source").agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"), F.max("n").alias("largest")).collect()}
    sources = [Source(s.name, s.share, s.max_repeats, have[s.name].texts, have[s.name].tokens, have[s.name].largest) if s.name in have else s for s in wanted]
    sources = plan_demand(sources, total)
    if schedules:
        sources = [replace(s, knots=tuple(schedules.get(s.name, s.knots))) for s in sources]
    used = [s for s in sources if s.demand]
    if not used:
        empty = texts.where("false")
        return empty.select(F.lit(0.0).alias("position"), "source", F.col("key").alias(key), F.lit(0).alias("copy"), F.col("n").alias("n_tokens")), sources

    buckets = min(1 << 16, max(64, sum(s.texts for s in sources) // 50_000))
    texts = texts.where(F.col("source").isin([s.name for s in used]))
    texts = texts.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(buckets)))
    sums = texts.groupBy("source", "bucket").agg(F.sum("n").alias("inside"))
    sums = sums.withColumn("before", F.sum("inside").over(Window.partitionBy("source").orderBy("bucket")) - F.col("inside")).drop("inside")
    within = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = texts.withColumn("upto", F.sum("n").over(within)).join(sums, ["source", "bucket"])
    middle = F.col("before") + F.col("upto") - F.col("n") / 2

    whole = _lookup(used, {s.name: float(s.tokens) for s in used}, "double")
    demand = _lookup(used, {s.name: s.demand for s in used}, "double")
    repeats = _lookup(used, {s.name: s.max_repeats for s in used}, "int")
    copies = placed.select("source", "key", "n", middle.alias("middle"), F.explode(F.sequence(F.lit(0), repeats - 1)).alias("copy"))
    copies = copies.withColumn("at", F.col("middle") + F.col("copy") * whole).where(F.col("at") <= demand)
    mixed = copies.select(_positions(used)("source", F.col("at") / demand).alias("position"), "source", F.col("key").alias(key), "copy", F.col("n").alias("n_tokens"))
    return mixed, sources


def shares(mixed: DataFrame, sources: list[Source]) -> DataFrame:
    """Rows ``source, target_share, actual_share, tokens, uses, most_uses, texts`` of every target source."""
    spark = mixed.sparkSession
    plan = spark.createDataFrame([(s.name, float(s.share), s.texts, s.tokens) for s in sources], "source string, target_share double, texts long, source_tokens long")
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), (F.max("copy") + 1).alias("most_uses"))
    rows = plan.join(F.broadcast(got), "source", "left").fillna(0, ["tokens", "uses", "most_uses"])
    all_tokens = F.sum("tokens").over(Window.partitionBy())
    share = F.coalesce(F.try_divide(F.col("tokens"), all_tokens), F.lit(0.0))
    return rows.select("source", "target_share", F.round(share, 6).alias("actual_share"), "tokens", "uses", "most_uses", "texts", "source_tokens")
