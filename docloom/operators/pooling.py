"""From chunk scores to document scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.bm25 import rank_within

_MEAN = re.compile(r"mean_top([1-9]\d*)$")


def check_pool(pool: str, tau: float = 1.0) -> str:
    if pool not in ("max", "sum", "logsumexp") and not _MEAN.match(pool):
        raise ValueError(f"unknown pooling {pool!r}")
    if pool == "logsumexp" and tau <= 0:
        raise ValueError("tau is above 0")
    return pool


def pool_documents(candidates: DataFrame, pool: str = "max", cap: int | None = None, tau: float = 1.0, top: int | None = None, decimals: int = 6) -> DataFrame:
    """Rows ``qid, doc_id, score, chunk_id, rank`` from candidates ``qid, chunk_id, doc_id, score``.

    ``cap`` keeps a question's best candidates before pooling (it changes results other than the maximum). ``mean_topN``
    averages over the chunks there are, up to N. ``chunk_id`` is the document's best chunk, the smallest of equal ones;
    equal documents rank by id."""
    check_pool(pool, tau)
    if cap is not None:
        candidates = rank_within(candidates, ["qid"], [F.col("score").desc(), F.col("chunk_id")], cap, "__rank").drop("__rank")
    score, keys = F.col("score"), ["qid", "doc_id"]
    if mean := _MEAN.match(pool):
        candidates = rank_within(candidates, keys, [score.desc(), F.col("chunk_id")], None, "__place")
        pooled = F.avg(F.when(F.col("__place") <= int(mean[1]), score))
    elif pool == "logsumexp":
        candidates = candidates.withColumn("__best", F.max("score").over(Window.partitionBy(*keys)))
        pooled = F.max("__best") + tau * F.log(F.sum(F.exp((score - F.col("__best")) / tau)))
    else:
        pooled = F.max(score) if pool == "max" else F.sum(score)
    best = F.min(F.struct((-score).alias("s"), F.col("chunk_id").alias("chunk_id")))
    rows = candidates.groupBy(*keys).agg(F.round(pooled, decimals).alias("score"), best.alias("b")).select(*keys, "score", "b.chunk_id")
    return rank_within(rows, ["qid"], [F.col("score").desc(), F.col("doc_id")], top)


def anchor_chunks(candidates: DataFrame, most: int = 3) -> DataFrame:
    """Rows ``qid, doc_id, chunk_ids``: a document's best chunks in order, joined by commas."""
    rows = rank_within(candidates, ["qid", "doc_id"], [F.col("score").desc(), F.col("chunk_id")], most, "place")
    lists = rows.groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))).alias("c"))
    return lists.select("qid", "doc_id", F.array_join(F.transform("c", lambda c: c["chunk_id"]), ",").alias("chunk_ids"))
