"""How many documents to return: gaps between scores, and thresholds on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.bm25 import rank_within

EPS = 1e-12
MODES = ("spread", "rel", "abs", "softmax")


def _lists(ranking: DataFrame) -> DataFrame:
    """Rows ``qid, scores``: scores in order of rank."""
    rows = ranking.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s"))
    return rows.select("qid", F.transform("s", lambda x: x["score"]).alias("scores"))


def rank_margins(ranking: DataFrame, max_count: int = 5, scale_rank: int = 10, decimals: int = 6) -> DataFrame:
    """Rows ``qid, k, margin`` for k below ``max_count``: the gap behind rank k as a share of the drop from rank 1 to
    rank ``scale_rank`` (or the last). A drop that isn't positive and finite gives margins of 0; one row gives none."""
    if scale_rank < 2:
        raise ValueError("scale_rank is at least 2")
    by_rank, whole = Window.partitionBy("qid").orderBy("rank"), Window.partitionBy("qid")
    rows = ranking.where(F.col("rank") <= scale_rank).select(
        "qid",
        F.col("rank").alias("k"),
        (F.col("score") - F.lead("score").over(by_rank)).alias("gap"),
        (F.max_by("score", -F.col("rank")).over(whole) - F.max_by("score", "rank").over(whole)).alias("drop"),
    )
    usable = (F.col("drop") > 0) & (F.col("drop") < float("inf"))
    margin = F.when(usable, F.round(F.col("gap") / F.when(usable, F.col("drop")), decimals)).otherwise(0.0)
    return rows.where((F.col("k") < max_count) & F.col("gap").isNotNull()).select("qid", "k", margin.alias("margin"))


def cut_at_first_margin(ranking: DataFrame, threshold: float, max_count: int = 5, min_count: int = 1, scale_rank: int = 10) -> DataFrame:
    """Rows ``qid, count``: the first k whose margin is positive and reaches the threshold, else ``max_count``; at most
    the rows there are."""
    hit = F.when((F.col("margin") > 0) & (F.col("margin") >= threshold), F.col("k"))
    first = rank_margins(ranking, max_count, scale_rank).groupBy("qid").agg(F.min(hit).alias("k"))
    sizes = ranking.groupBy("qid").agg(F.count("*").alias("size"))
    count = F.when(F.col("k").isNotNull(), F.greatest("k", F.lit(min_count))).otherwise(max_count)
    return sizes.join(first, "qid", "left").select("qid", F.least(count, "size").cast("int").alias("count"))


def mode_margins(scores: Column, mode: str, tau: float = 1.0) -> Column:
    """Gaps between neighbours of an ordered list, scaled by mode, with an infinite one at the end."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    size = F.size(scores)
    if mode == "softmax":
        best = F.array_max(scores)
        raised = F.transform(scores, lambda s: F.exp((s - best) / tau))
        total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
        scores, scale = F.transform(raised, lambda x: x / total), F.lit(1.0)
    elif mode == "abs":
        scale = F.lit(1.0)
    else:
        first = F.get(scores, F.lit(0))
        scale = F.greatest(first if mode == "rel" else first - F.get(scores, size - 1), F.lit(EPS))
    short = F.greatest(size - 1, F.lit(0))
    gaps = F.zip_with(F.slice(scores, F.lit(1), short), F.slice(scores, F.lit(2), short), lambda a, b: (a - b) / scale)
    return F.concat(gaps, F.array(F.lit(float("inf"))))


def cut_by_rule(ranking: DataFrame, threshold: float, rule: str = "cascade", mode: str = "spread", tau: float = 1.0, max_docs: int = 5, decimals: int = 9) -> DataFrame:
    """Rows ``qid, count``. Scores are cut to ``max_docs`` first. ``top1``: one document if the first gap is above the
    threshold, else all; ``cascade``: up to the first gap above it."""
    if rule not in ("top1", "cascade"):
        raise ValueError(f"unknown rule {rule!r}")
    rows = _lists(ranking.where(F.col("rank") <= max_docs)).withColumn("m", F.transform(mode_margins(F.col("scores"), mode, tau), lambda x: F.round(x, decimals)))
    if rule == "top1":
        count = F.when(F.get("m", F.lit(0)) > threshold, 1).otherwise(F.size("scores"))
    else:
        hits = F.filter(F.transform("m", lambda x, i: F.when(x > threshold, i + 1)), lambda x: x.isNotNull())
        count = F.coalesce(F.get(hits, F.lit(0)), F.lit(max_docs))
    return rows.select("qid", F.least(count, F.size("scores")).cast("int").alias("count"))


def predictions(ranking: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows ``qid, answer``: as many documents as counted, in order."""
    rows = ranking.join(counts, "qid").where(F.col("rank") <= F.col("count"))
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("a"))
    return lists.select("qid", F.transform("a", lambda x: x["doc_id"]).alias("answer"))


def threshold_grid(margins: DataFrame, points: int = 100) -> DataFrame:
    """Rows ``theta``: 0, every (n div points)-th of the observed margins in order, and a bit more than the largest.

    Margins lie in 0..1 at 6 decimals, so there are at most a million different ones to put in order."""
    seen = margins.select("margin").distinct()
    numbered = rank_within(seen.withColumn("__one", F.lit(1)), ["__one"], [F.col("margin")], None, "i")
    numbered = numbered.withColumn("step", F.greatest(F.floor(F.count("*").over(Window.partitionBy("__one")) / points), F.lit(1)))
    observed = numbered.where((F.col("i") - 1) % F.col("step") == 0).select(F.col("margin").alias("theta"))
    ends = seen.agg(F.max("margin").alias("m")).select(F.explode(F.array(F.lit(0.0), F.col("m") + 1e-9)).alias("theta"))
    return observed.union(ends).where("theta is not null").distinct()


def sweep_thresholds(ranking: DataFrame, gold: DataFrame, thetas: list[float], max_count: int = 5, scale_rank: int = 10, decimals: int = 6) -> DataFrame:
    """Rows ``theta, recall, precision, mean_count`` for each threshold. The margins are computed once; the thresholds
    are a stated list, spread over the questions' few margins."""
    margins = rank_margins(ranking, max_count, scale_rank)
    grid = F.explode(F.array(*(F.lit(float(t)) for t in thetas)))
    lists = margins.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("k", "margin"))).alias("m"))
    head = ranking.where(F.col("rank") <= max_count).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("d"))
    rows = head.join(lists, "qid", "left").join(gold, "qid").select("qid", "d", "answer", F.coalesce("m", F.array()).alias("m"), grid.alias("theta"))
    hits = F.filter("m", lambda x: (x["margin"] > 0) & (x["margin"] >= F.col("theta")))
    count = F.least(F.coalesce(F.get(hits, F.lit(0))["k"], F.lit(max_count)), F.size("d"))
    rows = rows.select("theta", "answer", count.alias("n"), F.transform(F.slice("d", F.lit(1), count), lambda x: x["doc_id"]).alias("p"))
    shared = F.size(F.array_intersect("p", "answer"))
    return rows.groupBy("theta").agg(
        F.round(F.avg(shared / F.size(F.array_distinct("answer"))), decimals).alias("recall"),
        F.round(F.avg(shared / F.col("n")), decimals).alias("precision"),
        F.round(F.avg("n"), decimals).alias("mean_count"),
    )


def fit_threshold(swept: DataFrame, budget: float) -> DataFrame:
    """One row: the smallest threshold whose recall is within ``budget`` of the best recall."""
    base = swept.agg(F.max("recall").alias("base"))
    return swept.join(F.broadcast(base), F.col("recall") >= F.col("base") - budget).agg(F.min("theta").alias("theta"))


def scores_from(ranking: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows ``qid, doc_id, rank, score, missing``: the order of one ranking with the scores of another; a document that the
    other lacks gets minus infinity."""
    other = scores.select("qid", "doc_id", F.col("score").alias("other"))
    rows = ranking.select("qid", "doc_id", "rank").join(other, ["qid", "doc_id"], "left")
    return rows.select("qid", "doc_id", "rank", F.coalesce("other", F.lit(float("-inf"))).alias("score"), F.col("other").isNull().alias("missing"))


def precision_under_budget(ranking: DataFrame, gold: DataFrame, thresholds: list[float], budget: float, rule: str = "cascade", mode: str = "spread", max_docs: int = 5, decimals: int = 6) -> DataFrame:
    """Rows ``t, recall, precision, feasible, chosen`` of a cut rule at each threshold: feasible if the recall is at most
    ``budget`` below that of submitting ``max_docs``, chosen if its precision is the highest of those (of equal ones the
    smallest threshold). The gaps are computed once; thresholds are a stated list."""
    head = ranking.where(F.col("rank") <= max_docs)
    lists = _lists(head).withColumn("m", F.transform(mode_margins(F.col("scores"), mode, 1.0), lambda x: F.round(x, 9)))
    documents = head.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("d"))
    grid = F.explode(F.array(F.lit(None).cast("double"), *(F.lit(float(t)) for t in thresholds)))
    rows = lists.join(documents, "qid").join(gold, "qid").select("d", "m", "answer", grid.alias("t"))
    hits = F.filter(F.transform("m", lambda x, i: F.when(x > F.col("t"), i + 1)), lambda x: x.isNotNull())
    count = F.coalesce(F.get(hits, F.lit(0)), F.size("d")) if rule == "cascade" else F.when(F.get("m", F.lit(0)) > F.col("t"), 1).otherwise(F.size("d"))
    rows = rows.withColumn("n", F.least(F.when(F.col("t").isNull(), F.size("d")).otherwise(count), F.size("d")))
    shared = F.size(F.array_intersect("answer", F.transform(F.slice("d", F.lit(1), F.col("n")), lambda x: x["doc_id"])))
    means = rows.groupBy("t").agg(F.round(F.avg(shared / F.size(F.array_distinct("answer"))), decimals).alias("recall"), F.round(F.avg(shared / F.col("n")), decimals).alias("precision"))
    base = means.where("t is null").select(F.col("recall").alias("base"))
    rows = means.where("t is not null").join(F.broadcast(base)).withColumn("feasible", F.col("recall") >= F.col("base") - budget)
    best = rows.where("feasible").agg(F.max_by("t", F.struct("precision", -F.col("t"))).alias("best"))
    return rows.join(F.broadcast(best)).select("t", "recall", "precision", "feasible", F.coalesce(F.col("t") == F.col("best"), F.lit(False)).alias("chosen"))
