"""Splits of labelled questions that keep groups together, and the checks that they do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.statistics import shuffled_keys

NAMES = ("holdout", "error_pool", "dev", "train")
#: A split is planned on the driver over the sizes of groups, not their members; more groups than this are refused.
MAX_GROUPS = 2_000_000


@dataclass(frozen=True)
class SplitPlan:
    """Sizes of the parts that are filled in turn; train gets what is left."""

    holdout: int
    error_pool: int
    dev: int

    def size(self, name: str) -> int:
        return {"holdout": self.holdout, "error_pool": self.error_pool, "dev": self.dev}[name]


def fill(sizes: dict[str, int], plan: SplitPlan, seed: int = 42) -> dict[str, str]:
    """The part of every group: in seeded random order, the first part that it doesn't overfill. Skipping makes this a
    fold over the order; no window sum can express it."""
    filled, out = dict.fromkeys(NAMES, 0), {}
    for key in shuffled_keys(list(sizes), seed):
        part = next((n for n in NAMES[:-1] if filled[n] + sizes[key] <= plan.size(n)), "train")
        filled[part] += sizes[key]
        out[key] = part
    return out


def carve(sizes: dict[str, int], target: int, order: list[str]) -> list[str]:
    """Groups of exactly ``target`` questions: greedily in order, then filled up with single ones."""
    chosen, total = [], 0
    for key in order:
        if total + sizes[key] <= target:
            chosen.append(key)
            total += sizes[key]
    taken = set(chosen)
    for key in order:
        if total < target and key not in taken and sizes[key] == 1:
            chosen.append(key)
            total += 1
    if total != target:
        raise ValueError(f"{target} questions can't be reached exactly")
    return chosen


def nested(sizes: dict[str, int], targets: list[int], seed: int = 42) -> dict[int, list[str]]:
    """Subsets of several sizes, each within the next larger."""
    pool, out = shuffled_keys(list(sizes), seed), {}
    for target in sorted(targets, reverse=True):
        pool = carve(sizes, target, pool)
        out[target] = pool
    return out


def split_questions(groups: DataFrame, plan: SplitPlan, seed: int = 42) -> DataFrame:
    """Rows ``qid, group_id, part``. Only the sizes of the groups reach the driver."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n")).limit(MAX_GROUPS + 1).collect()
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    parts = fill({r.group_id: r.n for r in sizes}, plan, seed)
    table = groups.sparkSession.createDataFrame(list(parts.items()), "group_id string, part string")
    return groups.join(table, "group_id").select("qid", "group_id", "part")


def integrity(split: DataFrame) -> DataFrame:
    """One row of violations: questions in several parts, groups in several parts; and the size of every part."""
    by_question = split.groupBy("qid").agg(F.count_distinct("part").alias("p")).agg(F.count_if(F.col("p") > 1).alias("split_questions"))
    by_group = split.groupBy("group_id").agg(F.count_distinct("part").alias("p")).agg(F.count_if(F.col("p") > 1).alias("split_groups"))
    sizes = split.agg(*(F.count_if(F.col("part") == n).alias(n) for n in NAMES))
    return by_question.join(F.broadcast(by_group)).join(F.broadcast(sizes))


def exclude_questions(questions: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The questions that no row of ``broken`` (qid) names, and the others."""
    bad = broken.select("qid").distinct()
    return questions.join(bad, "qid", "left_anti"), questions.join(bad, "qid", "left_semi")


def not_nested(small: DataFrame, large: DataFrame) -> DataFrame:
    """Questions of a subset that its superset lacks."""
    return small.join(large, "qid", "left_anti")
