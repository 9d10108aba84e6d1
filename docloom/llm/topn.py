"""The best N items of every group by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(rows: DataFrame, keys: list[str], score: str, ids: list[str], n: int) -> DataFrame:
    order = [F.col(score).desc(), *(F.col(c).asc_nulls_last() for c in ids)]
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.where(F.col("__rank") <= n)


def top_n_per_group(df: DataFrame, group: str, score: str, ids: list[str], n: int, salts: int = 32, rank: str = "rank") -> DataFrame:
    """Rows ``group, score, *ids, rank``: the ``n`` items of highest score of every group, ties by smaller ``ids``.

    Stage one hashes every group into ``salts`` subgroups and keeps ``n`` of each; stage two ranks the survivors, at
    most ``n * salts`` a group. Both limits also run before their shuffle, so a group with a third of all rows costs
    no task more than its share. Repeated rows (same group, score and ids) count once; they are combined before the
    shuffle, on a key that spreads hot groups.

    Rows whose group or score is null, or whose score is NaN, don't count. Null ids are ranked last; an infinite score
    is a score; an empty table gives no rows. Other columns are ignored, whatever their names."""
    fields = [F.col(group).alias("__g"), F.col(score).alias("__s"), *(F.col(c).alias(f"__i{i}") for i, c in enumerate(ids))]
    names = [f"__i{i}" for i in range(len(ids))]
    rows = df.select(*fields).where("__g is not null and __s is not null")
    if dict(rows.dtypes)["__s"] in ("double", "float"):
        rows = rows.where(~F.isnan("__s"))
    rows = rows.distinct().withColumn("__salt", F.pmod(F.xxhash64(*names), F.lit(salts)))
    survivors = _ranked(rows, ["__g", "__salt"], "__s", names, n).drop("__rank")
    best = _ranked(survivors, ["__g"], "__s", names, n)
    out = [F.col("__g").alias(group), F.col("__s").alias(score), *(F.col(a).alias(c) for a, c in zip(names, ids))]
    return best.select(*out, F.col("__rank").alias(rank))
