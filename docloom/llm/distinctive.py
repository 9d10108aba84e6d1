"""How distinctive a term is for a record: two-by-two contingency tables over the whole collection.

For every term of every record the table counts the term and the other terms, in the record and in the remaining
collection. The log-likelihood ratio of that table is the operator's score; the same row carries document frequency,
idf and tf * idf.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docloom.llm.words import accented_terms
from docloom.session import materialize

#: At most this many terms can each hold a share of 1 / HEAVY_TERMS of all rows; only those are broadcast.
HEAVY_TERMS = 20_000

#: Finds a character that isn't white space or zero-width.
VISIBLE = r"[^\s\x{a0}\x{ad}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"

_TERMS = ArrayType(StructType([StructField("term", StringType()), StructField("tf", IntegerType())]))
_ARROW_TERMS = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))


@F.arrow_udf(_TERMS)
def term_counts(texts: pa.Array) -> pa.Array:
    """The terms of each text with their occurrences; null texts have none."""
    offsets, terms, counts = [0], [], []
    for text in texts.to_pylist():
        found = Counter(accented_terms(text)) if text else {}
        terms.extend(found)
        counts.extend(found.values())
        offsets.append(len(terms))
    items = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def log_likelihood(a: Column, b: Column, c: Column, d: Column) -> Column:
    """G² of the table ((a, b), (c, d)), negative where the term is rarer in the record than elsewhere."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    total = _xlogx(a) + _xlogx(b) + _xlogx(c) + _xlogx(d) + _xlogx(a + b + c + d)
    g2 = F.greatest(F.lit(0.0), 2 * (total - _xlogx(a + b) - _xlogx(c + d) - _xlogx(a + c) - _xlogx(b + d)))
    return F.when(a * d >= b * c, g2).otherwise(-g2)


def score_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows ``key, term, tf, df, idf, tf_idf, llr`` for every term of every record.

    A record is a key with a text that isn't null or blank; of repeated rows (or several texts under one key) the
    smallest text counts. Records without a term count in N and give no rows; null keys count as one record. Extra
    columns are ignored.

    Terms held by a large share of the records would make hot keys in a join, so the statistics of those terms, at
    most ``HEAVY_TERMS`` by arithmetic, are broadcast and their rows never move; the others are joined by shuffle."""
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__text").rlike(VISIBLE))
    records = rows.groupBy("__key").agg(F.min("__text").alias("__text"))
    counted = records.select("__key", term_counts("__text").alias("terms"))
    counted = materialize(counted.withColumn("n", F.aggregate("terms", F.lit(0), lambda s, t: s + t["tf"])), "terms")
    totals = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum(F.size("terms")).alias("postings")).first()
    docs, tokens, postings = totals.docs or 0, totals.tokens or 0, totals.postings or 0

    postings_rows = counted.select("__key", "n", F.explode("terms").alias("t")).select("__key", "n", "t.term", "t.tf")
    stats = materialize(postings_rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "vocabulary")
    least = max(1, postings // HEAVY_TERMS)
    heavy = F.broadcast(stats.where(F.col("df") > least))
    light = stats.where(F.col("df") <= least)
    joined = postings_rows.join(heavy, "term").unionByName(postings_rows.join(F.broadcast(heavy.select("term")), "term", "left_anti").join(light, "term"))

    idf = F.log(1 + (F.lit(float(docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rest = F.col("cf") - F.col("tf")
    llr = log_likelihood(F.col("tf"), F.col("n") - F.col("tf"), rest, F.lit(tokens) - F.col("n") - rest)
    return joined.select(F.col("__key").alias(key), "term", "tf", "df", idf.alias("idf"), (F.col("tf") * idf).alias("tf_idf"), llr.alias("llr"))


def most_distinctive(scores: DataFrame, key: str, by: str = "tf_idf", least_df: int = 2) -> DataFrame:
    """Rows ``key, term``: per record the term of highest score ``by``, rounded to 6 decimals; ties go to the smaller
    term by code points. Terms in fewer than ``least_df`` records don't count; a record without other terms gives no
    row. The maximum is combined before the shuffle."""
    rows = scores.where(F.col("df") >= least_df)
    best = rows.groupBy(key).agg(F.min(F.struct((-F.round(by, 6)).alias("s"), F.col("term").alias("term"))).alias("b"))
    return best.select(key, F.col("b.term").alias("term"))
