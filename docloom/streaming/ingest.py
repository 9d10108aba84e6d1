"""Documents as they arrive: the batch expressions on a stream, and an idempotent append of what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import text as tx

SCHEMA = "id string, name string, link string, passage string, fetched_at timestamp"


def clean_stream(spark: SparkSession, folder: str, late: str = "30 days") -> DataFrame:
    """Rows ``doc_id, name, link, text, fetched_at`` of JSON files that arrive in a folder. A document delivered again
    within ``late`` of its time is dropped, so the state stays bounded."""
    raw = spark.readStream.schema(SCHEMA).json(folder).where("id is not null")
    once = raw.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["id"])
    return once.select(
        F.col("id").alias("doc_id"),
        F.trim(F.coalesce("name", F.lit(""))).alias("name"),
        F.lower(F.trim(F.coalesce("link", F.lit("")))).alias("link"),
        tx.clean(F.col("passage")).alias("text"),
        "fetched_at",
    )


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table, once for what is there now."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
