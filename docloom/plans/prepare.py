"""From raw documents to everything a search needs, in steps that are skipped where their table is there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunking, corpus, graph, labels, splits


@dataclass(frozen=True)
class Step:
    name: str
    make: Callable[[], DataFrame]


class Preparation:
    """The steps over the tables of a folder; results are Parquet tables in another."""

    def __init__(self, spark: SparkSession, source: str, target: str, chunks: chunking.Chunking | None = None):
        self.spark, self.source, self.target = spark, source, target
        self.chunking = chunks or chunking.Chunking()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.source}/{name}.parquet")

    def made(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.target}/{name}")

    def steps(self) -> list[Step]:
        return [
            Step("clean", lambda: corpus.clean_records(self.read("raw_contexts"))),
            Step("duplicates", lambda: corpus.duplicate_groups(self.made("clean"))),
            Step("excluded", self.excluded),
            Step("corpus", lambda: corpus.exclude(self.made("clean"), "doc_id", self.made("excluded"))),
            Step("chunks", lambda: chunking.chunk_documents(self.made("corpus"), self.chunking)),
            Step("edges", lambda: graph.citation_edges(self.made("corpus"))),
            Step("groups", lambda: graph.leak_groups(self.questions(), self.made("duplicates"))),
            Step("split", self.split),
        ]

    def questions(self) -> DataFrame:
        return labels.labelled(self.read("train"))

    def excluded(self) -> DataFrame:
        """Empty documents, and the copies that no question needs."""
        kept = labels.keep_of_duplicates(self.made("duplicates"), self.questions()).where("keep is not null")
        copies = self.made("duplicates").join(kept, "group_key").where("doc_id <> keep").select("doc_id", F.lit("copy").alias("reason"))
        empty = self.made("clean").where("text = ''").select("doc_id", F.lit("empty").alias("reason"))
        return empty.unionByName(copies)

    def split(self) -> DataFrame:
        groups = self.made("groups")
        n = groups.count()
        return splits.split_questions(groups, splits.SplitPlan(n // 7, n // 20, n // 7))

    def exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def run(self, again: bool = False) -> list[str]:
        """Make what is missing (or all) and name what was made."""
        made = []
        for step in self.steps():
            if again or not self.exists(step.name):
                step.make().write.mode("overwrite").parquet(f"{self.target}/{step.name}")
                made.append(step.name)
        return made
