"""Small synthetic corpora for demonstrations and tests; made on the driver, from a seed."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

_TOPICS = {
    "740": ("hóa đơn điện tử", ["Điều 1. Huỷ hóa đơn điện tử đã lập sai.", "Điều 2. Người bán lập hóa đơn thay thế."], "Huỷ hóa đơn điện tử lập sai thế nào?"),
    "812": ("cơ sở dữ liệu dân cư", ["Điều 1. Cập nhật dữ liệu dân cư.", "Điều 2. Khai thác dữ liệu dân cư phải được phép."], "Ai được khai thác dữ liệu dân cư?"),
    "915": ("thu hồi đất", ["Điều 1. Thông báo thu hồi đất.", "Điều 2. Bồi thường khi thu hồi đất."], "Khi thu hồi đất có được bồi thường không?"),
}


def tiny(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Three documents in six chunks, and three questions with their gold documents."""
    chunks = [(f"{d}::{i:04d}", d, i, text) for d, (_, parts, _) in _TOPICS.items() for i, text in enumerate(parts)]
    questions = [(f"q{d}", q, [d]) for d, (_, _, q) in _TOPICS.items()]
    return (
        spark.createDataFrame(chunks, "chunk_id string, doc_id string, position int, text string"),
        spark.createDataFrame(questions, "qid string, question string, answer array<string>"),
    )


def synthetic(spark: SparkSession, documents: int = 60, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``documents`` documents with a question each, and a third as many without."""
    rng = random.Random(seed)
    names = [t for t, _, _ in _TOPICS.values()]
    chunks, questions = [], []
    for i in range(documents + documents // 3):
        doc, topic, number = str(1000 + i), rng.choice(names), rng.randint(10, 99)
        relevant = i < documents
        for position in range(2):
            text = f"Điều {position + 1}. Quy định về {topic} mã hồ sơ {number}{i}." if relevant else f"Văn bản khác số {number} về việc chung."
            chunks.append((f"{doc}::{position:04d}", doc, position, text))
        if relevant:
            questions.append((f"q{doc}", f"Quy định nào về {topic} mã hồ sơ {number}{i}?", [doc]))
    return (
        spark.createDataFrame(chunks, "chunk_id string, doc_id string, position int, text string"),
        spark.createDataFrame(questions, "qid string, question string, answer array<string>"),
    )
