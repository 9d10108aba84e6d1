"""Excerpts, tuning and the steps of preparation."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import excerpts, tuning
from docloom.plans.prepare import Preparation


def test_paragraphs():
    assert excerpts.split_paragraphs("") == [""]
    assert excerpts.split_paragraphs("a" * 250 + "\n\n" + "b" * 50 + "\n\n" + "c" * 180 + "\n\nd") == ["a" * 250, "b" * 50 + " " + "c" * 180, "d"]
    articles = "Mở đầu " + "x" * 200 + " Điều 1. " + "y" * 200 + " 2. QUY TẮC " + "z" * 200 + " điều 3. " + "t" * 2500
    assert [(p[:6], len(p)) for p in excerpts.split_paragraphs(articles)] == [("Mở đầu", 207), ("Điều 1", 208), ("2. QUY", 2000), ("t" * 6, 720)]
    assert [len(p) for p in excerpts.split_paragraphs("w" * 4500)] == [2000, 2000, 500]
    assert excerpts.split_paragraphs("ngắn\n\n" + "u" * 2100)[0] == "ngắn"
    assert excerpts.highlight("Thuế <b>", ["thuế"]) == "<mark>Thuế</mark> &lt;b&gt;"


def test_excerpts_equal_a_twin(spark):
    """By the definition: density of weighted keyword occurrences, only above 0, the head before all."""
    import math

    parts = [f"phần {i} " + ("thuế. " * (i % 4)) + "chung " * 60 for i in range(9)] + ["không có gì cả " * 20]
    corpus = spark.createDataFrame([("d", "\n\n".join(parts))], "doc_id string, text string")
    questions = spark.createDataFrame([("q", "Thuế phần nào?"), ("r", "xyz")], "qid string, question string")
    gold = spark.createDataFrame([("q", "d"), ("r", "d")], "qid string, doc_id string")
    rows = excerpts.excerpts(questions, gold, corpus).orderBy("place").collect()
    paragraphs = excerpts.split_paragraphs("\n\n".join(parts))
    forms = [p.replace(".", " ").split() for p in paragraphs]
    forms = [" ".join(f) for f in forms]
    words = ("thuế", "phần")  # nào is a stop word
    weight = {w: 1 / (1 + 10 * sum(w in f for f in forms) / len(forms)) for w in words}
    density = [sum(f.count(w) * len(w) * weight[w] for w in words) / (math.sqrt(len(f)) + 1) for f in forms]
    best = sorted(range(len(forms)), key=lambda i: -density[i])[:4]
    assert [(r.place, r.excerpt) for r in rows if r.qid == "q"] == [(-1, paragraphs[0][:600]), *((i, paragraphs[i]) for i in sorted(best) if density[i] > 0)]
    assert [r.place for r in rows if r.qid == "r"] == [-1]


def test_choice_and_cross_validation(spark):
    rows = [(w, k, f"q{i}", 1.0 if (w, k) == (0.4, 10) else 0.5) for w in (0.2, 0.4) for k in (10, 60) for i in range(20)]
    chosen = tuning.choose(spark.createDataFrame(rows, "w double, k int, qid string, recall double")).first()
    assert (chosen.w, chosen.k, chosen.report, chosen.optimism) == (0.4, 10, 1.0, 0.0)
    equal = spark.createDataFrame([(w, k, f"q{i}", 0.5) for w in (0.2, 0.4) for k in (10, 60) for i in range(20)], "w double, k int, qid string, recall double")
    assert tuple(tuning.choose(equal).first())[:2] == (0.4, 10)
    folds = tuning.cross_validate(equal.withColumnRenamed("w", "factor").where("k = 10"), "factor").collect()
    assert {(r.fold, r.factor) for r in folds} == {(0, 0.2), (1, 0.2)}


def test_probe_and_guard(spark):
    rows = [("a", "1", True, 0.9), ("a", "2", False, 0.1), ("b", "1", True, 0.2), ("b", "2", False, 0.3), ("c", "1", True, float("nan")), ("c", "2", False, float("inf"))]
    got = tuning.probe_scores(spark.createDataFrame(rows, "qid string, doc_id string, is_gold boolean, rerank_score double")).first()
    assert (got.scores, got.not_numbers, got.compared, got.win_rate, got["mean"]) == (6, 2, 2, 0.5, 0.375)
    assert tuning.guard_holdout("dev") == "dev" and tuning.guard_holdout("holdout", True) == "holdout"
    with pytest.raises(PermissionError):
        tuning.guard_holdout("holdout")


def test_preparation(spark, folder, tmp_path):
    work = Preparation(spark, folder, str(tmp_path))
    names = [s.name for s in work.steps()]
    assert work.run() == names and work.run() == []
    assert work.made("corpus").join(work.made("excluded"), "doc_id").count() == 0
    assert work.made("chunks").groupBy("chunk_id").count().where("count > 1").count() == 0
    assert work.made("split").agg(F.count_distinct("qid")).first()[0] == work.made("groups").count()
