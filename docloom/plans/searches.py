"""Queries of whole searches and of what surrounds them: hybrids, predictions, titles, profiles, sweeps and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.tokens import Tokenizer
from docloom.operators import bm25, chunking, corpus, cutoff, fusion, graph, labels, metrics, pooling, splits, tuning
from docloom.plans import catalog as c
from docloom.plans import retrieval
from docloom.plans import sql as q
from docloom.plans.catalog import query
from docloom.session import materialize

# --- hybrids --------------------------------------------------------------------------------------------------------

ASKED = "SELECT qid, question AS text FROM eq WHERE question IS NOT NULL"
PIECES = "SELECT chunk_id AS item, doc_id AS doc, text FROM piece"


def _search(name: str, top: int, k1: float = 1.5, binary: bool = False) -> str:
    """A common table ``name`` with the best chunks of every question."""
    return f"{name} AS (WITH {q.bm25(ASKED, PIECES, k1=k1, top=top, binary=binary)} SELECT qid, item AS chunk_id, doc AS doc_id, score FROM hits)"


_TWO = f"{q.CHUNKS}, {q.EVAL}, {_search('wa', 60)}, {_search('wb', 60, 0.4, True)}"
SPEC = {"sources": {"a": {"type": "bm25", "candidate_chunks": 60}, "b": {"type": "bm25", "k1": 0.4, "qtf_mode": "binary", "pool": "sum", "candidate_chunks": 60}}, "weights": {"a": 2, "b": 3}, "rrf_k": 20, "depth": 40}


def _inputs(spark, d) -> retrieval.Inputs:
    return retrieval.Inputs(c.asked(spark, d).select("qid", "question"), c.pieces(spark, d))


def _rrf(sources: dict[str, float], item: str, k: int, absent: int | None = None) -> str:
    union = " UNION ALL ".join(f"SELECT qid, {item}, rank, CAST({w} AS DOUBLE) AS w FROM {n}" for n, w in sources.items())
    score = f"sum(w / ({k} + rank))" if absent is None else f"sum(w / ({k} + rank) - w / ({k} + {absent})) + {sum(sources.values())} / ({k} + {absent})"
    return f"SELECT qid, {item}, round({score}, 9) AS score FROM ({union}) GROUP BY ALL"


_HYBRID = f"""{_TWO}, {q.pooled('max(score)', 'pa', 'wa')}, {q.pooled('sum(score)', 'pb', 'wb')}, ra AS (SELECT * FROM pa WHERE rank <= 40), rb AS (SELECT * FROM pb WHERE rank <= 40),
    fu AS ({_rrf({'ra': 0.4, 'rb': 0.6}, 'doc_id', 20)}), an AS (SELECT qid, doc_id, chunk_id FROM (SELECT qid, doc_id, chunk_id, rank FROM ra UNION ALL SELECT qid, doc_id, chunk_id, rank FROM rb) QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank, chunk_id) = 1),
    hybrid AS (SELECT qid, doc_id, score, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM fu JOIN an USING (qid, doc_id) QUALIFY rank <= 10)"""


@query(f"WITH {_HYBRID} SELECT * FROM hybrid")
def hybrid_documents(spark, d):
    """Two retrievers that pool by themselves, fused on the level of documents with unequal weights; a document's anchor
    is its best chunk in the source that ranks it highest."""
    return retrieval.build(SPEC).search(_inputs(spark, d), 10)


@query(f"""WITH {_TWO}, ra AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM wa) WHERE rank <= 40), rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM wb) WHERE rank <= 40),
    fu AS ({_rrf({'ra': 0.4, 'rb': 0.6}, 'chunk_id', 20, 1000)}), tp AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 40), ch AS (SELECT tp.*, doc_id FROM tp JOIN (SELECT chunk_id, doc_id FROM piece) USING (chunk_id)),
    {q.pooled('max(score)', 'hc', 'ch')} SELECT * FROM hc WHERE rank <= 10""")
def hybrid_chunks(spark, d):
    """The same fused on the level of chunks, where a chunk that a source lacks counts as its 1,000th, then pooled."""
    return retrieval.build(SPEC | {"fuse_level": "chunk", "absent_rank": 1000}).search(_inputs(spark, d), 10)


_PREDICTED = f"""{_HYBRID}, mg AS (SELECT qid, rank AS k, score - lead(score) OVER (PARTITION BY qid ORDER BY rank) AS gap, max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid) AS dr FROM hybrid),
    mr AS (SELECT qid, min(CASE WHEN m > 0 AND m >= 0.4 THEN k END) AS k FROM (SELECT qid, k, CASE WHEN dr > 0 THEN round(gap / dr, 6) ELSE 0.0 END AS m FROM mg WHERE k < 5 AND gap IS NOT NULL) GROUP BY 1),
    cn AS (SELECT qid, least(coalesce(any_value(mr.k), 5), count(*)) AS n FROM hybrid LEFT JOIN mr USING (qid) GROUP BY qid),
    pred AS (SELECT qid, list(doc_id ORDER BY rank) AS answer FROM hybrid JOIN cn USING (qid) WHERE rank <= n GROUP BY qid)"""


def _predictions(spark, d):
    return retrieval.run({"retriever": SPEC, "calibrate": {"threshold": 0.4}}, _inputs(spark, d), 10)[1]


@query(f"WITH {_PREDICTED} SELECT qid, array_to_string(answer, ',') AS answer FROM pred")
def pipeline_predictions(spark, d):
    """The whole search: hybrid on the level of documents, cut at the first large gap of scores."""
    return _predictions(spark, d).select("qid", F.array_join("answer", ",").alias("answer"))


@query(f"""WITH {_PREDICTED}, al AS (SELECT DISTINCT qid FROM eval_questions), fl AS (SELECT qid, coalesce(answer, []) AS answer FROM al LEFT JOIN pred USING (qid))
    SELECT count(*) AS questions, count_if(len(answer) = 0)::BIGINT AS filled, (SELECT count(*) FROM al ANTI JOIN pred USING (qid)) AS missing_before, (SELECT count(*) FROM pred ANTI JOIN al USING (qid)) AS unknown, count_if(len(answer) > 5)::BIGINT AS too_many, count_if(len(answer) > len(list_distinct(answer)))::BIGINT AS repeated FROM fl""")
def submission_contract(spark, d):
    """Predictions against all questions, those without text included, before and after empty answers are filled in."""
    asked = labels.distinct_questions(c.table(spark, d, "eval_questions")).select("qid")
    found = _predictions(spark, d)
    before = metrics.submission_shape(found, asked).select(F.col("missing").alias("missing_before"), "unknown")
    filled = asked.join(found, "qid", "left").select("qid", F.coalesce("answer", F.array().cast("array<string>")).alias("answer"))
    shape = metrics.submission_shape(filled, asked).select(F.col("empty").alias("filled"), "too_many", "repeated")
    return asked.agg(F.count("*").alias("questions")).join(F.broadcast(before)).join(F.broadcast(shape))


# Scoring cases, gold and submitted documents with the recall and precision they must get.
SCORED = {
    "exact_single": (["100"], ["100"], 1, 1),
    "five_docs": (["100"], ["100", "2", "3", "4", "5"], 1, 0.2),
    "duplicates": (["100"], ["100", "100", "100"], 1, 0.333333),
    "two_gold_with_duplicate": (["100", "200"], ["100", "100", "200"], 1, 0.666667),
    "six_docs": (["1"], ["1", "2", "3", "4", "5", "6"], 0, 0),
    "exactly_five": (["1", "2", "3", "4", "5"], ["1", "2", "3", "4", "5"], 1, 1),
    "two_gold_partial": (["1", "2"], ["1", "7", "8", "9", "6"], 0.5, 0.2),
    "empty": (["1"], [], 0, 0),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({r} AS DOUBLE), CAST({p} AS DOUBLE))" for n, (_, _, r, p) in SCORED.items()) + ") t(qid, recall, precision)")
def scorer_cases(spark, d):
    """The scorer over cases whose results are given."""
    rows = spark.createDataFrame([(n, g, s) for n, (g, s, _, _) in SCORED.items()], "qid string, gold array<string>, answer array<string>")
    scored = metrics.score_rows(rows.select("qid", "answer"), rows.select("qid", F.col("gold").alias("answer")))
    return scored.select("qid", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


# --- titles ---------------------------------------------------------------------------------------------------------

_NOT_WORD = r"(?:[^\p{L}\p{N}_]|$)"
_STOP_AT = rf"(?s)(^|[^\p{{L}}\p{{N}}_])(?:Căn cứ|CĂN CỨ|Điều\s+1{_NOT_WORD}|ĐIỀU\s+1{_NOT_WORD}|Chương\s+I{_NOT_WORD}|CHƯƠNG\s+I{_NOT_WORD}|Xét đề nghị).*$"
_KINDS = "|".join(tx.DOCUMENT_KINDS)
_TITLES = rf"""{q.CORPUS}, hd AS (SELECT doc_id, substring(text, 1, 1500) AS h FROM corpus), cd AS (SELECT doc_id, regexp_extract(h, 'Số:\s*({tx.CODE})', 1) AS code, regexp_replace(h, '(?s)^.*?Số:\s*{tx.CODE}', '') AS a FROM hd),
    tl AS (SELECT doc_id, code, regexp_replace(regexp_replace(regexp_extract(a, '(?s)(?:{_KINDS}).*$', 0), '{_STOP_AT}', '\1'), '{tx.BOILERPLATE}', ' ', 'g') AS t FROM cd),
    nm AS (SELECT doc_id, code, trim(array_to_string(({q.words('t')})[1:30], ' '), ' .,;:-') AS n FROM tl),
    titles AS (SELECT doc_id, trim(CASE WHEN code <> '' THEN regexp_replace(code, '\s+', '', 'g') || ' ' || n ELSE n END) AS title FROM nm WHERE n <> '')"""


@query(f"WITH {_TITLES} SELECT * FROM titles")
def document_titles(spark, d):
    return graph.title_table(c.clean(spark, d))


_TITLED = f"""{_TITLES}, {q.CHUNKS}, tc AS (SELECT chunk_id, p.text, title, CASE WHEN title IS NULL THEN 'none' WHEN contains(substring(p.text, 1, 300), substring(title, 1, 40)) THEN 'there' ELSE 'added' END AS state FROM piece p LEFT JOIN titles USING (doc_id))"""


@query(f"WITH {_TITLED} SELECT chunk_id, md5(CASE WHEN state = 'added' THEN title || '. ' || text ELSE text END) AS text FROM tc")
def titled_chunks(spark, d):
    return corpus.with_titles(c.pieces(spark, d), graph.title_table(c.clean(spark, d))).select("chunk_id", F.md5("text").alias("text"))


@query(f"WITH {_TITLED} SELECT count(*) AS chunks, count_if(state = 'added')::BIGINT AS prepended, count_if(state = 'there')::BIGINT AS already_had, count_if(state = 'none')::BIGINT AS no_title, round(count_if(state = 'added') / count(*), 4) AS share_prepended, (SELECT count(*) FROM titles) AS documents_with_title FROM tc")
def title_statistics(spark, d):
    return corpus.title_statistics(c.pieces(spark, d), graph.title_table(c.clean(spark, d)))


@query(f"""WITH {q.BM25_CHUNKS}, {_TITLES}, tt AS (SELECT doc_id, unnest({q.tokens('title')}) AS term FROM titles) SELECT doc_id, count(*) AS terms, count(idf) AS known, round(avg(idf), 6) AS mean_idf FROM tt LEFT JOIN vocabulary USING (term) GROUP BY doc_id""")
def title_term_idf(spark, d):
    """How rare the words of a document's title are among the chunks."""
    index = bm25.build_index(c.pieces(spark, d))
    words = graph.title_table(c.clean(spark, d)).select("doc_id", F.explode(Tokenizer()(F.col("title"))).alias("term"))
    return words.join(index.terms, "term", "left").groupBy("doc_id").agg(F.count("*").alias("terms"), F.count("idf").alias("known"), F.round(F.avg("idf"), 6).alias("mean_idf"))


# --- profiles -------------------------------------------------------------------------------------------------------


@query(f"WITH {q.TRAIN}, w AS (SELECT len({q.words("coalesce(question, '')")}) AS w FROM tq) SELECT round(avg(CASE WHEN w > 0 THEN w END), 1) AS mean, min(CASE WHEN w > 0 THEN w END)::INT AS least, max(w)::INT AS most, count_if(w <= 2)::BIGINT AS short FROM w")
def question_lengths(spark, d):
    return labels.question_lengths(labels.distinct_questions(c.table(spark, d, "train")))


@query(r"""WITH f AS (SELECT source_file, bool_or(name IS NULL) AS n, bool_or(passage IS NOT NULL AND NOT regexp_matches(passage, '[^\s\x{a0}\x{3000}]')) AS p FROM raw_contexts WHERE source_file IS NOT NULL GROUP BY 1)
    SELECT count_if(n)::BIGINT AS missing_names, count_if(p)::BIGINT AS empty_passages, count_if(n AND p)::BIGINT AS both, round(100 * count_if(n AND p) / greatest(count_if(p), 1), 1) AS share_of_empty FROM f""")
def name_passage_overlap(spark, d):
    return corpus.name_passage_overlap(c.table(spark, d, "raw_contexts"))


@query(f"""WITH {c._DUPLICATES}, {q.LABELLED}, g AS (SELECT qid, unnest(answer) AS doc_id FROM labelled), lk AS (SELECT count(*) AS n FROM corpus WHERE link <> '' GROUP BY link HAVING count(*) > 1),
    m AS (SELECT qid, group_key, count(*) AS i, max(group_size) AS s FROM g JOIN groups USING (doc_id) GROUP BY ALL)
    SELECT (SELECT count(DISTINCT group_key) FROM groups) AS passage_groups, (SELECT count(*) FROM groups) AS passage_documents, (SELECT count(*) FROM lk) AS link_groups, (SELECT coalesce(sum(n), 0) FROM lk)::BIGINT AS link_documents,
    (SELECT count(*) FROM labelled WHERE len(answer) > 1) AS multi_answer_questions, (SELECT count(DISTINCT qid) FROM m WHERE i > 1) AS several_gold_in_a_group, (SELECT count(DISTINCT qid) FROM m WHERE i < s) AS questions_at_risk, round(100 * (SELECT count(DISTINCT qid) FROM m WHERE i < s) / (SELECT count(*) FROM labelled), 2) AS percent_at_risk""")
def duplicate_statistics(spark, d):
    rows = c.clean(spark, d)
    return labels.duplicate_statistics(c.train_labels(spark, d), corpus.duplicate_groups(rows), corpus.duplicate_links(rows))


@query(f"""WITH {q.LABELLED}, {q.CORPUS}, bad AS (SELECT DISTINCT qid FROM (SELECT qid, unnest(answer) AS doc_id FROM labelled) LEFT JOIN corpus USING (doc_id) WHERE text IS NULL OR text = '')
    SELECT labelled.qid, array_to_string(answer, ',') AS answer, bad.qid IS NOT NULL AS excluded FROM labelled LEFT JOIN bad USING (qid)""")
def dead_zone(spark, d):
    """Questions with a gold document that is missing or empty are set apart."""
    questions = c.train_labels(spark, d)
    kept, excluded = splits.exclude_questions(questions, labels.broken_gold(questions, c.clean(spark, d), short=1))
    rows = kept.withColumn("excluded", F.lit(False)).unionByName(excluded.withColumn("excluded", F.lit(True)))
    return rows.select("qid", F.array_join(F.array_sort("answer"), ",").alias("answer"), "excluded")


# --- sweeps and probes ----------------------------------------------------------------------------------------------


@query(f"""WITH {q.BOTH}, tb AS (SELECT qid, doc_id, score AS other FROM second WHERE rank <= 4) SELECT qid, doc_id, rank, coalesce(other, '-infinity'::DOUBLE) AS score, other IS NULL AS missing FROM ranking LEFT JOIN tb USING (qid, doc_id)""")
def scores_from(spark, d):
    """One ranking's order with another's scores; a document the other lacks gets minus infinity."""
    runs = c.two_runs(spark, d)
    return cutoff.scores_from(runs["ranking"], runs["second"].where("rank <= 4"))


CUTS = [0.1, 0.3, 0.5, 0.7, 0.9]


def _cut_sql(budget: float) -> str:
    counts = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS t, qid, count AS n FROM ({c._rule_sql('greatest(s1 - sl, 1e-12)', 'cascade', t)})" for t in CUTS)
    return f"""WITH {q.RANKING}, {q.GOLD}, al AS (SELECT 0.0::DOUBLE AS t, qid, least(count(*), 5)::INT AS n FROM ranking GROUP BY qid UNION ALL {counts}),
    sc AS (SELECT t, al.qid, any_value(al.n) AS n, any_value(len(g.answer)) AS g, count_if(list_contains(g.answer, r.doc_id)) AS h FROM al JOIN gold g USING (qid) JOIN ranking r ON r.qid = al.qid AND r.rank <= al.n GROUP BY t, al.qid),
    ev AS (SELECT t, round(avg(h / g), 6) AS recall, round(avg(h / n), 6) AS precision FROM sc GROUP BY t), base AS (SELECT recall AS r0 FROM ev WHERE t = 0)
    SELECT t, recall, precision, recall >= r0 - {budget} AS feasible, t = (SELECT arg_max(t, (precision, -t)) FROM ev CROSS JOIN base WHERE t > 0 AND recall >= r0 - {budget}) AS chosen FROM ev CROSS JOIN base WHERE t > 0"""


@query(_cut_sql(0.02))
def precision_under_budget(spark, d):
    """Recall and precision of a cut rule over a grid of thresholds; chosen is the highest precision whose recall is
    within the budget of submitting all five, the first of equal ones."""
    return cutoff.precision_under_budget(c.ranking(spark, d), c.gold(spark, d), CUTS, 0.02)


_WEIGHTS = [i / 10 for i in range(11)]


@query(f"""WITH {c._LISTS}, ws AS (SELECT unnest({_WEIGHTS}::DOUBLE[]) AS w), un AS (SELECT qid, doc_id, rank AS ra, NULL AS rb FROM ranking UNION ALL SELECT qid, doc_id, NULL, rank FROM second), dc AS (SELECT qid, doc_id, min(ra) AS ra, min(rb) AS rb FROM un GROUP BY ALL),
    fu AS (SELECT w, qid, doc_id, round(CASE WHEN ra IS NULL THEN 0 ELSE (1 - w) / (60 + ra) END + CASE WHEN rb IS NULL THEN 0 ELSE w / (60 + rb) END, 9) AS s, ra FROM dc CROSS JOIN ws),
    tl AS (SELECT w, qid, list(doc_id) AS l FROM (SELECT *, row_number() OVER (PARTITION BY w, qid ORDER BY s DESC, ra NULLS LAST, doc_id) AS r FROM fu) WHERE r <= 3 GROUP BY ALL),
    rc AS (SELECT ws.w, round(avg(len(list_intersect(coalesce(l, []), answer)) / len(answer)), 6) AS recall FROM gold CROSS JOIN ws LEFT JOIN tl ON tl.qid = gold.qid AND tl.w = ws.w GROUP BY ws.w)
    SELECT w, recall, w = (SELECT arg_max(w, (recall, -w)) FROM rc) AS chosen FROM rc""")
def weight_sweep(spark, d):
    """Two sources fused with every weight of the second from 0 to 1; the smallest of the best weights is chosen."""
    runs = c.two_runs(spark, d)
    return tuning.weight_sweep(runs["ranking"], runs["second"], c.gold(spark, d), _WEIGHTS, 3)


TOKENIZED = {"regex": "regex", "whitespace": "whitespace"}
_POOLED = {"max": "max(score)", "sum": "sum(score)"}


def _grid_sql() -> str:
    white = f"""list_filter(list_transform({q.words('lower(nfc_normalize(text))')}, lambda w: trim(w, '.,;:()[]{{}}"''“”‘’…-–—/\\!?*')), lambda w: w <> '')"""
    tables, parts = [], []
    for name, tokens in (("regex", None), ("whitespace", white)):
        tables.append(f"c_{name} AS (WITH {q.bm25(ASKED, PIECES, top=50, split=tokens)} SELECT qid, item AS chunk_id, doc AS doc_id, score FROM hits)")
        for pool, expression in _POOLED.items():
            tables.append(q.pooled(expression, f"p_{name}_{pool}", f"c_{name}"))
            parts.append(f"SELECT '{name}' AS tokenizer, '{pool}' AS pool, qid, list(doc_id) AS l FROM p_{name}_{pool} WHERE rank <= 5 GROUP BY qid")
    return f"""WITH {q.CHUNKS}, {q.GOLD}, {', '.join(tables)}, al AS ({' UNION ALL '.join(parts)}), gr AS (SELECT DISTINCT tokenizer, pool FROM al), ge AS (SELECT g.* FROM gold g SEMI JOIN eq USING (qid))
    SELECT gr.tokenizer, gr.pool, round(avg(len(list_intersect(coalesce(l, []), answer)) / len(answer)), 6) AS recall FROM ge CROSS JOIN gr LEFT JOIN al ON al.qid = ge.qid AND al.tokenizer = gr.tokenizer AND al.pool = gr.pool GROUP BY ALL"""


@query(_grid_sql())
def grid_tokenizers(spark, d):
    """Recall at 5 of every tokenizer and pooling, each index searched once."""
    pieces, asked = c.pieces(spark, d), c.asked(spark, d).select("qid", "question")
    gold = c.gold(spark, d).join(labels.distinct_questions(c.table(spark, d, "eval_questions")).select("qid"), "qid", "left_semi")
    out = None
    for name in TOKENIZED:
        tokenizer = Tokenizer(name, fold_tone=name != "whitespace")
        found = materialize(bm25.score_chunks(asked, bm25.build_index(pieces, tokenizer), tokenizer, top=50), "found")
        for pool in _POOLED:
            recall = metrics.recall_at(pooling.pool_documents(found.repartition("qid"), pool), gold, [5]).select(F.lit(name).alias("tokenizer"), F.lit(pool).alias("pool"), "recall")
            out = recall if out is None else out.unionByName(recall)
    return out


@query(f"""WITH {c._LISTS}, {c._ANSWER_EDGES}, pq AS (SELECT g.qid, answer, coalesce(l, [])[1:1] AS top1, coalesce(l, [])[1:3] AS top FROM gold g JOIN la USING (qid)), ms AS (SELECT * FROM pq WHERE len(list_intersect(top, answer)) = 0),
    nb AS (SELECT qid, list(DISTINCT e.t) AS near FROM (SELECT qid, unnest(top) AS d FROM ms) JOIN e ON e.s = d GROUP BY qid), n1 AS (SELECT qid, list(DISTINCT e.t) AS near1 FROM (SELECT qid, unnest(top1) AS d FROM ms) JOIN e ON e.s = d GROUP BY qid),
    ad AS (SELECT qid, len(list_filter(coalesce(near, []), lambda x: NOT list_contains(top, x))) AS n, len(list_intersect(coalesce(near, []), answer)) > 0 AS r, len(list_intersect(coalesce(near1, []), answer)) > 0 AS r1 FROM ms LEFT JOIN nb USING (qid) LEFT JOIN n1 USING (qid))
    SELECT (SELECT count(*) FROM pq) AS questions, (SELECT count(*) FROM pq) - count(*) AS hit, count_if(r)::BIGINT AS reach_any, count_if(r1)::BIGINT AS reach_top1, coalesce((list_sort(list(n)))[1 + len(list(n)) // 2], 0)::INT AS median_added FROM ad""")
def graph_reach(spark, d):
    """How many missed questions have a gold document one edge away from their first documents, or from the first."""
    return graph.reach_probe(c.ranking(spark, d), c.gold(spark, d), c.co_answered(spark, d), 3)


@query(f"""WITH {c._LISTS}, z AS (SELECT qid, len(list_filter(a.l[1:3], lambda x: NOT list_contains(b.l[1:3], x))) AS a_, len(list_filter(b.l[1:3], lambda x: NOT list_contains(a.l[1:3], x))) AS b_ FROM la a JOIN lb b USING (qid))
    SELECT qid, a_::INT AS only_a, b_::INT AS only_b, (a_ + b_)::INT AS symmetric FROM z""")
def list_differences(spark, d):
    return metrics.list_differences(*c.two_runs(spark, d).values(), 3)


@query(f"""WITH {c._ARTICLES}, al AS (SELECT * FROM corpus WHERE text <> '') SELECT (SELECT count(*) FROM al) AS documents, (SELECT count(*) FROM loose) AS chunks, (SELECT count(*) FROM al ANTI JOIN (SELECT doc_id FROM loose_l WHERE label <> '') USING (doc_id)) AS fallback""")
def chunking_summary(spark, d):
    return chunking.chunking_summary(c.clean(spark, d))


@query(rf"""WITH {c._EDGES}, {q.EVAL}, nm AS (SELECT DISTINCT qid, upper(unnest(regexp_extract_all(coalesce(question, ''), '{c._CITED}'))) AS code FROM eq) SELECT DISTINCT qid, doc_id FROM nm JOIN codes USING (code)""")
def cited_documents(spark, d):
    """Documents whose code a question names."""
    return graph.cited_by_question(labels.distinct_questions(c.table(spark, d, "eval_questions")), c.clean(spark, d))


@query(f"WITH {q.EVAL} SELECT qid, array_to_string(list_filter({q.tokens('coalesce(question, chr(32))')}, lambda t: length(t) >= 3), ' ') AS tokens FROM eq")
def tokens_of_three(spark, d):
    rows = labels.distinct_questions(c.table(spark, d, "eval_questions"))
    return rows.select("qid", F.array_join(Tokenizer(min_len=3)(F.col("question")), " ").alias("tokens"))


# --- contracts over planted violations ------------------------------------------------------------------------------

_RAW_TEXT = "SELECT CAST(id AS VARCHAR) AS doc_id, coalesce(link, '') AS link, coalesce(passage, '') AS text FROM raw_contexts"


@query(f"""WITH r AS ({_RAW_TEXT}) SELECT count(DISTINCT doc_id) AS documents, (SELECT count(*) FROM (SELECT doc_id FROM r GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, count_if(text = '')::BIGINT AS empty_texts,
    count_if(regexp_matches(text, '[\\r\\n\\t]|  '))::BIGINT AS unflattened, count_if(regexp_matches(link, '\\p{{Lu}}'))::BIGINT AS capital_links,
    count_if(regexp_matches(text, '(?i)({q.JUNK})'))::BIGINT AS leftovers, count_if(length(text) < 200 AND contains(lower(text), 'đăng nhập'))::BIGINT AS short_logins FROM r""")
def corpus_contract_raw(spark, d):
    """The contract of a clean corpus over the uncleaned one, which breaks it."""
    rows = c.table(spark, d, "raw_contexts").select(F.col("id").cast("string").alias("doc_id"), F.coalesce("link", F.lit("")).alias("link"), F.coalesce("passage", F.lit("")).alias("text"))
    return corpus.corpus_contract(rows)


@query(f"""WITH {q.RANKING}, pl AS (SELECT qid, CASE WHEN rank % 4 = 2 THEN 'same' ELSE doc_id END AS doc_id, CASE WHEN rank % 5 = 3 THEN -score ELSE score END AS score, CASE WHEN rank > 6 THEN rank + 1 ELSE rank END AS rank FROM ranking),
    ri AS (SELECT *, coalesce(score > lag(score) OVER (PARTITION BY qid ORDER BY rank), false) AS up FROM pl), p AS (SELECT qid, count(*) AS n, count(DISTINCT doc_id) AS d, count_if(up) AS u, max(rank) AS last FROM ri GROUP BY qid)
    SELECT count(*) AS questions, count_if(n > 4)::BIGINT AS too_long, count_if(n > d)::BIGINT AS repeated, coalesce(sum(u), 0)::BIGINT AS rising, count_if(n <> last)::BIGINT AS gaps FROM p""")
def ranking_contract_planted(spark, d):
    """The contract of a ranking where documents are repeated, scores negated and a rank left out."""
    rows = c.ranking(spark, d)
    rank = F.col("rank")
    planted = rows.select(
        "qid", F.when(rank % 4 == 2, "same").otherwise(F.col("doc_id")).alias("doc_id"), F.when(rank % 5 == 3, -F.col("score")).otherwise(F.col("score")).alias("score"), F.when(rank > 6, rank + 1).otherwise(rank).alias("rank")
    )
    return metrics.ranking_contract(planted, 4)


_PARTS = "CASE WHEN substring(md5(qid), 1, 1) IN ('0', '1', '2', '3') THEN 'dev' ELSE 'train' END"


_GROUPED = "SELECT qid, coalesce('group_' || root, qid) AS group_id FROM labelled LEFT JOIN g ON node = qid"
_SPLIT = f""", gr AS ({_GROUPED}), sp AS (SELECT qid, group_id, {_PARTS} AS part FROM gr UNION ALL SELECT qid, group_id, 'holdout' FROM gr WHERE substring(md5(qid), 1, 1) = '9')
    SELECT (SELECT count(*) FROM (SELECT qid FROM sp GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS split_questions, (SELECT count(*) FROM (SELECT group_id FROM sp GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS split_groups,
    count_if(part = 'holdout')::BIGINT AS holdout, count_if(part = 'error_pool')::BIGINT AS error_pool, count_if(part = 'dev')::BIGINT AS dev, count_if(part = 'train')::BIGINT AS train FROM sp"""


@query(c.SQL["leak_groups"].replace(_GROUPED, _SPLIT))
def split_integrity_planted(spark, d):
    """The integrity of a split that goes by questions instead of groups and has some of them twice."""
    groups = c.leak_groups(spark, d)
    first = F.substring(F.md5("qid"), 1, 1)
    split = groups.withColumn("part", F.when(first.isin("0", "1", "2", "3"), "dev").otherwise("train"))
    return splits.integrity(split.unionByName(groups.where(first == "9").withColumn("part", F.lit("holdout"))))


@query(f"""WITH {c._LISTS}, pr AS (SELECT s.qid, list_contains(g.answer, s.doc_id) AS is_gold, CASE WHEN s.rank = 2 THEN NULL ELSE s.score END AS score, s.rank FROM second s JOIN gold g USING (qid)), per AS (SELECT qid, max(CASE WHEN is_gold THEN score END) AS g, max(CASE WHEN NOT is_gold THEN score END) AS o FROM pr GROUP BY 1 HAVING g IS NOT NULL AND o IS NOT NULL)
    SELECT (SELECT count(*) FROM pr) AS scores, (SELECT count_if(rank = 2) FROM pr)::BIGINT AS not_numbers, (SELECT round(avg(score), 6) FROM pr) AS mean, (SELECT round(stddev_pop(score), 6) FROM pr) AS deviation, count(*) AS compared, round(avg(CASE WHEN g > o THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS win_rate FROM per""")
def rerank_probe_planted(spark, d):
    """The probe of a reranker that gives no number for every second document."""
    rows = c.ranking(spark, d, "sum").join(c.gold(spark, d), "qid")
    score = F.when(F.col("rank") == 2, F.when(F.xxhash64("qid") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("score"))
    return tuning.probe_scores(rows.select("qid", "doc_id", F.array_contains("answer", F.col("doc_id")).alias("is_gold"), score.alias("rerank_score")))


QUERIES, SQL = c.QUERIES, c.SQL
