"""Queries by name: the operators over whole tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.tokens import Tokenizer
from docloom.operators import bm25, chunking, components, corpus, cutoff, dense, excerpts, fusion, graph, labels, metrics, pooling, splits, statistics, tuning
from docloom.plans import sql as q
from docloom.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(statement: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if statement:
            SQL[function.__name__] = statement
        return function

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return readers.read_table(spark, d, name)


def clean(spark: SparkSession, d: str) -> DataFrame:
    return corpus.clean_records(table(spark, d, "raw_contexts"))


def pieces(spark: SparkSession, d: str) -> DataFrame:
    return readers.normalize_chunks(table(spark, d, "chunks").distinct())


def asked(spark: SparkSession, d: str) -> DataFrame:
    return labels.distinct_questions(table(spark, d, "eval_questions")).where("question is not null")


def train_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.labelled(table(spark, d, "train"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """All labelled questions."""
    parts = [labels.labelled(table(spark, d, t)).select("qid", F.array_sort("answer").alias("answer")) for t in ("train", "eval_questions")]
    return parts[0].unionByName(parts[1])


def ranking(spark: SparkSession, d: str, pool: str = "max") -> DataFrame:
    rows = table(spark, d, "ranking_rows").where(F.col("doc_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    return pooling.pool_documents(rows.select("qid", "doc_id", "score", "chunk_id").distinct(), pool)


# --- text -----------------------------------------------------------------------------------------------------------


@query(f"WITH {q.CORPUS} SELECT * FROM corpus")
def clean_corpus(spark, d):
    return clean(spark, d)


@query(f"""WITH {q.CORPUS} SELECT count(*) AS documents, CAST(0 AS BIGINT) AS repeated_ids, count_if(text = '')::BIGINT AS empty_texts,
    count_if(regexp_matches(text, '[\\r\\n\\t]|  '))::BIGINT AS unflattened, count_if(regexp_matches(link, '\\p{{Lu}}'))::BIGINT AS capital_links,
    count_if(regexp_matches(text, '(?i)({q.JUNK})'))::BIGINT AS leftovers, count_if(length(text) < 200 AND contains(lower(text), 'đăng nhập'))::BIGINT AS short_logins FROM corpus""")
def corpus_contract(spark, d):
    return corpus.corpus_contract(clean(spark, d))


@query(f"WITH {q.EVAL} SELECT qid, array_to_string({q.tokens('coalesce(question, chr(32))')}, ' ') AS tokens FROM eq")
def tokens_regex(spark, d):
    rows = labels.distinct_questions(table(spark, d, "eval_questions"))
    return rows.select("qid", F.array_join(Tokenizer()(F.col("question")), " ").alias("tokens"))


@query(f"""WITH {q.EVAL} SELECT qid, array_to_string(list_filter(list_transform({q.words("lower(nfc_normalize(coalesce(question, '')))")}, lambda w: trim(w, '.,;:()[]{{}}"''“”‘’…-–—/\\!?*')), lambda w: w <> ''), ' ') AS tokens FROM eq""")
def tokens_whitespace(spark, d):
    rows = labels.distinct_questions(table(spark, d, "eval_questions"))
    return rows.select("qid", F.array_join(Tokenizer("whitespace", fold_tone=False)(F.col("question")), " ").alias("tokens"))


@query(f"""WITH {q.EVAL}, seg AS (SELECT qid, i, regexp_extract_all(s, '{q.WORD}+') AS y FROM (SELECT qid, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT qid, regexp_split_to_array({q.folded("coalesce(question, '')")}, '[^\\p{{L}}\\p{{N}}_\\s]+') AS p FROM eq))),
    t AS (SELECT qid, i, list_concat(y, CASE WHEN len(y) > 1 THEN list_transform(range(1, len(y)), lambda k: y[k] || '_' || y[k + 1]) ELSE [] END) AS t FROM seg)
    SELECT qid, array_to_string(flatten(list(t ORDER BY i)), ' ') AS tokens FROM t GROUP BY qid""")
def tokens_bigram(spark, d):
    rows = labels.distinct_questions(table(spark, d, "eval_questions"))
    return rows.select("qid", F.array_join(Tokenizer("syllable_bigram")(F.col("question")), " ").alias("tokens"))


@query(f"""WITH {q.CORPUS}, w AS (SELECT len({q.words('text')}) AS w FROM corpus), s AS (SELECT list(w ORDER BY w) AS l, count(*) AS n FROM w)
    SELECT count(*) AS texts, round(avg(w), 6) AS mean, (SELECT l[1 + least(n - 1, CAST(floor(n * 0.5) AS BIGINT))] FROM s)::INT AS p50, (SELECT l[1 + least(n - 1, CAST(floor(n * 0.9) AS BIGINT))] FROM s)::INT AS p90,
    (SELECT l[1 + least(n - 1, CAST(floor(n * 0.95) AS BIGINT))] FROM s)::INT AS p95, (SELECT l[1 + least(n - 1, CAST(floor(n * 0.99) AS BIGINT))] FROM s)::INT AS p99, max(w)::INT AS longest,
    round(count_if(w > 256) / count(*), 6) AS above_256, round(count_if(w > 512) / count(*), 6) AS above_512 FROM w""")
def length_profile(spark, d):
    return corpus.length_profile(clean(spark, d))


@query(f"""WITH {q.CORPUS}, m AS (SELECT len(regexp_extract_all(' ' || text, '(?i)[^\\p{{L}}\\p{{N}}_]Điều\\s+\\d+')) AS m FROM corpus)
    SELECT count(*) AS texts, count_if(m > 0)::BIGINT AS marked, round(count_if(m > 0) / count(*), 6) AS share, round(avg(CASE WHEN m > 0 THEN m END), 6) AS mean_markers FROM m""")
def structure_profile(spark, d):
    return corpus.structure_profile(clean(spark, d))


@query(r"""WITH f AS (SELECT unnest(['name', 'link', 'passage']) AS field, unnest([name, link, passage]) AS v FROM raw_contexts)
    SELECT field, count_if(v IS NULL)::BIGINT AS missing, count_if(v IS NOT NULL AND NOT regexp_matches(v, '[^\s\x{a0}\x{3000}]'))::BIGINT AS empty FROM f GROUP BY field""")
def missing_fields(spark, d):
    return corpus.missing_fields(table(spark, d, "raw_contexts"))


@query(f"WITH {q.CORPUS} SELECT doc_id, len({q.words('text')})::INT AS words FROM corpus ORDER BY words DESC, doc_id LIMIT 10")
def longest_texts(spark, d):
    return corpus.longest_texts(clean(spark, d))


_LINK_FOLDERS = r"^[a-z]+://[^/]+/([a-z\-]+)/([a-z\-]+)/"
_LINK_DOMAIN = f"CASE WHEN regexp_matches(link, '{_LINK_FOLDERS}') THEN regexp_extract(link, '{_LINK_FOLDERS}', 1) || '/' || regexp_extract(link, '{_LINK_FOLDERS}', 2) ELSE '?' END"


@query(f"WITH {q.CORPUS} SELECT {_LINK_DOMAIN} AS domain, count(*) AS documents FROM corpus GROUP BY 1")
def link_domains(spark, d):
    return clean(spark, d).groupBy(tx.link_domain(F.col("link")).alias("domain")).agg(F.count("*").alias("documents"))


def _pollution_sql() -> str:
    words = ["đăng nhập", "mật khẩu", "quý khách", "rời quầy", "tài khoản của bạn"]
    cases = " ".join(f"WHEN contains(low, '{k}') THEN '{k}'" for k in words)
    known = " OR ".join(f"contains(low, '{k}')" for k in q.CRAWLER_LEFTOVERS)
    return f"""WITH {q.CORPUS}, t AS (SELECT doc_id, text, lower(text) AS low FROM corpus), f AS (SELECT *, CASE {cases} END AS keyword FROM t)
    SELECT doc_id, keyword, ({known}) AS known_pattern, substring(text, greatest(instr(low, keyword) - 60, 1), instr(low, keyword) + 150 - greatest(instr(low, keyword) - 60, 1)) AS context FROM f WHERE keyword IS NOT NULL"""


@query(_pollution_sql())
def pollution(spark, d):
    return corpus.pollution(clean(spark, d))


# --- duplicates and labels ------------------------------------------------------------------------------------------

_DUPLICATES = f"""{q.CORPUS}, keyed AS (SELECT doc_id, md5(lower(text)) AS group_key FROM corpus WHERE text <> ''),
    groups AS (SELECT doc_id, group_key, count(*) OVER (PARTITION BY group_key) AS group_size FROM keyed QUALIFY group_size > 1)"""


@query(f"WITH {_DUPLICATES} SELECT * FROM groups")
def exact_duplicates(spark, d):
    return corpus.duplicate_groups(clean(spark, d))


@query(f"WITH {q.CORPUS} SELECT link, count(*) AS documents FROM corpus WHERE link <> '' GROUP BY link HAVING count(*) > 1")
def duplicate_links(spark, d):
    return corpus.duplicate_links(clean(spark, d))


@query(f"""WITH {q.LABELLED}, {_DUPLICATES}, g AS (SELECT qid, unnest(answer) AS doc_id FROM labelled),
    m AS (SELECT qid, group_key, count(*) AS gold_members, max(group_size) AS group_size FROM g JOIN groups USING (doc_id) GROUP BY ALL)
    SELECT qid, group_key, gold_members, group_size, CASE WHEN gold_members > 1 THEN 'BOTH' ELSE 'PARTIAL' END AS kind FROM m QUALIFY row_number() OVER (PARTITION BY qid ORDER BY group_key) = 1""")
def gold_in_duplicates(spark, d):
    return labels.gold_in_duplicates(train_labels(spark, d), corpus.duplicate_groups(clean(spark, d)))


@query(f"""WITH {q.LABELLED}, {_DUPLICATES}, g AS (SELECT DISTINCT unnest(answer) AS doc_id, 1 AS g FROM labelled), j AS (SELECT group_key, groups.doc_id, g FROM groups LEFT JOIN g USING (doc_id))
    SELECT group_key, count(g) AS gold_members, CASE WHEN count(g) = 0 THEN arg_min(doc_id, lpad(CAST(length(doc_id) AS VARCHAR), 3, '0') || doc_id) WHEN count(g) = 1 THEN min(CASE WHEN g = 1 THEN doc_id END) END AS keep FROM j GROUP BY group_key""")
def keep_of_duplicates(spark, d):
    return labels.keep_of_duplicates(corpus.duplicate_groups(clean(spark, d)), train_labels(spark, d))


_STOP = "'" + "', '".join("là gì nào được của và có cho trong khi thì các những về với theo quy định như thế ai bao lâu nhiêu phải không này đó một người".split()) + "'"


@query(f"""WITH {q.LABELLED}, n AS (SELECT qid, answer, list_distinct(list_filter(string_split({q.question_key('question')}, ' '), lambda w: length(w) > 1)) AS words FROM labelled WHERE question IS NOT NULL),
    w AS (SELECT qid, unnest(words) AS word FROM n), s AS (SELECT word FROM w WHERE word NOT IN ({_STOP}) GROUP BY word HAVING count(*) BETWEEN 2 AND 200 AND count(*) <= (SELECT count(*) FROM n) * 0.02), b AS (SELECT * FROM w SEMI JOIN s USING (word)),
    p AS (SELECT DISTINCT x.qid AS qid_a, y.qid AS qid_b FROM b x JOIN b y USING (word) WHERE x.qid < y.qid),
    f AS (SELECT p.*, len(list_intersect(x.words, y.words)) AS i, len(x.words) + len(y.words) - len(list_intersect(x.words, y.words)) AS u, list_sort(x.answer) AS ga, list_sort(y.answer) AS gb FROM p JOIN n x ON x.qid = qid_a JOIN n y ON y.qid = qid_b)
    SELECT qid_a, qid_b, round(i / u, 3) AS similarity, CASE WHEN ga = gb THEN 'AGREE' WHEN len(list_intersect(ga, gb)) > 0 THEN 'NESTED' ELSE 'DISJOINT' END AS status FROM f WHERE i / u >= 0.3""")
def near_duplicate_questions(spark, d):
    return corpus.question_pairs(train_labels(spark, d).where("question is not null"), 0.3)


@query(f"""WITH {q.LABELLED}, n AS (SELECT qid, answer, list_distinct(list_filter(string_split({q.question_key('question')}, ' '), lambda w: length(w) > 1)) AS words FROM labelled WHERE question IS NOT NULL),
    w AS (SELECT qid, unnest(words) AS word FROM n), p AS (SELECT x.qid AS qid_a, y.qid AS qid_b, count(*) AS i FROM w x JOIN w y USING (word) WHERE x.qid < y.qid GROUP BY ALL),
    f AS (SELECT p.*, len(x.words) + len(y.words) - i AS u, list_sort(x.answer) AS ga, list_sort(y.answer) AS gb FROM p JOIN n x ON x.qid = qid_a JOIN n y ON y.qid = qid_b)
    SELECT qid_a, qid_b, round(i / u, 3) AS similarity, CASE WHEN ga = gb THEN 'AGREE' WHEN len(list_intersect(ga, gb)) > 0 THEN 'NESTED' ELSE 'DISJOINT' END AS status FROM f WHERE i / u >= 0.3""")
def all_near_duplicate_questions(spark, d):
    return corpus.all_question_pairs(train_labels(spark, d).where("question is not null"), 0.3)


@query(f"""WITH {q.TRAIN} SELECT coalesce(len(answer), 0)::INT AS answers, count(*) AS questions, least(coalesce(len(answer), 0), 5) / 5 AS ceiling FROM tq GROUP BY 1, 3""")
def answer_counts(spark, d):
    return labels.answer_counts(labels.distinct_questions(table(spark, d, "train")))


_KEYED = f"{q.LABELLED}, k AS (SELECT qid, {q.question_key('question')} AS question_key, array_to_string(list_sort(answer), '|') AS gold, answer FROM labelled WHERE regexp_matches(coalesce(question, ''), '[^\\s\\x{{a0}}\\x{{3000}}]'))"


@query(f"""WITH {_KEYED}, g AS (SELECT question_key, count(*) AS questions, count(DISTINCT gold) AS gold_sets FROM k GROUP BY 1 HAVING gold_sets > 1),
    s AS (SELECT question_key, max(n) AS most FROM (SELECT question_key, d, count(*) AS n FROM (SELECT question_key, unnest(answer) AS d FROM k) GROUP BY ALL) GROUP BY 1)
    SELECT question_key, questions, gold_sets, most < questions AS disjoint FROM g JOIN s USING (question_key)""")
def label_conflicts(spark, d):
    return labels.label_conflicts(train_labels(spark, d))


@query(f"""WITH {_KEYED}, g AS (SELECT count(*) AS n, count(DISTINCT gold) AS g FROM k GROUP BY question_key HAVING count(*) > 1 AND count(DISTINCT gold) = 1)
    SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM g""")
def consistent_surplus(spark, d):
    return labels.consistent_surplus(train_labels(spark, d))


@query(f"""WITH {q.LABELLED}, {q.CORPUS}, g AS (SELECT DISTINCT unnest(answer) AS doc_id, 1 AS g FROM labelled), b AS (SELECT g, c.doc_id AS c FROM g FULL JOIN corpus c USING (doc_id))
    SELECT count(g) AS gold, count_if(c IS NULL)::BIGINT AS orphans, count_if(g IS NULL)::BIGINT AS unused FROM b""")
def id_coverage(spark, d):
    return labels.id_coverage(train_labels(spark, d), clean(spark, d))


@query(f"""WITH {q.LABELLED}, {q.CORPUS}, g AS (SELECT qid, unnest(answer) AS doc_id FROM labelled)
    SELECT qid, doc_id, CASE WHEN text IS NULL THEN 'missing' ELSE 'short' END AS problem FROM g LEFT JOIN corpus USING (doc_id) WHERE text IS NULL OR length(text) < 200""")
def broken_gold(spark, d):
    return labels.broken_gold(train_labels(spark, d), clean(spark, d))


@query(f"""WITH {q.LABELLED}, {q.CORPUS}, g AS (SELECT qid, unnest(answer) AS doc_id FROM labelled),
    f AS (SELECT qid, doc_id, length(text) AS chars, length(text) < 2500 AS s, contains(upper(text), 'FILE ĐƯỢC ĐÍNH KÈM') OR contains(upper(text), 'FILE ĐÍNH KÈM') AS a FROM g JOIN corpus USING (doc_id))
    SELECT qid, doc_id, CAST(chars AS INT) AS chars, CASE WHEN s AND a THEN 'SHORT+ATTACH' WHEN s THEN 'SHORT' ELSE 'ATTACH' END AS flags FROM f WHERE s OR a""")
def suspicious_gold(spark, d):
    return labels.suspicious_gold(train_labels(spark, d), clean(spark, d))


@query(f"""WITH {q.LABELLED} SELECT doc_id, n FROM (SELECT doc_id, count(*) AS n FROM (SELECT unnest(answer) AS doc_id FROM labelled) GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 20) WHERE n >= 10""")
def overloaded_gold(spark, d):
    return labels.overloaded(metrics.gold_frequency(train_labels(spark, d)))


@query(f"""WITH {q.TRAIN}, {q.EVAL}, a AS (SELECT DISTINCT {q.question_key('question')} AS k FROM tq WHERE question IS NOT NULL), b AS (SELECT split, {q.question_key('question')} AS k FROM eq WHERE question IS NOT NULL)
    SELECT split, count(*) AS questions, count_if(a.k IS NOT NULL)::BIGINT AS also_in_train FROM b LEFT JOIN a USING (k) GROUP BY split""")
def exact_split_overlap(spark, d):
    """Questions of each split that stand in train word for word; near copies are found by the overlap operator."""
    train = labels.distinct_questions(table(spark, d, "train")).where("question is not null").select(tx.question_key(F.col("question")).alias("k")).distinct()
    rows = asked(spark, d).select("split", tx.question_key(F.col("question")).alias("k")).join(train.withColumn("t", F.lit(True)), "k", "left")
    return rows.groupBy("split").agg(F.count("*").alias("questions"), F.count("t").alias("also_in_train"))


@query(f"WITH {q.TRAIN}, {q.EVAL} SELECT count(*) AS train, (SELECT count(*) FROM eq) AS others, (SELECT count(*) FROM (SELECT qid FROM tq INTERSECT SELECT qid FROM eq)) AS shared FROM tq")
def shared_ids(spark, d):
    a, b = (labels.distinct_questions(table(spark, d, t)).select("qid") for t in ("train", "eval_questions"))
    shared = a.intersect(b).agg(F.count("*").alias("shared"))
    return a.agg(F.count("*").alias("train")).join(F.broadcast(b.agg(F.count("*").alias("others")))).join(F.broadcast(shared))


@query(f"WITH {q.CORPUS}, t AS (SELECT DISTINCT doc_id FROM corpus WHERE text = '') SELECT doc_id FROM t")
def empty_documents(spark, d):
    return clean(spark, d).where("text = ''").select("doc_id").distinct()


# --- chunks ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {q.CORPUS}, w AS (SELECT doc_id, text, {q.words('text')} AS w FROM corpus WHERE text <> ''),
    s AS (SELECT doc_id, text, w, unnest(CASE WHEN len(w) <= 256 THEN [0] ELSE range(0, CAST(ceil((len(w) - 256) / 192) AS BIGINT) + 1) END) AS k FROM w)
    SELECT doc_id, k::INT AS position, CASE WHEN len(w) <= 256 THEN text ELSE array_to_string(w[k * 192 + 1 : k * 192 + 256], ' ') END AS text FROM s""")
def chunk_windows(spark, d):
    return clean(spark, d).where("text <> ''").select("doc_id", F.posexplode(chunking.windows(F.col("text"), 256, 64)).alias("position", "text"))


def _articles_sql(name: str, start: str, after: str, reserve: bool) -> str:
    """Common tables down to ``name``: chunks of 256 words, overlapping by 64, cut at articles that begin with ``start``.
    RE2 looks neither back nor ahead, so a mark is set before every article, twice where two share what parts them."""
    outside, mark = r"[^\p{L}\p{N}_" + chr(1) + "]", chr(1)
    pattern = f"(?i)(^|{outside})({start})({after})"
    marked = "text"
    for _ in range(2):
        marked = f"regexp_replace({marked}, '{pattern}', '\\1{mark}\\2\\3', 'g')"
    size = f"CASE WHEN label <> '' THEN greatest(256 - len({q.words('tag')}), 1) ELSE 256 END" if reserve else "256"
    return f"""{name}_p AS (SELECT doc_id, list_filter(list_transform(string_split({marked}, '{mark}'), lambda p: trim(p)), lambda p: p <> '') AS ps FROM corpus WHERE text <> ''),
    {name}_s AS (SELECT doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS s FROM {name}_p), {name}_l AS (SELECT *, trim(regexp_extract(part, '{pattern}', 2)) AS label FROM {name}_s),
    {name}_z AS (SELECT *, '[' || label || ' - tiếp theo] ' AS tag, {q.words('part')} AS w FROM {name}_l), {name}_w AS (SELECT *, {size} AS size, CASE WHEN {size} > 64 THEN {size} - 64 ELSE {size} END AS step FROM {name}_z),
    {name}_k AS (SELECT *, unnest(CASE WHEN len(w) <= 256 THEN [0] ELSE range(0, CAST(ceil((len(w) - size) / step) AS BIGINT) + 1) END) AS k FROM {name}_w),
    {name}_t AS (SELECT *, CASE WHEN len(w) <= 256 THEN part ELSE array_to_string(w[k * step + 1 : k * step + size], ' ') END AS t FROM {name}_k),
    {name} AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, k) - 1 AS INT) AS position, CASE WHEN k = 0 OR label = '' OR starts_with(trim(t), label) THEN t ELSE tag || t END AS text FROM {name}_t)"""


_ARTICLES = f"{q.CORPUS}, {_articles_sql('loose', chr(272) + r'iều\s+\d+', r'[^\p{L}\p{N}_]|$', False)}, {_articles_sql('strict', chr(272) + r'iều\s+\d+\.\s', '', True)}"


@query(f"WITH {_ARTICLES} " + " UNION ALL ".join(f"SELECT printf('%s::%04d', doc_id, position) AS chunk_id, doc_id, position, text, '{s}' AS strategy FROM {s}" for s in ("loose", "strict")))
def chunk_articles(spark, d):
    """Both strategies of cutting at articles, with windows inside."""
    parts = [chunking.chunk_documents(clean(spark, d), chunking.Chunking(strategy=s)).withColumn("strategy", F.lit(s)) for s in chunking.MARKERS]
    return parts[0].unionByName(parts[1])


@query(r"""WITH c AS (SELECT chunk_id, min(doc_id) AS doc_id, count(*) AS n, count_if(NOT regexp_matches(coalesce(text, ''), '[^\s\x{a0}\x{3000}]')) AS blank FROM chunks GROUP BY chunk_id),
    p AS (SELECT doc_id, sum(n) AS n, count_if(n > 1) AS r, sum(blank) AS b, count_if(NOT regexp_matches(chunk_id, '^.+::[0-9]{4,}$')) AS m FROM c GROUP BY doc_id)
    SELECT sum(n)::BIGINT AS chunks, count(*) AS documents, sum(r)::BIGINT AS repeated_ids, sum(b)::BIGINT AS empty_texts, sum(m)::BIGINT AS malformed_ids, round(avg(n), 6) AS mean_chunks, max(n)::BIGINT AS most_chunks, min(n)::BIGINT AS least_chunks FROM p""")
def chunk_contract(spark, d):
    return chunking.chunk_contract(table(spark, d, "chunks"))


# --- retrieval ------------------------------------------------------------------------------------------------------


def candidates(spark, d, top: int = 50) -> DataFrame:
    index = bm25.build_index(pieces(spark, d))
    return bm25.score_chunks(asked(spark, d).select("qid", "question"), index, top=top)


def gathered(spark, d) -> DataFrame:
    """The candidates by question, so that pooling and ranking need no shuffle of their own."""
    return candidates(spark, d).repartition("qid")


@query(f"WITH {q.BM25_CHUNKS} SELECT qid, chunk_id, doc_id, score, rank FROM (SELECT qid, item AS chunk_id, doc AS doc_id, score, rank FROM hits)")
def bm25_chunks(spark, d):
    return candidates(spark, d)


@query(f"WITH {q.BM25_CHUNKS} SELECT term, df, round(idf, 6) AS idf FROM vocabulary")
def term_statistics(spark, d):
    return bm25.build_index(pieces(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {q.BM25_CHUNKS} SELECT (SELECT n FROM stats) AS chunks, (SELECT count(DISTINCT doc) FROM pt) AS documents, count(*) AS vocabulary, sum(df)::BIGINT AS postings, round((SELECT avgdl FROM stats), 6) AS mean_length FROM vocabulary")
def index_summary(spark, d):
    return bm25.index_summary(bm25.build_index(pieces(spark, d)))


@query(f"""WITH {q.BM25_CHUNKS}, o AS (SELECT term, idf AS stored FROM bm25_vocab WHERE idf IS NOT NULL)
    SELECT count(*) AS terms, count(v.term) AS fresh, count(o.term) AS stored, count_if(v.term IS NOT NULL AND o.term IS NOT NULL)::BIGINT AS both, round(avg(abs(v.idf - o.stored)), 6) AS mean_drift FROM vocabulary v FULL JOIN o USING (term)""")
def vocabulary_drift(spark, d):
    """An older index's idf against that of the chunks as they are."""
    fresh = bm25.build_index(pieces(spark, d)).terms.select("term", "idf", F.lit(1).alias("f"))
    stored = table(spark, d, "bm25_vocab").where("idf is not null").select("term", F.col("idf").cast("double").alias("stored"), F.lit(1).alias("s"))
    both = fresh.join(stored, "term", "full")
    return both.agg(F.count("*").alias("terms"), F.count("f").alias("fresh"), F.count("s").alias("stored"), F.count_if(F.col("f").isNotNull() & F.col("s").isNotNull()).alias("both"), F.round(F.avg(F.abs(F.col("idf") - F.col("stored"))), 6).alias("mean_drift"))


@query(f"""WITH {q.BM25_CHUNKS}, t AS (SELECT a.qid, a.term, v.idf FROM asked a LEFT JOIN vocabulary v USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(idf, 6) DESC, term) AS n FROM t WHERE idf IS NOT NULL)
    SELECT qid, coalesce((SELECT string_agg(term, ' ' ORDER BY n) FROM r WHERE r.qid = t.qid AND n <= 5), '') AS known, coalesce(string_agg(CASE WHEN idf IS NULL THEN term END, ' ' ORDER BY term), '') AS unknown FROM t GROUP BY qid""")
def explain_questions(spark, d):
    return bm25.explain_questions(asked(spark, d).select("qid", "question"), bm25.build_index(pieces(spark, d)))


def _pool_query(name: str, pool: str, expression: str, extra: str = "", source: str = "cand"):
    def run(spark, d):
        return pooling.pool_documents(gathered(spark, d), pool, decimals=8)

    run.__name__ = name
    query(f"WITH {q.BM25_CHUNKS}{extra}, {q.pooled(expression, 'docs', source, 8)} SELECT qid, doc_id, score, chunk_id, rank FROM docs")(run)


_pool_query("pool_max", "max", "max(score)")
_pool_query("pool_sum", "sum", "sum(score)")
_pool_query("pool_mean_top2", "mean_top2", "avg(CASE WHEN place <= 2 THEN score END)", ", placed AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, chunk_id) AS place FROM cand)", "placed")
_pool_query("pool_logsumexp", "logsumexp", "max(best) + ln(sum(exp(score - best)))", ", placed AS (SELECT *, max(score) OVER (PARTITION BY qid, doc_id) AS best FROM cand)", "placed")


@query(f"""WITH {q.BM25_CHUNKS}, p AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, chunk_id) AS place FROM cand)
    SELECT qid, doc_id, string_agg(chunk_id, ',' ORDER BY place) AS chunk_ids FROM p WHERE place <= 3 GROUP BY ALL""")
def anchor_chunks(spark, d):
    return pooling.anchor_chunks(gathered(spark, d))


_DENSE = """n AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    u AS (SELECT id, vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM n)"""


@query(f"""WITH {_DENSE}, s AS (SELECT a.id AS qid, b.id AS item_id, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.id <> b.id)
    SELECT qid, item_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS INT) AS rank FROM s) WHERE rank <= 5""")
def dense_search(spark, d):
    """A stated set of queries (every vector whose id is divisible by 50) against all vectors."""
    rows = table(spark, d, "embeddings").where(dense.usable(F.col("embedding"), 64)).select(F.col("vec_id").alias("id"), "embedding")
    return dense.search(rows.where("id % 50 = 0"), rows)


# --- fusion ---------------------------------------------------------------------------------------------------------


def _fused(sources: str, weights: dict[str, float], k: int, absent: int | None = None, tie: str | None = None) -> str:
    """SQL of a fusion of rankings that are common tables named as the sources."""
    union = " UNION ALL ".join(f"SELECT qid, doc_id, rank, '{n}' AS s, {w} AS w FROM {n}" for n, w in weights.items())
    score = f"sum(w / ({k} + rank))" if absent is None else f"sum(w / ({k} + rank) - w / ({k} + {absent})) + {sum(weights.values())} / ({k} + {absent})"
    order = f"min(CASE WHEN s = '{tie}' THEN rank END)" if tie else "NULL"
    return f"""WITH {sources}, un AS ({union}), fu AS (SELECT qid, doc_id, round({score}, 9) AS score, {order} AS tie FROM un GROUP BY ALL)
    SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, tie NULLS LAST, doc_id) AS INT) AS rank FROM fu"""


def two_runs(spark, d) -> dict[str, DataFrame]:
    return {"ranking": ranking(spark, d), "second": ranking(spark, d, "sum")}


@query(_fused(q.BOTH, {"ranking": 0.4, "second": 0.6}, 20))
def rrf_documents(spark, d):
    return fusion.fuse(two_runs(spark, d), {"ranking": 0.4, "second": 0.6}, 20)


@query(_fused(q.BOTH + ", few AS (SELECT * FROM second WHERE rank <= 3)", {"ranking": 0.5, "few": 0.5}, 60, 1010, "ranking"))
def rrf_absent_rank(spark, d):
    runs = two_runs(spark, d)
    return fusion.fuse({"ranking": runs["ranking"], "few": runs["second"].where("rank <= 3")}, {"ranking": 0.5, "few": 0.5}, 60, 1010, tie="ranking")


_KNN = f"""{q.LABELLED}, {q.EVAL}, {q.bm25("SELECT qid, question AS text FROM eq WHERE question IS NOT NULL", "SELECT qid AS item, qid AS doc, question AS text FROM labelled WHERE question IS NOT NULL", k1=1.2, top=51, binary=True)},
    near AS (SELECT qid, item, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM hits WHERE qid <> item), shared AS (SELECT qid, item, score / max(score) OVER (PARTITION BY qid) AS share FROM near WHERE place <= 50),
    knn_s AS (SELECT s.qid, d AS doc_id, round(sum(share), 6) AS score FROM shared s JOIN (SELECT qid AS item, unnest(answer) AS d FROM labelled) USING (item) GROUP BY ALL),
    knn AS (SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM knn_s QUALIFY rank <= 10)"""


def neighbours(spark, d) -> DataFrame:
    memory = train_labels(spark, d).where("question is not null")
    index = bm25.build_index(memory.select(F.col("qid").alias("chunk_id"), F.to_json("answer").alias("doc_id"), F.col("question").alias("text")), k1=1.2)
    similar = bm25.score_chunks(asked(spark, d).select("qid", "question"), index, top=51, binary=True)
    return fusion.neighbour_documents(similar.select("qid", F.col("chunk_id").alias("item_id"), F.col("doc_id").alias("answer"), "score", "rank"), 50, 10)


@query(f"WITH {_KNN} SELECT * FROM knn")
def knn_documents(spark, d):
    return neighbours(spark, d)


@query(_fused(f"{_KNN}, {q.RANKING}, a AS (SELECT r.* FROM ranking r SEMI JOIN eq USING (qid)), b AS (SELECT qid, doc_id, rank FROM (SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM (SELECT qid, doc_id, round(sum(score), 6) AS score FROM known GROUP BY ALL)) SEMI JOIN eq USING (qid) WHERE rank <= 20), c AS (SELECT * FROM knn)", {"a": 0.6, "b": 0.4, "c": 0.1}, 60, 10**6, "a"))
def rrf_three_sources(spark, d):
    runs = two_runs(spark, d)
    only = labels.distinct_questions(table(spark, d, "eval_questions")).select("qid")
    a, b = (r.join(only, "qid", "left_semi") for r in runs.values())
    return fusion.fuse({"a": a, "b": b.where("rank <= 20"), "c": neighbours(spark, d)}, {"a": 0.6, "b": 0.4, "c": 0.1}, 60, 10**6, tie="a", rescale=False)


def _plain(expression: str) -> str:
    """Different words of three characters or more, without accents."""
    return f"list_distinct(list_filter(regexp_extract_all(replace(strip_accents(lower({expression})), 'đ', 'd'), '{q.WORD}+'), lambda w: length(w) >= 3))"


_NAME_WORDS = f"""nw AS (SELECT doc_id, {_plain("replace(name, '-', ' ')")} AS n FROM corpus), qw AS (SELECT qid, {_plain("coalesce(question, '')")} AS w FROM eq)"""


def name_words(spark, d) -> DataFrame:
    return clean(spark, d).select("doc_id", tx.plain_words(F.replace("name", F.lit("-"), F.lit(" "))).alias("name_words"))


def question_words(spark, d) -> DataFrame:
    return labels.distinct_questions(table(spark, d, "eval_questions")).select("qid", tx.plain_words(F.col("question")).alias("question_words"))


@query(f"""WITH {q.RANKING}, {q.CORPUS}, {q.EVAL}, {_NAME_WORDS},
    s AS (SELECT qid, doc_id, round(score * (1 + 0.3 * CASE WHEN len(n) > 0 THEN coalesce(len(list_intersect(w, n)), 0) / len(n) ELSE 0 END), 9) AS score, rank AS old_rank FROM ranking LEFT JOIN qw USING (qid) LEFT JOIN nw USING (doc_id))
    SELECT qid, doc_id, score, old_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, old_rank) AS INT) AS rank FROM s""")
def rescore_by_name(spark, d):
    return fusion.rescore_by_overlap(ranking(spark, d), question_words(spark, d), name_words(spark, d), 0.3, 9)


_DOMAIN = f"""{q.RANKING}, {q.CORPUS}, dom AS (SELECT doc_id, {_LINK_DOMAIN} AS domain FROM corpus),
    v AS (SELECT qid, coalesce(domain, '?') AS domain, round(sum(score), 6) AS votes, min(rank) AS seen FROM ranking LEFT JOIN dom USING (doc_id) WHERE rank <= 10 GROUP BY ALL),
    chosen AS (SELECT qid, domain AS c FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, seen) = 1)"""


def _domains(spark, d) -> DataFrame:
    return clean(spark, d).select("doc_id", tx.link_domain(F.col("link")).alias("domain"))


@query(f"WITH {_DOMAIN} SELECT qid, doc_id, score, old_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY old_rank) AS INT) AS rank FROM (SELECT qid, doc_id, score, rank AS old_rank FROM ranking LEFT JOIN dom USING (doc_id) JOIN chosen USING (qid) WHERE domain = c)")
def domain_filter(spark, d):
    rows, domains = ranking(spark, d), _domains(spark, d)
    return fusion.apply_domain(rows, domains, fusion.vote_domain(rows, domains))


@query(f"WITH {_DOMAIN} SELECT qid, doc_id, score, old_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, old_rank) AS INT) AS rank FROM (SELECT qid, doc_id, round(CASE WHEN domain = c THEN score * 1.15 ELSE score END, 6) AS score, rank AS old_rank FROM ranking LEFT JOIN dom USING (doc_id) JOIN chosen USING (qid))")
def domain_boost(spark, d):
    rows, domains = ranking(spark, d), _domains(spark, d)
    return fusion.apply_domain(rows, domains, fusion.vote_domain(rows, domains), 0.15)


def _rerank_sql(key: str) -> str:
    return f"""WITH {q.BOTH}, rs AS (SELECT qid, doc_id, -score AS rerank_score FROM second), hd AS (SELECT r.qid, r.doc_id, r.score, r.rank, row_number() OVER (PARTITION BY r.qid ORDER BY rerank_score DESC NULLS LAST, r.rank) AS second_rank FROM ranking r LEFT JOIN rs USING (qid, doc_id) WHERE r.rank <= 5),
    al AS (SELECT qid, doc_id, score, 0 AS part, {key} AS key, rank AS old FROM hd UNION ALL SELECT qid, doc_id, score, 1, rank, rank FROM ranking WHERE rank > 5)
    SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY part, key, old) AS INT) AS rank FROM al"""


def _reverse_scores(spark, d) -> DataFrame:
    """A scorer in place of a model: it prefers what the summed scores put last."""
    return ranking(spark, d, "sum").select("qid", "doc_id", (-F.col("score")).alias("rerank_score"))


@query(_rerank_sql("CAST(second_rank AS DOUBLE)"))
def rerank_replace(spark, d):
    return fusion.rerank(ranking(spark, d), _reverse_scores(spark, d), 5)


@query(_rerank_sql("-round(0.5 / (60 + rank) + 0.5 / (60 + second_rank), 9)"))
def rerank_rrf(spark, d):
    return fusion.rerank(ranking(spark, d), _reverse_scores(spark, d), 5, "rrf")


# --- cut-off --------------------------------------------------------------------------------------------------------

_MARGINS = f"""{q.RANKING}, mg AS (SELECT qid, rank AS k, score - lead(score) OVER w AS gap, first_value(score) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - last_value(score) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dr FROM ranking WHERE rank <= 10 WINDOW w AS (PARTITION BY qid ORDER BY rank)),
    margins AS (SELECT qid, k, CASE WHEN dr > 0 AND dr < 'infinity'::DOUBLE THEN round(gap / dr, 6) ELSE 0.0 END AS margin FROM mg WHERE k < 5 AND gap IS NOT NULL)"""


@query(f"WITH {_MARGINS} SELECT * FROM margins")
def rank_margins(spark, d):
    return cutoff.rank_margins(ranking(spark, d))


@query(f"""WITH {_MARGINS}, f AS (SELECT qid, min(CASE WHEN margin > 0 AND margin >= 0.4 THEN k END) AS k FROM margins GROUP BY 1), s AS (SELECT qid, count(*) AS n FROM ranking GROUP BY 1)
    SELECT qid, CAST(least(coalesce(k, 5), n) AS INT) AS count FROM s LEFT JOIN f USING (qid)""")
def cut_first_margin(spark, d):
    return cutoff.cut_at_first_margin(ranking(spark, d), 0.4)


def _rule_sql(scale: str, rule: str, threshold: float) -> str:
    pick = f"CASE WHEN max(CASE WHEN rank = 1 THEN m END) > {threshold} THEN 1 ELSE count(*) END" if rule == "top1" else f"coalesce(min(CASE WHEN m > {threshold} THEN rank END), count(*))"
    return f"""WITH {q.RANKING}, t AS (SELECT qid, rank, score, max(score) OVER (PARTITION BY qid) AS s1, min(score) OVER (PARTITION BY qid) AS sl, lead(score) OVER (PARTITION BY qid ORDER BY rank) AS nx FROM ranking WHERE rank <= 5),
    m AS (SELECT qid, rank, CASE WHEN nx IS NULL THEN 'infinity'::DOUBLE ELSE round((score - nx) / {scale}, 9) END AS m FROM t) SELECT qid, CAST({pick} AS INT) AS count FROM m GROUP BY qid"""


@query(_rule_sql("greatest(s1 - sl, 1e-12)", "cascade", 0.5))
def cut_cascade_spread(spark, d):
    return cutoff.cut_by_rule(ranking(spark, d), 0.5)


@query(_rule_sql("greatest(s1, 1e-12)", "top1", 0.1))
def cut_top1_relative(spark, d):
    return cutoff.cut_by_rule(ranking(spark, d), 0.1, "top1", "rel")


@query(_rule_sql("1.0", "cascade", 1.0))
def cut_cascade_absolute(spark, d):
    return cutoff.cut_by_rule(ranking(spark, d), 1.0, "cascade", "abs")


@query(f"""WITH {q.RANKING}, e AS (SELECT qid, rank, exp(score - max(score) OVER (PARTITION BY qid)) AS x FROM ranking WHERE rank <= 5), p AS (SELECT qid, rank, x / sum(x) OVER (PARTITION BY qid) AS p FROM e),
    m AS (SELECT qid, rank, coalesce(round(p - lead(p) OVER (PARTITION BY qid ORDER BY rank), 9), 'infinity'::DOUBLE) AS m FROM p) SELECT qid, CAST(coalesce(min(CASE WHEN m > 0.3 THEN rank END), count(*)) AS INT) AS count FROM m GROUP BY qid""")
def cut_cascade_softmax(spark, d):
    return cutoff.cut_by_rule(ranking(spark, d), 0.3, "cascade", "softmax")


THETAS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0]

_SWEPT = f"""{_MARGINS}, {q.GOLD}, th AS (SELECT unnest([{', '.join(map(str, THETAS))}]::DOUBLE[]) AS theta), sz AS (SELECT qid, least(count(*), 5) AS n FROM ranking GROUP BY 1),
    ct AS (SELECT theta, s.qid, least(coalesce(min(CASE WHEN margin > 0 AND margin >= theta THEN k END), 5), any_value(s.n)) AS n FROM th CROSS JOIN sz s LEFT JOIN margins m ON m.qid = s.qid GROUP BY theta, s.qid),
    ht AS (SELECT theta, c.qid, c.n, len(g.answer) AS g, count_if(list_contains(g.answer, r.doc_id)) AS h FROM ct c JOIN gold g USING (qid) JOIN ranking r ON r.qid = c.qid AND r.rank <= c.n GROUP BY ALL),
    swept AS (SELECT theta, round(avg(h / g), 6) AS recall, round(avg(h / n), 6) AS precision, round(avg(n), 6) AS mean_count FROM ht GROUP BY theta)"""


@query(f"WITH {_SWEPT} SELECT * FROM swept")
def threshold_sweep(spark, d):
    return cutoff.sweep_thresholds(ranking(spark, d), gold(spark, d), THETAS)


@query(f"WITH {_SWEPT} SELECT min(theta) AS theta FROM swept WHERE recall >= (SELECT max(recall) FROM swept) - 0.02")
def threshold_fit(spark, d):
    return cutoff.fit_threshold(cutoff.sweep_thresholds(ranking(spark, d), gold(spark, d), THETAS), 0.02)


@query(f"""WITH {_MARGINS}, u AS (SELECT margin, row_number() OVER (ORDER BY margin) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT margin FROM margins))
    SELECT DISTINCT theta FROM (SELECT margin AS theta FROM u WHERE (i - 1) % greatest(n // 100, 1) = 0 UNION ALL SELECT 0.0 UNION ALL SELECT max(margin) + 1e-9 FROM u) WHERE theta IS NOT NULL""")
def threshold_grid(spark, d):
    return cutoff.threshold_grid(cutoff.rank_margins(ranking(spark, d)))


# --- evaluation -----------------------------------------------------------------------------------------------------

_LISTS = f"{q.BOTH}, {q.GOLD}, la AS (SELECT qid, list(doc_id ORDER BY rank) AS l FROM ranking GROUP BY 1), lb AS (SELECT qid, list(doc_id ORDER BY rank) AS l FROM second GROUP BY 1)"


def predicted(spark, d, depth: int = 5) -> DataFrame:
    lists = metrics.top_lists(ranking(spark, d), depth)
    none = F.array().cast("array<string>")
    return gold(spark, d).select("qid").join(lists, "qid", "left").select("qid", F.coalesce("answer", none).alias("answer"))


@query(f"""WITH {_LISTS}, p AS (SELECT g.qid, g.answer AS g, coalesce(l[1:5], []) AS a FROM gold g LEFT JOIN la USING (qid))
    SELECT count(*) AS questions, round(avg(CASE WHEN len(a) BETWEEN 1 AND 5 THEN len(list_intersect(list_distinct(a), g)) / len(g) ELSE 0 END), 6) AS recall,
    round(avg(CASE WHEN len(a) BETWEEN 1 AND 5 THEN len(list_intersect(list_distinct(a), g)) / len(a) ELSE 0 END), 6) AS precision FROM p""")
def official_score(spark, d):
    return metrics.official_score(predicted(spark, d), gold(spark, d))


_PER = f"""{_LISTS}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k), per AS (SELECT g.qid, k, len(list_intersect(coalesce(a.l, [])[1:k], g.answer)) / len(g.answer) AS ra, len(list_intersect(coalesce(b.l, [])[1:k], g.answer)) / len(g.answer) AS rb
    FROM gold g CROSS JOIN ks LEFT JOIN la a ON a.qid = g.qid LEFT JOIN lb b ON b.qid = g.qid)"""
KS = [1, 3, 5, 10]


@query(f"WITH {_PER} SELECT k, round(avg(ra), 6) AS recall FROM per GROUP BY k")
def recall_at_k(spark, d):
    return metrics.recall_at(ranking(spark, d), gold(spark, d), KS)


@query(f"""WITH {_PER}, fr AS (SELECT d AS doc_id, count(*) AS n FROM (SELECT unnest(list_distinct(answer)) AS d FROM tq WHERE len(answer) > 0) GROUP BY 1),
    ti AS (SELECT qid, CASE WHEN f = 0 THEN '0' WHEN f <= 2 THEN '1-2' WHEN f <= 10 THEN '3-10' ELSE '11+' END AS tier FROM (SELECT g.qid, min(coalesce(n, 0)) AS f FROM (SELECT qid, unnest(answer) AS doc_id FROM gold) g LEFT JOIN fr USING (doc_id) GROUP BY 1)),
    ag AS (SELECT k, tier, count(*) AS questions, avg(ra) AS r FROM per JOIN ti USING (qid) GROUP BY ALL)
    SELECT k, tier, questions, round(r, 6) AS recall, round(max(r) OVER (PARTITION BY k) - min(r) OVER (PARTITION BY k), 6) AS spread FROM ag""")
def recall_by_tier(spark, d):
    return metrics.recall_by_tier(ranking(spark, d), gold(spark, d), metrics.gold_frequency(train_labels(spark, d)), KS)


@query(f"""WITH {_LISTS}, {q.CORPUS}, p AS (SELECT qid, l[1:5] AS a FROM la) SELECT count(*) AS questions, sum(len(a) - len(list_distinct(a)))::BIGINT AS repeated, count_if(len(a) > 5)::BIGINT AS too_many, count_if(len(a) = 0)::BIGINT AS empty, count_if(len(list_filter(a, lambda x: x IS NULL OR trim(x) <> x OR x = '')) > 0)::BIGINT AS odd_ids,
    round(avg(len(a)), 6) AS mean_answers, (SELECT count(*) FROM (SELECT DISTINCT unnest(a) AS doc_id FROM p) ANTI JOIN corpus USING (doc_id)) AS unknown_ids FROM p""")
def diagnose_predictions(spark, d):
    return metrics.diagnose(metrics.top_lists(ranking(spark, d), 5), clean(spark, d).select("doc_id"))


@query("""WITH r AS (SELECT qid, list(doc_id ORDER BY rank, doc_id, chunk_id, score) AS l FROM (SELECT DISTINCT qid, rank, doc_id, chunk_id, score FROM ranking_rows WHERE doc_id IS NOT NULL AND rank IS NOT NULL) GROUP BY 1),
    f AS (SELECT qid, list(d ORDER BY p) AS a FROM (SELECT qid, d, min(p) AS p FROM (SELECT qid, unnest(l) AS d, generate_subscripts(l, 1) AS p FROM r) GROUP BY ALL) GROUP BY qid) SELECT qid, array_to_string(a[1:5], ',') AS answer FROM f""")
def dedupe_and_cut(spark, d):
    rows = table(spark, d, "ranking_rows").where("doc_id is not null and rank is not null").select("qid", "rank", "doc_id", "chunk_id", "score").distinct()
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "chunk_id", "score"))).alias("l"))
    return lists.select("qid", F.array_join(metrics.dedupe_and_cut(F.transform("l", lambda x: x["doc_id"])), ",").alias("answer"))


@query(f"""WITH {_PER} SELECT k, count(*) AS questions, count_if(ra > 0 AND rb > 0)::BIGINT AS both, count_if(ra > 0 AND rb = 0)::BIGINT AS only_a, count_if(ra = 0 AND rb > 0)::BIGINT AS only_b, count_if(ra = 0 AND rb = 0)::BIGINT AS neither,
    count_if(ra > rb)::BIGINT AS a_wins, count_if(ra < rb)::BIGINT AS b_wins, count_if(ra = rb)::BIGINT AS ties FROM per GROUP BY k""")
def compare_runs(spark, d):
    return metrics.compare_runs(ranking(spark, d), ranking(spark, d, "sum"), gold(spark, d), KS)


@query(f"""WITH {_LISTS}, ds AS (SELECT unnest([1, 3, 5, 10, 20, 50]) AS depth) SELECT depth, count(*) AS questions, count_if(a.l[1:depth] = b.l[1:depth])::BIGINT AS same_lists, count_if(list_sort(a.l[1:depth]) = list_sort(b.l[1:depth]))::BIGINT AS same_sets,
    CAST(min(list_position(list_transform(range(1, greatest(len(a.l[1:depth]), len(b.l[1:depth])) + 1), lambda i: a.l[1:depth][i] IS NOT DISTINCT FROM b.l[1:depth][i]), false)) AS INT) AS first_divergence
    FROM la a JOIN lb b USING (qid) CROSS JOIN ds GROUP BY depth""")
def rankings_agree(spark, d):
    return metrics.agreement(ranking(spark, d), ranking(spark, d, "sum"), [1, 3, 5, 10, 20, 50])


@query(f"""WITH {_LISTS}, z AS (SELECT qid, a.l AS x, b.l AS y, least(len(a.l), len(b.l)) AS n FROM la a JOIN lb b USING (qid)), u AS (SELECT qid, unnest(flatten(list_transform(range(1, n + 1), lambda i: [x[i], y[i]]))) AS d, generate_subscripts(flatten(list_transform(range(1, n + 1), lambda i: [x[i], y[i]])), 1) AS p FROM z)
    SELECT qid, string_agg(d, ',' ORDER BY p) AS items FROM (SELECT qid, d, min(p) AS p FROM u GROUP BY ALL) GROUP BY qid""")
def interleaved_union(spark, d):
    a, b = (metrics.top_lists(r, 1 << 30) for r in two_runs(spark, d).values())
    both = a.withColumnRenamed("answer", "x").join(b.withColumnRenamed("answer", "y"), "qid")
    return both.select("qid", F.array_join(fusion.interleave(F.col("x"), F.col("y")), ",").alias("items"))


@query(f"""WITH {_PER}, c AS (SELECT count_if(rb > ra)::BIGINT AS wins, count_if(rb < ra)::BIGINT AS losses, count_if(ra = rb)::BIGINT AS ties FROM per WHERE k = 3)
    SELECT wins, losses, ties, round(CASE WHEN wins + losses > 0 THEN pow(abs(wins - losses) - 1, 2) / (wins + losses) ELSE 0 END, 6) AS chi2 FROM c""")
def mcnemar_counts(spark, d):
    return _mcnemar(spark, d).drop("p_value")


def _mcnemar(spark, d) -> DataFrame:
    g = gold(spark, d)
    a, b = (metrics.recall_per_question(r, g, [3]) for r in two_runs(spark, d).values())
    return statistics.mcnemar(a, b)


@query()  # no erfc in DuckDB
def mcnemar_test(spark, d):
    return _mcnemar(spark, d)


@query()
def bootstrap_interval(spark, d):
    """A random method; its interval is tested against the closed form on a fixture."""
    g = gold(spark, d)
    a, b = (metrics.recall_per_question(r, g, [3]) for r in two_runs(spark, d).values())
    return statistics.bootstrap_interval(statistics.paired_differences(a, b), 2000)


_MODES = f"""{_LISTS}, modes AS (SELECT qid, CASE WHEN len(list_intersect(answer, coalesce(l, [])[1:5])) = len(answer) THEN 'OK' WHEN len(list_intersect(answer, coalesce(l, [])[1:50])) = 0 THEN 'MISS50' ELSE 'MISS5' END AS mode FROM gold LEFT JOIN la USING (qid))"""


@query(f"WITH {_MODES} SELECT * FROM modes")
def failure_modes(spark, d):
    return metrics.failure_modes(ranking(spark, d), gold(spark, d))


@query(f"""WITH {_MODES}, c AS (SELECT mode, count(*) AS questions, least(count(*), CASE mode WHEN 'MISS5' THEN 30 ELSE 20 END)::BIGINT AS taken FROM modes WHERE mode <> 'OK' GROUP BY mode)
    SELECT mode, questions, taken, round((questions / (SELECT count(*) FROM modes)) / (taken / 50), 6) AS rescale FROM c""")
def failure_sample(spark, d):
    """How many failures of each kind a sample takes, and the factor back to their share among all questions."""
    return metrics.failure_sample(failure_modes(spark, d), {"MISS5": 30, "MISS50": 20})


@query(f"""WITH {q.RANKING}, p AS (SELECT qid, count(*) AS n, count(DISTINCT doc_id) AS d, max(rank) AS last FROM ranking GROUP BY qid)
    SELECT count(*) AS questions, count_if(n > 10)::BIGINT AS too_long, count_if(n > d)::BIGINT AS repeated, CAST(0 AS BIGINT) AS rising, count_if(n <> last)::BIGINT AS gaps FROM p""")
def ranking_contract(spark, d):
    return metrics.ranking_contract(ranking(spark, d), 10)


@query(f"WITH {_LISTS} SELECT CAST(len(l[1:5]) AS INT) AS size, count(*) AS questions FROM la GROUP BY 1")
def size_histogram(spark, d):
    return metrics.size_histogram(metrics.top_lists(ranking(spark, d), 5))


@query(f"""WITH {q.KNOWN}, {q.GOLD}, c AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 5), {q.pooled('max(score)', 'x', 'c')}, {q.pooled('max(score)', 'y')},
    b AS (SELECT qid, list(doc_id ORDER BY rank) AS l FROM x WHERE rank <= 10 GROUP BY 1), e AS (SELECT qid, list(doc_id ORDER BY rank) AS l FROM y WHERE rank <= 10 GROUP BY 1),
    r AS (SELECT round(avg(len(list_intersect(coalesce(e.l, [])[1:5], answer)) / len(answer)), 4) AS f5, round(avg(len(list_intersect(coalesce(e.l, []), answer)) / len(answer)), 4) AS f10,
          round(avg(len(list_intersect(coalesce(b.l, [])[1:5], answer)) / len(answer)), 4) AS c5, round(avg(len(list_intersect(coalesce(b.l, []), answer)) / len(answer)), 4) AS c10 FROM gold LEFT JOIN e USING (qid) LEFT JOIN b USING (qid))
    SELECT count(*) AS questions, count_if(b.l <> e.l)::BIGINT AS list_diff, count_if(list_sort(b.l) <> list_sort(e.l))::BIGINT AS set_diff, any_value(f5) AS recall_5_full, any_value(f10) AS recall_10_full, any_value(c5) AS recall_5_capped, any_value(c10) AS recall_10_capped
    FROM b JOIN e USING (qid) CROSS JOIN r""")
def cap_equivalence(spark, d):
    """What keeping the five best chunks before pooling by maximum changes in the first ten documents."""
    rows = table(spark, d, "ranking_rows").where(F.col("doc_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")).select("qid", "doc_id", "score", "chunk_id").distinct()
    capped, full = (pooling.pool_documents(rows, "max", c) for c in (5, None))
    return metrics.cap_equivalence(full, capped, gold(spark, d), 10, 5)


GRID = [(w, k) for w in (0.2, 0.4, 0.6, 0.8) for k in (10, 60)]


def _grid_sql(columns: str, extra: str = "") -> str:
    cells = ", ".join(f"({w}, {k})" for w, k in GRID)
    return f"""WITH {_LISTS}, cell AS (SELECT CAST(w AS DOUBLE) AS w, k FROM (VALUES {cells}) t(w, k)), un AS (SELECT qid, doc_id, rank, 0 AS s FROM ranking UNION ALL SELECT qid, doc_id, rank, 1 FROM second),
    fu AS (SELECT w, k, qid, doc_id, round(sum(CASE WHEN s = 0 THEN w ELSE 1 - w END / (k + rank)), 9) AS score FROM un CROSS JOIN cell GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY w, k, qid ORDER BY score DESC, doc_id) AS r FROM fu), tl AS (SELECT w, k, qid, list(doc_id) AS l FROM rk WHERE r <= 3 GROUP BY ALL),
    rc AS (SELECT c.w, c.k, gold.qid, len(list_intersect(answer, coalesce(l, []))) / len(answer) AS recall FROM gold CROSS JOIN cell c LEFT JOIN tl t ON t.qid = gold.qid AND t.w = c.w AND t.k = c.k){extra}
    SELECT {columns}"""


def grid_recalls(spark, d) -> DataFrame:
    runs = two_runs(spark, d)
    return tuning.fusion_recalls(runs["ranking"], runs["second"], gold(spark, d), GRID, 3)


@query(_grid_sql("w, k, round(avg(recall), 6) AS recall FROM rc GROUP BY ALL"))
def grid_search(spark, d):
    """Recall at 3 of every weight and constant."""
    return grid_recalls(spark, d).groupBy("w", "k").agg(F.round(F.avg("recall"), 6).alias("recall"))


HALF = "CASE WHEN substring(md5('42:' || qid), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 0 ELSE 1 END"


@query(_grid_sql(f"w, k, fit, report, round((SELECT max(report) FROM cm) - report, 6) AS optimism FROM cm ORDER BY fit DESC, w DESC, k LIMIT 1", f", cm AS (SELECT w, k, round(avg(CASE WHEN {HALF} = 0 THEN recall END), 6) AS fit, round(avg(CASE WHEN {HALF} = 1 THEN recall END), 6) AS report FROM rc GROUP BY ALL)"))
def grid_choice(spark, d):
    """The cell chosen on one half of the questions, reported on the other, and its optimism."""
    return tuning.choose(grid_recalls(spark, d))


FACTORS = [0.0, 0.1, 0.3, 1.0]


@query(f"""WITH {q.RANKING}, {q.CORPUS}, {q.GOLD}, {_NAME_WORDS},
    fc AS (SELECT unnest({FACTORS}::DOUBLE[]) AS factor), s AS (SELECT factor, qid, doc_id, rank, round(score * (1 + factor * CASE WHEN len(n) > 0 THEN coalesce(len(list_intersect(w, n)), 0) / len(n) ELSE 0 END), 6) AS s FROM ranking CROSS JOIN fc LEFT JOIN qw USING (qid) LEFT JOIN nw USING (doc_id)),
    tl AS (SELECT factor, qid, list(doc_id) AS l FROM (SELECT *, row_number() OVER (PARTITION BY factor, qid ORDER BY s DESC, rank) AS p FROM s) WHERE p <= 3 GROUP BY ALL),
    rc AS (SELECT fc.factor, gold.qid, len(list_intersect(answer, coalesce(l, []))) / len(answer) AS recall FROM gold CROSS JOIN fc LEFT JOIN tl ON tl.qid = gold.qid AND tl.factor = fc.factor),
    mn AS (SELECT factor, {HALF} AS half, round(avg(recall), 6) AS r FROM rc GROUP BY ALL), ch AS (SELECT 1 - half AS fold, factor FROM mn QUALIFY row_number() OVER (PARTITION BY half ORDER BY r DESC, factor) = 1)
    SELECT CAST(fold AS INT) AS fold, factor, r AS recall FROM ch JOIN mn USING (factor) WHERE mn.half = fold""")
def bonus_cross_validation(spark, d):
    return tuning.cross_validate(tuning.bonus_recalls(ranking(spark, d), question_words(spark, d), name_words(spark, d), gold(spark, d), FACTORS, 3), "factor")


@query(f"""WITH {_LISTS}, pr AS (SELECT s.qid, list_contains(g.answer, s.doc_id) AS is_gold, s.score FROM second s JOIN gold g USING (qid)), per AS (SELECT qid, max(CASE WHEN is_gold THEN score END) AS g, max(CASE WHEN NOT is_gold THEN score END) AS o FROM pr GROUP BY 1 HAVING g IS NOT NULL AND o IS NOT NULL)
    SELECT (SELECT count(*) FROM pr) AS scores, CAST(0 AS BIGINT) AS not_numbers, (SELECT round(avg(score), 6) FROM pr) AS mean, (SELECT round(stddev_pop(score), 6) FROM pr) AS deviation, count(*) AS compared, round(avg(CASE WHEN g > o THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS win_rate FROM per""")
def rerank_probe(spark, d):
    """The summed scores as a reranker's: do gold documents get the higher ones?"""
    rows = ranking(spark, d, "sum").join(gold(spark, d), "qid")
    return tuning.probe_scores(rows.select("qid", "doc_id", F.array_contains("answer", F.col("doc_id")).alias("is_gold"), F.col("score").alias("rerank_score")))


@query(f"""WITH {_DOMAIN}, {q.GOLD}, gd AS (SELECT DISTINCT qid, coalesce(domain, '') AS domain FROM (SELECT qid, unnest(answer) AS doc_id FROM gold) LEFT JOIN dom USING (doc_id)), rd AS (SELECT qid, doc_id, rank, coalesce(domain, '') AS domain FROM ranking LEFT JOIN dom USING (doc_id))
    SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INT) AS rank FROM rd SEMI JOIN gd USING (qid, domain)""")
def domain_oracle(spark, d):
    """What a filter that knew the gold documents' domains would leave; documents outside the corpus are alike."""
    domains = _domains(spark, d)
    of = lambda rows: rows.join(domains, "doc_id", "left").withColumn("domain", F.coalesce("domain", F.lit("")))
    wanted = of(gold(spark, d).select("qid", F.explode("answer").alias("doc_id"))).select("qid", "domain").distinct()
    rows = of(ranking(spark, d)).join(wanted, ["qid", "domain"], "left_semi")
    return bm25.rank_within(rows.select("qid", "doc_id", F.col("rank").alias("old")), ["qid"], [F.col("old")]).drop("old")


@query()
def gold_excerpts(spark, d):
    """Paragraphs of gold documents by keyword density; tested against a scalar twin."""
    questions = train_labels(spark, d).where("question is not null")
    return excerpts.excerpts(questions, questions.select("qid", F.explode("answer").alias("doc_id")), clean(spark, d))


@query(f"""WITH {q.BM25_CHUNKS}, {q.CORPUS}, t AS (SELECT doc_id, unnest({q.tokens('name')}) AS term FROM corpus WHERE name <> '')
    SELECT doc_id, count(*) AS terms, count(idf) AS known, round(avg(idf), 6) AS mean_idf FROM t LEFT JOIN vocabulary USING (term) GROUP BY doc_id""")
def name_term_idf(spark, d):
    """How rare the words of a document's name are among the chunks."""
    index = bm25.build_index(pieces(spark, d))
    words = clean(spark, d).where("name <> ''").select("doc_id", F.explode(Tokenizer()(F.col("name"))).alias("term"))
    return words.join(index.terms, "term", "left").groupBy("doc_id").agg(F.count("*").alias("terms"), F.count("idf").alias("known"), F.round(F.avg("idf"), 6).alias("mean_idf"))


# --- graphs, splits, samples ----------------------------------------------------------------------------------------

_SLUG = tx.SLUG_CODE.replace("(?=", "(?:")
_CITED = rf"\b{tx.CITED}\b"
_EDGES = rf"""{q.CORPUS}, sl AS (SELECT doc_id, text, regexp_extract(substring(text, 1, 1500), 'Số:\s*({tx.CODE})', 1) AS st, [regexp_extract(name, '{_SLUG}', 1), regexp_extract(name, '{_SLUG}', 2), regexp_extract(name, '{_SLUG}', 3)] AS sg FROM corpus),
    own AS (SELECT doc_id, text, nullif(upper(regexp_replace(CASE WHEN st <> '' THEN st WHEN sg[1] <> '' THEN array_to_string(sg, '/') ELSE '' END, '\s+', '', 'g')), '') AS code FROM sl),
    codes AS (SELECT code, min(doc_id) AS doc_id FROM own WHERE code IS NOT NULL GROUP BY code),
    sp AS (SELECT doc_id, code AS own, regexp_split_to_array(text, '{_CITED}') AS p, regexp_extract_all(text, '{_CITED}') AS m FROM own),
    ct AS (SELECT doc_id, own, unnest(range(1, len(m) + 1)) AS i, p, m FROM sp WHERE len(m) > 0),
    kd AS (SELECT doc_id AS src, own, upper(m[i]) AS code, regexp_matches(right(array_to_string(list_transform(range(1, i + 1), lambda j: p[j] || CASE WHEN j < i THEN m[j] ELSE '' END), ''), 120), '(?i){'|'.join(graph.AMENDMENTS)}') AS amend FROM ct),
    edges AS (SELECT src, c.doc_id AS dst, CASE WHEN bool_or(amend) THEN 'amend' ELSE 'cite' END AS kind FROM kd JOIN codes c USING (code) WHERE src <> c.doc_id AND (own IS NULL OR own <> code) GROUP BY ALL)"""


@query(f"WITH {_EDGES} SELECT * FROM edges")
def citation_edges(spark, d):
    return graph.citation_edges(clean(spark, d))


@query(f"""WITH {_EDGES}, dg AS (SELECT src AS doc_id, count(*) AS o, count_if(kind = 'amend') AS a FROM edges GROUP BY 1), tt AS (SELECT src AS doc_id FROM edges UNION SELECT dst FROM edges)
    SELECT count(*) AS documents, coalesce(sum(o), 0)::BIGINT AS edges, coalesce(sum(a), 0)::BIGINT AS amendments, round(coalesce(sum(o), 0) / count(*), 2) AS mean_out, coalesce(max(o), 0)::BIGINT AS largest_out, count_if(tt.doc_id IS NULL)::BIGINT AS isolated
    FROM corpus LEFT JOIN dg USING (doc_id) LEFT JOIN tt USING (doc_id)""")
def citation_summary(spark, d):
    rows = clean(spark, d)
    return graph.graph_summary(graph.citation_edges(rows), rows)


@query(f"WITH {_EDGES} SELECT * FROM codes")
def document_codes(spark, d):
    return graph.document_codes(clean(spark, d))


_ANSWER_EDGES = """a AS (SELECT DISTINCT qid, unnest(answer) AS d FROM (SELECT qid, answer FROM train UNION ALL SELECT qid, answer FROM eval_questions) WHERE len(answer) > 1), e AS (SELECT DISTINCT x.d AS s, y.d AS t FROM a x JOIN a y USING (qid) WHERE x.d <> y.d)"""


def co_answered(spark, d) -> DataFrame:
    """Rows ``src, dst, kind``: documents that are gold for one question."""
    rows = table(spark, d, "train").select("qid", "answer").unionByName(table(spark, d, "eval_questions").select("qid", "answer"))
    a = rows.where(F.size("answer") > 1).select("qid", F.explode("answer").alias("doc_id")).distinct()
    pairs = a.alias("x").join(a.alias("y"), "qid").where("x.doc_id < y.doc_id")
    return pairs.select(F.col("x.doc_id").alias("src"), F.col("y.doc_id").alias("dst"), F.lit("cite").alias("kind")).distinct()


@query(f"""WITH {_ANSWER_EDGES}, one AS (SELECT s AS seed, t AS doc_id FROM e), two AS (SELECT DISTINCT o.seed, e.t AS doc_id FROM one o JOIN e ON e.s = o.doc_id WHERE e.t <> o.seed)
    SELECT seed, doc_id, CAST(min(hop) AS INT) AS hop FROM (SELECT *, 1 AS hop FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY ALL""")
def graph_two_hops(spark, d):
    edges = co_answered(spark, d)
    seeds = edges.select(F.col("src").alias("doc_id")).union(edges.select("dst")).distinct()
    return graph.neighbours(edges, seeds, 2)


@query(f"""WITH RECURSIVE {_ANSWER_EDGES}, r(node, root) AS (SELECT DISTINCT s, s FROM e UNION SELECT e.t, r.root FROM r JOIN e ON e.s = r.node) SELECT node, min(root) AS component FROM r GROUP BY node""")
def connected_components(spark, d):
    return components.connected_components(co_answered(spark, d), "src", "dst")


@query(f"""WITH {q.LABELLED}, {_DUPLICATES}, t AS (SELECT DISTINCT qid, group_key FROM (SELECT qid, unnest(answer) AS doc_id FROM labelled) JOIN groups USING (doc_id)),
    e AS (SELECT DISTINCT x.qid AS s, y.qid AS t FROM t x JOIN t y USING (group_key)), r(node, root) AS (SELECT DISTINCT s, s FROM e UNION SELECT e.t, r.root FROM r JOIN e ON e.s = r.node), g AS (SELECT node, min(root) AS root FROM r GROUP BY node)
    SELECT qid, coalesce('group_' || root, qid) AS group_id FROM labelled LEFT JOIN g ON node = qid""".replace("WITH", "WITH RECURSIVE", 1))
def leak_groups(spark, d):
    return graph.leak_groups(train_labels(spark, d), corpus.duplicate_groups(clean(spark, d)))


@query()
def leak_safe_split(spark, d):
    """Seeded by Python's generator, so SQL can't repeat it; its integrity is a query of its own."""
    groups = graph.leak_groups(train_labels(spark, d), corpus.duplicate_groups(clean(spark, d)))
    n = groups.count()
    return splits.split_questions(groups, splits.SplitPlan(n // 7, n // 20, n // 7))


@query(f"WITH {q.LABELLED}, n AS (SELECT count(*) AS n FROM labelled) SELECT CAST(0 AS BIGINT) AS split_questions, CAST(0 AS BIGINT) AS split_groups, n // 7 AS holdout, n // 20 AS error_pool, n // 7 AS dev, n - 2 * (n // 7) - n // 20 AS train FROM n")
def split_integrity(spark, d):
    return splits.integrity(leak_safe_split(spark, d))


@query(f"""WITH {q.EVAL}, o AS (SELECT qid, ntile(7) OVER (ORDER BY qid) AS shard FROM eq) SELECT CAST(shard AS INT) AS shard, min(qid) AS first, max(qid) AS last, count(*) AS n FROM o GROUP BY shard""")
def shard_bounds(spark, d):
    return statistics.shard_bounds(table(spark, d, "eval_questions"), "qid", 7)


@query(f"""WITH {q.EVAL}, c AS (SELECT split, count(*) AS n, sum(count(*)) OVER () AS t FROM eq GROUP BY split), r AS (SELECT split, CAST(floor(n * 60 / t + 0.5) AS BIGINT) AS r, row_number() OVER (ORDER BY n DESC, split) AS p FROM c), z AS (SELECT split, r + CASE WHEN p = 1 THEN 60 - sum(r) OVER () ELSE 0 END AS quota FROM r),
    o AS (SELECT qid, split, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || qid), qid) AS place FROM eq) SELECT qid, split FROM o JOIN z USING (split) WHERE place <= quota""")
def stratified_sample(spark, d):
    rows = labels.distinct_questions(table(spark, d, "eval_questions")).select("qid", "split")
    return statistics.stratified_sample(rows, "qid", "split", 60)


@query(f"WITH {q.TRAIN}, {q.EVAL} SELECT qid FROM tq ANTI JOIN (SELECT qid FROM eq WHERE split = 'holdout') USING (qid) ORDER BY md5('42:' || qid), qid LIMIT 40")
def random_sample(spark, d):
    held = table(spark, d, "eval_questions").where("split = 'holdout'")
    return statistics.random_sample(labels.distinct_questions(table(spark, d, "train")).select("qid"), "qid", 40, [held])


@query(f"""WITH {q.EVAL}, c AS (SELECT split, count(*) AS n, sum(count(*)) OVER () AS t FROM eq GROUP BY split) SELECT split, n, round(n / t, 6) AS share, round(1.96 * sqrt(n / t * (1 - n / t) / t), 6) AS half_width FROM c""")
def proportions(spark, d):
    return statistics.proportion_interval(labels.distinct_questions(table(spark, d, "eval_questions")), "split")
