"""The same operators in DuckDB SQL, for differential tests; pieces that several statements share."""

from __future__ import annotations

from docloom.functions.text import CRAWLER_LEFTOVERS, SPACE, WORD, tone_pairs

JUNK = "|".join(CRAWLER_LEFTOVERS)

RAW = """raw AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at NULLS FIRST, source_file NULLS FIRST) AS rn FROM raw_contexts) WHERE rn = 1)"""

CORPUS = f"""{RAW}, corpus AS (SELECT CAST(id AS VARCHAR) AS doc_id, trim(coalesce(name, '')) AS name, lower(trim(coalesce(link, ''))) AS link,
    trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(passage, '')), '{SPACE}+', ' ', 'g'), '(?i)({JUNK}).*$', '')) AS text FROM raw)"""

CHUNKS = r"""piece AS (SELECT DISTINCT chunk_id, doc_id, position, text FROM chunks WHERE regexp_matches(coalesce(text, ''), '[^\s\x{a0}\x{3000}]'))"""


def first_by_time(table: str, name: str) -> str:
    return f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY asked_at NULLS FIRST) AS rn FROM {table}) WHERE rn = 1)"


TRAIN, EVAL = first_by_time("train", "tq"), first_by_time("eval_questions", "eq")
LABELLED = f"{TRAIN}, labelled AS (SELECT qid, question, list_sort(list_distinct(answer)) AS answer FROM tq WHERE len(answer) > 0)"
GOLD = f"""{TRAIN}, {EVAL}, gold AS (SELECT qid, list_sort(list_distinct(answer)) AS answer FROM (SELECT qid, answer FROM tq UNION ALL SELECT qid, answer FROM eq) WHERE len(answer) > 0)"""

KNOWN = "known AS (SELECT DISTINCT qid, doc_id, score, chunk_id FROM ranking_rows WHERE doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))"


def pooled(expression: str, name: str, source: str = "known", decimals: int = 6) -> str:
    """A ranking of documents from rows of chunks, by an aggregate over their scores."""
    return f"""{name}_p AS (SELECT qid, doc_id, round({expression}, {decimals}) AS score FROM {source} GROUP BY ALL),
    {name}_c AS (SELECT qid, doc_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, chunk_id) AS n FROM {source}) WHERE n = 1),
    {name} AS (SELECT qid, doc_id, score, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM {name}_p JOIN {name}_c USING (qid, doc_id))"""


RANKING = f"{KNOWN}, {pooled('max(score)', 'ranking')}"
BOTH = f"{RANKING}, {pooled('sum(score)', 'second')}"


def folded(expression: str) -> str:
    """Lower case, composed, with one place for tones; RE2 has no look-behind, so the letter before u is captured."""
    out = f"lower(nfc_normalize({expression}))"
    for late, early in tone_pairs():
        out = f"regexp_replace({out}, '(^|[^q]){late}', '\\1{early}', 'g')" if late[0] == "u" else f"replace({out}, '{late}', '{early}')"
    return out


def tokens(expression: str) -> str:
    return f"regexp_extract_all({folded(expression)}, '{WORD}+')"


def words(expression: str) -> str:
    return f"list_filter(regexp_split_to_array({expression}, '{SPACE}+'), lambda w: w <> '')"


def question_key(expression: str) -> str:
    kept = f"regexp_replace(lower(nfc_normalize({expression})), '[^\\p{{L}}\\p{{N}}_\\s\\x{{c0}}-\\x{{1ef9}}]', ' ', 'g')"
    return f"trim(regexp_replace({kept}, '{SPACE}+', ' ', 'g'))"


def bm25(questions: str, pieces: str, k1: float = 1.5, b: float = 0.75, top: int = 20, binary: bool = False, split: str | None = None) -> str:
    """Common tables down to ``hits``: the best rows ``qid, item, doc, score, rank`` of questions (qid, text) against
    pieces (item, doc, text)."""
    times = "1" if binary else "q.tf"
    split = split or tokens("text")
    return f"""pt AS (SELECT item, doc, len(t) AS dl, t FROM (SELECT item, doc, {split} AS t FROM ({pieces}))),
    posting AS (SELECT item, doc, dl, term, count(*) AS tf FROM (SELECT item, doc, dl, unnest(t) AS term FROM pt) GROUP BY ALL),
    stats AS (SELECT count(*) AS n, CASE WHEN sum(dl) > 0 THEN sum(dl) / count(*) ELSE 1.0 END AS avgdl FROM pt),
    vocabulary AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posting GROUP BY term),
    asked AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({split}) AS term FROM ({questions})) GROUP BY ALL),
    scored AS (SELECT q.qid, p.item, p.doc, round(sum({times} * v.idf * p.tf * ({k1} + 1) / (p.tf + {k1} * (1 - {b} + {b} * p.dl / (SELECT avgdl FROM stats)))), 6) AS score
               FROM asked q JOIN vocabulary v USING (term) JOIN posting p USING (term) GROUP BY ALL),
    hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS INT) AS rank FROM scored) WHERE rank <= {top})"""


BM25_CHUNKS = f"""{CHUNKS}, {EVAL}, {bm25("SELECT qid, question AS text FROM eq WHERE question IS NOT NULL", "SELECT chunk_id AS item, doc_id AS doc, text FROM piece", top=50)},
    cand AS (SELECT qid, item AS chunk_id, doc AS doc_id, score FROM hits)"""
