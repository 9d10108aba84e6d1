"""Texts cut off by a field limit or a broken transfer.

From all different texts the operator counts words and line openings; copies of a text count once. The words
used inside texts are the vocabulary, kept as a trie in relational form: one row for every proper prefix of a word that
has the length of some text's final token. The ending of every text is then judged:

* a final token that isn't a word but begins longer ones in the trie (it begins them far more often than it is used
  itself, and ends texts more often than that use explains) stops within a word; shares, so they hold at any size;
* an ending without closing punctuation, on a word that texts use inside or on a mark that asks for more, stops within a
  sentence, unless its last line is of a kind that mostly closes texts (signatures, page numbers, enclosures; told from the
  corpus by how its first words are used elsewhere) or the text is one line without any sentence (a title) that doesn't
  begin as running text does. Of a final token that is neither a word nor a beginning (names, codes) only the length tells;
* a marker of omission, half an entity, half an escape or a broken character after an open ending doesn't close it;
* lengths that unclosed texts of a source share are its field limits; what repeatedly stands behind a limit, however long,
  and hardly ever elsewhere, is a stamp set after the cut, and a text that ends with a stamp was cut before it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from docloom.llm.transducer import INVISIBLE, SPACES, one_form
from docloom.session import materialize

#: A fragment's uses inside texts are at most this share of those of the longer words it begins; the longer words are
#: used so many times as often as it ends a text; and it ends texts so many times as often as its uses inside explain.
INSIDE_SHARE, EXTENDED, OFTEN_LAST = 0.01, 5, 4
#: A field limit holds this share of the source's unclosed texts, and this many.
LIMIT_SHARE, LIMIT_TEXTS = 0.04, 3
#: A stamp occurs this often behind a limit, and this share of its endings is there.
STAMP_TEXTS, STAMP_SHARE = 2, 0.2
#: A line opening closes texts if it was seen so often in last lines, and mostly there.
CLOSING_LINES, CLOSING_SHARE = 2, 0.5
CLOSING_WORDS, TITLE_WORDS = 15, 25
#: A task hands its counts on when it holds so many different ones.
FLUSH = 400_000

_WORD = re.compile(r"\w+")
_DIGITS = re.compile(r"\d+")
_BLANK = rf"\s{INVISIBLE}"
_BLANKS = " \t\n\r\x0b\x0c\x85\u2028\u2029" + SPACES + INVISIBLE
_OMISSION = re.compile(rf"(?:[{_BLANK}]|…|\.\.\.|\[(?:…|\.\.\.)\]|\((?:…|\.\.\.)\)|&nbsp;|<br\s*/?>)+$")
_BROKEN = re.compile(r"(?:�|&(?:#\w{0,6}|[a-zA-Z]{0,6})|<[^<>\s]{0,20}|\\u[0-9a-fA-F]{0,3}|\\)$")
_CLOSED = re.compile(r"[.!?。！？．\]”»\"’>]$|\([^()]*\)$|\bv\.\s?v$|\betc$")
_NUMBERING = re.compile(r"(?:điều\s+)?\d+(?:\.\d+)*[.)]?$|[a-zđ]\)$", re.I)
_SENTENCE = re.compile(r"[.!?;](?:\s|$)")


def opening(line: str) -> str:
    """The kind of a line: its first two tokens, digits as 9."""
    return " ".join(_DIGITS.sub("9", line[:60]).split()[:2])


def _lines(text: str) -> list[str]:
    return [x for x in text.splitlines() if x.strip()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, and line openings by whether the line is its text's last; combined within the task."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        kinds, names = [k for k, _ in counts], [n for _, n in counts]
        batch = pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(list(counts.values()), pa.int64())], ["kind", "name", "n"])
        counts.clear()
        return batch

    for batch in batches:
        words: Counter = Counter()
        for text in batch.column(0).to_pylist():
            form = one_form(text)
            words.update(_WORD.findall(form.lower()))
            lines = _lines(form)
            single = len(lines) == 1 and (_SENTENCE.search(form) or _CLOSED.search(form.rstrip()))
            for i, line in enumerate(lines, 1):
                counts["last" if i == len(lines) and not single else "inner", opening(line)] += 1
        for word, n in words.items():
            counts["word", word] += n
        if len(counts) > FLUSH:
            yield flush()
    yield flush()


_ENDING = StructType(
    [
        StructField("chars", IntegerType()),
        StructField("bytes", IntegerType()),
        StructField("open", BooleanType()),
        StructField("broken", BooleanType()),
        StructField("omitted", BooleanType()),
        StructField("title", BooleanType()),
        StructField("token", StringType()),
        StructField("opening", StringType()),
    ]
)
_ARROW_ENDING = pa.struct(
    [
        *((c, pa.int32()) for c in ("chars", "bytes")),
        *((c, pa.bool_()) for c in ("open", "broken", "omitted", "title")),
        *((c, pa.string()) for c in ("token", "opening")),
    ]
)


#: Longest broken mark, and how much of an end is looked at before all of it is.
_MARK, _END = 30, 256


def _without_omission(text: str) -> str:
    """The text without white space and marks of omission at its end, however long they are."""
    found = _OMISSION.search(text, max(0, len(text) - _END))
    if found and found.start() <= max(0, len(text) - _END):
        found = _OMISSION.search(text)
    return text[: found.start()] if found else text


def judge_ending(text: str) -> dict:
    """What the end of a text shows by itself."""
    core = whole = _without_omission(text)
    broken = _BROKEN.search(core, max(0, len(core) - _MARK))
    if broken:
        core = _without_omission(core[: broken.start()])
    core = core.rstrip()
    at = max(core.rfind("\n"), core.rfind("\r"))
    form = one_form(core[at + 1 :]).strip()
    line = form.splitlines()[-1].strip() if form else ""
    numbered = bool(_NUMBERING.fullmatch(line))
    open_end = bool(form) and (not _CLOSED.search(form) or numbered)
    word = re.search(r"(\w+)$", form)
    return {
        "chars": len(text),
        "bytes": len(text.encode()),
        "open": open_end,
        "broken": bool(broken) and bool(form),
        "omitted": text.rstrip() != whole and any(x in text[len(whole) :] for x in ("…", "...")),
        "title": at < 0 and len(line.split()) <= TITLE_WORDS and not _SENTENCE.search(form),
        "token": word.group(1).lower() if word else None,
        "opening": opening(line) if not numbered and (len(line.split()) <= CLOSING_WORDS or at < 0) else None,
    }


@F.arrow_udf(_ENDING)
def endings(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None or not t.strip() else judge_ending(t) for t in texts.to_pylist()], _ARROW_ENDING)


def truncated_texts(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Rows ``key, source, truncated, within_word, at_limit, stamped`` for every row with a text.

    Everything is counted over different texts, so copies tell nothing about a word, an opening, a limit or a stamp. A
    task keeps one copy of a text before texts are moved; counts are combined within tasks too. The vocabulary, its prefixes, limits and stamps are
    tables joined by their keys, never sent to the driver. The endings are judged on the whole text's lengths and its
    last line.

    Null, empty and blank texts are left out; a null source is a source of its own; repeated rows each give a row; an
    empty table gives none; other columns are ignored, whatever their names."""
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"), F.unhex(F.md5(text)).alias("cls"))
    texts = rows.where("text is not null").groupBy("cls").agg(F.any_value("text").alias("text")).select("text")
    counts = texts.mapInArrow(_count, "kind string, name string, n long").groupBy("kind", "name").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "counts")
    last = F.sum(F.when(F.col("kind") == "last", F.col("n")).otherwise(0))
    lines = materialize(counts.where("kind <> 'word'").groupBy("name").agg(last.alias("last"), F.sum("n").alias("all")), "openings")
    # a line cut within its opening would look like a kind of its own that only ends texts
    under = _prefixes(lines.where("all > last").select("name", (F.col("all") - F.col("last")).alias("n"))).groupBy("token").agg(F.sum("n").alias("under"))
    kinds = lines.join(under.withColumnRenamed("token", "name"), "name", "left").withColumn("seen", F.col("all") + F.coalesce("under", F.lit(0)))
    mostly = F.col("last") >= CLOSING_SHARE * F.col("seen")
    kinds = kinds.select(F.col("name").alias("opening"), (mostly & (F.col("last") >= CLOSING_LINES)).alias("closing"), (~mostly).alias("running"))

    judged = rows.select("key", F.coalesce("source", F.lit("")).alias("s"), "source", "cls", endings("text").alias("e"), F.monotonically_increasing_id().alias("row"))
    # written before it is filtered: a filter on a function's result would run the function twice
    judged = materialize(judged, "endings").where("e is not null").select("row", "key", "s", "source", "cls", "e.*")

    tokens = _final_tokens(counts.where("kind = 'word'").select("name", "n"), judged.select("cls", "token", "open").distinct())
    measured = judged.where("open").select("s", "cls", "chars", "bytes").distinct().select("s", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("m")).select("s", "m.*")
    totals = measured.where("unit = 'chars'").groupBy("s").agg(F.count("*").alias("of"))
    limits = measured.groupBy("s", "unit", "size").count().join(totals, "s").where((F.col("count") >= LIMIT_TEXTS) & (F.col("count") >= LIMIT_SHARE * F.col("of"))).select("s", "unit", "size")
    limits = materialize(limits, "limits")
    by_chars = limits.where("unit = 'chars'").select("s", F.col("size").alias("chars"), F.lit(True).alias("char_limit"))
    by_bytes = limits.where("unit = 'bytes'").select("s", F.col("size").alias("bytes"), F.lit(True).alias("byte_limit"))

    stamped = _stamped(rows.where("text is not null").select(F.coalesce("source", F.lit("")).alias("s"), "cls", "text"), judged.where("not open and not omitted").select("cls").distinct(), limits)

    doubtful = judged.where("open or omitted or broken")
    doubtful = doubtful.join(kinds, "opening", "left").join(by_chars, ["s", "chars"], "left").join(by_bytes, ["s", "bytes"], "left")
    doubtful = doubtful.join(tokens, "token", "left")
    within = F.col("open") & F.coalesce("fragment", F.lit(False))
    limit = F.coalesce("char_limit", "byte_limit", F.lit(False))
    closing, running = (F.coalesce(c, F.lit(False)) for c in ("closing", "running"))
    closed = closing | (F.col("title") & ~limit & ~running)
    unfinished = F.col("token").isNull() | F.coalesce("known", F.lit(False)) | limit | F.col("omitted")
    cut = F.col("broken") | within | (F.col("open") & unfinished & (~closed | F.col("omitted"))) | (F.col("omitted") & limit)
    found = doubtful.select("row", within.alias("within_word"), limit.alias("at_limit"), cut.alias("cut"))
    out = judged.select("row", "cls", "key", "source").join(found, "row", "left").join(stamped, "cls", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("within_word", "at_limit", "stamped")]
    truncated = F.coalesce("cut", F.lit(False)) | F.coalesce("stamped", F.lit(False))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), truncated.alias("truncated"), *flags)


def _stamped(texts: DataFrame, closed: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows ``cls, stamped`` of texts ``s, cls, text`` among the ``closed`` ones that end with a stamp: what stands behind
    limits ``s, unit, size`` in several texts, and in a good share of all texts that end so. Endings are compared by
    hashes, whatever their length."""
    blank = F.lit(_BLANKS)
    ended = texts.select("s", "cls", F.rtrim("text", blank).alias("text"))
    size = F.when(F.col("unit") == "chars", F.length("text")).otherwise(F.octet_length("text"))
    rest = F.when(F.col("unit") == "chars", F.substring("text", F.col("size") + 1, F.length("text"))).otherwise(
        F.substring(F.encode("text", "UTF-8"), F.col("size") + 1, F.octet_length("text")).cast("string")
    )
    tail = F.ltrim(rest, blank)
    behind = ended.join(limits, "s").where(size > F.col("size")).select("cls", tail.alias("tail")).where("tail <> ''")
    behind = behind.select("cls", F.length("tail").alias("k"), *_ending("tail")).distinct().join(closed, "cls")
    likely = materialize(behind.groupBy("k", "e1", "e2").agg(F.count("*").alias("at")).where(F.col("at") >= STAMP_TEXTS), "tails")
    lengths = likely.agg(F.collect_set("k").alias("lengths"), F.max("k").alias("most"))
    # the end that holds every stamp is taken from a text once; equal texts give equal rows, which are combined later
    ends = ended.crossJoin(F.broadcast(lengths)).select("cls", "lengths", F.expr("right(text, most)").alias("end"))
    ends = ends.select("cls", "end", F.explode(F.filter("lengths", lambda k: k <= F.length("end"))).alias("k"))
    ends = ends.select("cls", "k", *_ending(F.expr("right(end, k)"))).join(likely, ["k", "e1", "e2"]).distinct().join(closed, "cls")
    ends = materialize(ends, "ends")
    stamps = ends.groupBy("k", "e1", "e2").agg(F.count("*").alias("all"), F.any_value("at").alias("at")).where(F.col("at") >= STAMP_SHARE * F.col("all"))
    return ends.join(stamps.select("k", "e1", "e2"), ["k", "e1", "e2"], "left_semi").select("cls", F.lit(True).alias("stamped")).distinct()


def _ending(text: Column | str) -> list[Column]:
    """128 bits of an ending."""
    text = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(text, F.lit(seed)).alias(f"e{seed}") for seed in (1, 2)]


def _final_tokens(words: DataFrame, finals: DataFrame) -> DataFrame:
    """Rows ``token, fragment, known`` of the tokens that open endings stop on: whether the trie has it as a beginning of
    words rather than a word, and whether texts use it inside; from the uses ``n`` of every ``name`` in all texts and a row
    ``token, open`` for every text. A text's own final token isn't a use inside texts."""
    ends = materialize(finals.where("token is not null").groupBy("token").agg(F.count("*").alias("finals"), F.count_if("open").alias("ends")), "finals")
    inside = words.join(ends, words["name"] == ends["token"], "left").select("name", (F.col("n") - F.coalesce("finals", F.lit(0))).alias("n")).where("n > 0")
    inside = materialize(inside, "inside")
    ends = ends.where("ends > 0").select("token", "ends")
    # of the trie only nodes as deep as some final token: one row of lengths, each of another token
    lengths = ends.agg(F.collect_set(F.length("token")).alias("lengths"))
    longer = inside.crossJoin(F.broadcast(lengths)).select("n", "name", F.explode(F.filter("lengths", lambda k: k < F.length("name"))).alias("k"))
    longer = longer.groupBy(F.substring(F.col("name"), F.lit(1), F.col("k")).alias("token")).agg(F.sum("n").alias("longer"))
    totals = inside.agg(F.sum("n").alias("tokens")).crossJoin(ends.agg(F.sum("ends").alias("open_ends")))
    used = ends.join(longer, "token", "left").join(inside.withColumnRenamed("name", "token"), "token", "left").fillna(0, ["n", "longer"])
    begins = F.col("longer") > 0
    rare = F.col("n") <= INSIDE_SHARE * F.col("longer")
    extended = F.col("longer") >= EXTENDED * F.col("ends")
    often_last = F.col("ends") * F.col("tokens") >= OFTEN_LAST * F.col("n") * F.col("open_ends")
    return used.crossJoin(F.broadcast(totals)).select("token", (begins & rare & extended & often_last).alias("fragment"), (F.col("n") > 0).alias("known"))


def _prefixes(names: DataFrame) -> DataFrame:
    """The inner nodes of a trie: a row ``token`` for every proper prefix of every ``name``, with its other columns."""
    lengths = F.sequence(F.lit(1), F.length("name") - 1)
    others = [c for c in names.columns if c != "name"]
    return names.where(F.length("name") > 1).select(*others, F.explode(F.transform(lengths, lambda i: F.substring(F.col("name"), F.lit(1), i))).alias("token"))


def shares_by_source(found: DataFrame, source: str) -> DataFrame:
    """Rows ``source, texts, truncated, share, within_word, at_limit, stamped``."""
    cut = F.col("truncated")
    return found.groupBy(source).agg(
        F.count("*").alias("texts"),
        F.count_if(cut).alias("truncated"),
        F.round(F.count_if(cut) / F.count("*"), 6).alias("share"),
        *(F.count_if(cut & F.col(c)).alias(c) for c in ("within_word", "at_limit", "stamped")),
    )
