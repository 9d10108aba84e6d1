"""The same or nearly the same records across splits, by winnowing fingerprints.

Every text becomes its words (one form, lower case, no accents). A rolling hash covers every run of ``K`` words, and of
every ``WINDOW`` consecutive runs the smallest is selected, where rare runs count as smaller: both sides select from
any shared run of ``K + WINDOW - 1`` words the same fingerprint. Texts whose words were shuffled meet by ``FREE`` hashes
of ``TOGETHER`` smallest words, whatever their order. Fingerprints of the splits meet within tasks, and a pair that could
reach the threshold (by its sizes and a bitmap of its words, a bound that never errs) is a candidate.

The seeds of a candidate are chained collinearly and extended by alignment. What lies in the runs is shared, so a chain
that covers enough proves the overlap; only where it doesn't, the two sets of words are compared.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from docloom.operators.tiles import meetings, whole_tiles
from docloom.llm.words import folded_words, mixed, rolling_hashes, word_hashes
from docloom.session import discard, materialize

K = 6
WINDOW = 4
#: Buckets of the histogram that tells rare runs from frequent ones: 2**16 counts, whatever the input.
HISTOGRAM_BITS = 16
SIGNATURE_WORDS = 2  # of 64 bits: b0 and b1
#: Hashes of smallest words a text, and words in each. Of shuffled texts at two thirds 9e-4 share none, at 3/4 2e-5.
FREE, TOGETHER = 20, 3
#: Sets of up to so many words also have a hash of every two neighbours in sorted order, which finds every pair of them.
SMALL = 12
#: Records of a side of a bucket that are compared at once.
TILE = 4096

_FACTORS = mixed(np.arange(1, FREE + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_FREE_SALTS = mixed(np.arange(FREE, dtype=np.uint64) + np.uint64(1 << 32))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text that has any, joined by spaces."""
    for batch in batches:
        side, cls, words = [], [], []
        for s, c, text in zip(*(column.to_pylist() for column in batch.columns)):
            if found := folded_words(text):
                side.append(s)
                cls.append(c)
                words.append(" ".join(found))
        yield pa.RecordBatch.from_arrays([pa.array(side, pa.string()), pa.array(cls, pa.binary()), pa.array(words, pa.string())], ["side", "cls", "words"])


def _hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts of a batch one after another, and where each text begins (and the end)."""
    lists = [text.split(" ") for text in words.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return word_hashes(list(chain.from_iterable(lists))), offsets


def _runs(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rolling hashes of all places of a batch, and how many are runs of each text, from its beginning on. A text
    shorter than a run is one run by itself."""
    out = np.zeros(len(hashes), np.uint64)
    whole = rolling_hashes(hashes, K)
    out[: len(whole)] = whole
    sizes = np.diff(offsets)
    for i in np.flatnonzero(sizes < K):
        out[offsets[i]] = rolling_hashes(hashes[offsets[i] : offsets[i + 1]], int(sizes[i]))[0]
    return out, np.maximum(sizes - K + 1, 1)


def _places(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``counts`` places of every text of a batch."""
    return np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many runs fall into each bucket of the histogram, over the whole task."""
    counts = np.zeros(1 << HISTOGRAM_BITS, np.int64)
    for batch in batches:
        hashes, offsets = _hashed(batch.column(0))
        runs, n = _runs(hashes, offsets)
        counts += np.bincount((runs[_places(offsets, n)] >> np.uint64(64 - HISTOGRAM_BITS)).astype(np.int64), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["b", "n"])


def _histogram(texts: DataFrame) -> bytes:
    """The logarithm of how many runs fall into each bucket: a result of fixed size, whatever the input."""
    levels = np.zeros(1 << HISTOGRAM_BITS, np.uint8)
    for b, count in texts.select("words").mapInArrow(_count_runs, "b long, n long").groupBy("b").agg(F.sum("n")).collect():
        levels[b] = 2 * np.log2(count)
    return levels.tobytes()


def winnow(keys: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places selected by winnowing, over all texts of a batch: of every window of ``WINDOW`` runs of a text the one with
    the smallest key, the rightmost of equal ones; a text of fewer runs is one window."""
    picked = []
    for size in range(1, WINDOW + 1):
        these = counts >= WINDOW if size == WINDOW else counts == size
        if these.any():
            first = _places(np.append(offsets[:-1][these], 0), counts[these] - size + 1)
            windows = keys[first[:, None] + np.arange(size)[None, ::-1]]
            picked.append(first + size - 1 - windows.argmin(1))
    return np.unique(np.concatenate(picked)) if picked else np.empty(0, np.int64)


def _small_hashes(ordered: np.ndarray) -> np.ndarray:
    """Pairs of neighbours in the sorted set of words, and the words of a set of up to three.

    Of two sets with u words in their union and o >= 2/3 u in common, the u - o others can part at most u - o of the
    o - 1 neighbouring pairs of common words; for u > 3 one is left."""
    pairs = mixed(rolling_hashes(ordered, 2) ^ np.uint64(1))
    return np.concatenate([pairs, mixed(ordered ^ np.uint64(2))]) if len(ordered) <= 3 else pairs


def _free_hashes(sets: np.ndarray) -> np.ndarray:
    """For every row of ``sets`` (words of sets of equal size) the hashes of its smallest words under each of ``FREE`` hash
    functions."""
    with np.errstate(over="ignore"):
        ranks = sets.astype(np.uint32)[:, None, :] * _FACTORS[:, None]
        smallest = np.argpartition(ranks, TOGETHER - 1, axis=2)[:, :, :TOGETHER]
        together = np.sort(np.take_along_axis(np.broadcast_to(sets[:, None, :], ranks.shape), smallest, 2), axis=2)
        out = _FREE_SALTS
        for i in range(TOGETHER):
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + together[:, :, i])
        return out


def _unordered(words: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows ``set, hash`` of the hashes that don't depend on order, for sets of sorted words one after another."""
    sizes, found = np.diff(starts), []
    for n in np.unique(sizes[sizes > TOGETHER]):
        which = np.flatnonzero(sizes == n)
        for part in np.array_split(which, max(1, len(which) * int(n) * FREE >> 22)):
            found.append((np.repeat(part, FREE), _free_hashes(words[starts[part][:, None] + np.arange(n)]).ravel()))
    for i in np.flatnonzero((sizes <= SMALL) & (sizes > 0)):
        small = _small_hashes(words[starts[i] : starts[i + 1]])
        found.append((np.full(len(small), i), small))
    return found


_SEEDS = "role int, id long, n int, b0 long, b1 long, seeds array<struct<h: long, at: int>>"


def _fingerprint(batches: Iterator[pa.RecordBatch], levels: bytes) -> Iterator[pa.RecordBatch]:
    """Size of each set of words, its bitmap, and the selected fingerprints: winnowed runs with their places, and hashes
    without a place (-1) that don't depend on order."""
    level = np.frombuffer(levels, np.uint8).astype(np.uint64)
    for batch in batches:
        hashes, offsets = _hashed(batch.column(2))
        runs, counts = _runs(hashes, offsets)
        keys = (level[(runs >> np.uint64(64 - HISTOGRAM_BITS)).astype(np.int64)] << np.uint64(56)) | (runs >> np.uint64(8))
        at = winnow(keys, offsets, counts)
        text = np.searchsorted(offsets, at, "right") - 1
        found = [(text, runs[at], (at - offsets[text]).astype(np.int32))]

        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        words = mixed(hashes)
        order = np.lexsort((words, owner))
        owner, words = owner[order], words[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (words[1:] != words[:-1])]) if len(words) else np.empty(0, bool)
        owner, words = owner[new], words[new]
        starts = np.searchsorted(owner, np.arange(len(offsets)))
        bits = np.zeros((len(offsets) - 1, SIGNATURE_WORDS), np.uint64)
        np.bitwise_or.at(bits, (owner, ((words >> np.uint64(8)) % np.uint64(SIGNATURE_WORDS)).astype(np.int64)), np.uint64(1) << (words % np.uint64(64)))
        found += [(which, free, np.full(len(free), -1, np.int32)) for which, free in _unordered(words, starts)]
        text, h, place = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(text, kind="stable")
        items = pa.StructArray.from_arrays([pa.array(h[by].view(np.int64)), pa.array(place[by])], ["h", "at"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[by], np.arange(len(offsets))).astype(np.int32)), items)
        bitmaps = [pa.array(np.ascontiguousarray(column)) for column in bits.view(np.int64).T]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(starts).astype(np.int32)), *bitmaps, lists], ["role", "id", "n", "b0", "b1", "seeds"])


# --- verification ---

_KIND = StructType([StructField("found", BooleanType()), StructField("chained", BooleanType()), *(StructField(c, IntegerType()) for c in ("shared", "union", "seeds", "left_words", "right_words"))])


def chain_and_extend(a: list[str], b: list[str], seeds: list[tuple[int, int]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Seeds in the longest collinear chain, and which words of each list lie in the chain's runs after extending them in
    both directions as long as the words agree. A seed is where a run begins in ``a`` and in ``b``."""
    k = min(K, len(a), len(b))
    along = _longest_chain(seeds)
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for i, j in along:
        if in_a[i : i + k].all() and in_b[j : j + k].all():
            continue  # within the run of a seed before
        lo = 0
        while i > lo and j > lo and a[i - lo - 1] == b[j - lo - 1]:
            lo += 1
        hi = k
        while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
            hi += 1
        in_a[i - lo : i + hi] = True
        in_b[j - lo : j + hi] = True
    return len(along), in_a, in_b


def _longest_chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that rises in both coordinates (patience sorting)."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    seeds = sorted(seeds, key=lambda s: (s[0], -s[1]))
    for at, (_, j) in enumerate(seeds):
        k = bisect_left(tails, j)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(j)
            ends.append(at)
        else:
            tails[k], ends[k] = j, at
    chain, at = [], ends[-1] if ends else -1
    while at >= 0:
        chain.append(seeds[at])
        at = back[at]
    return chain[::-1]


def verify_pair(a: list[str], b: list[str], seeds: list[tuple[int, int]], num: int, den: int) -> dict:
    """Whether two lists of words share ``num/den`` of their sets' union, and whether the chained seeds prove it."""
    chained, in_a, in_b = chain_and_extend(a, b, seeds)
    x, y = set(a), set(b)
    covered = len({a[i] for i in np.flatnonzero(in_a)})
    proven = den * covered >= num * (len(x) + len(y) - covered)
    shared = len(x & y)
    union = len(x) + len(y) - shared
    found = proven or den * shared >= num * union
    return {"found": found, "chained": proven, "shared": shared, "union": union, "seeds": chained, "left_words": int(in_a.sum()), "right_words": int(in_b.sum())}


def _verifier(num: int, den: int):
    names = [f.name for f in _KIND.fields]

    @F.arrow_udf(_KIND)
    def verify(left: pa.Array, right: pa.Array, seeds: pa.Array) -> pa.Array:
        rows = zip(left.to_pylist(), right.to_pylist(), seeds.to_pylist())
        found = [verify_pair(a.split(" "), b.split(" "), [(s["l"], s["r"]) for s in places], num, den) for a, b, places in rows]
        return pa.array(found, pa.struct([(c, pa.bool_() if c in names[:2] else pa.int32()) for c in names]))

    return verify


# --- candidates ---


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows ``tile, role, id, at, n, b0, b1`` from rows ``h, role, ..., lefts, rights``: a bucket is one tile, or a tile
    for every two blocks of its sides."""
    fields = ["id", "at", "n", "b0", "b1"]
    left = F.col("role") == 1
    large = (F.col("lefts") > TILE) | (F.col("rights") > TILE)
    small = rows.where(~large).select(F.col("h").alias("tile"), "role", *fields)
    blocks = {s: F.ceil(F.col(s) / TILE).cast("int") for s in ("lefts", "rights")}
    own, others = (F.when(left, a).otherwise(b) for a, b in ((blocks["lefts"], blocks["rights"]), (blocks["rights"], blocks["lefts"])))
    dealt = rows.where(large).select("h", "role", *fields, F.pmod(F.xxhash64("id"), own).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    a, b = (F.when(left, F.col(x)).otherwise(F.col(y)) for x, y in (("own", "other"), ("other", "own")))
    return small.unionByName(dealt.select(F.xxhash64("h", a, b).alias("tile"), "role", *fields))


def _compare(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows ``a, b, l, r``: pairs of a left and a right record of a tile that can share ``num/den`` of their union, by
    their sizes and bitmaps, and the places of the fingerprint. A bit that differs needs a word that differs, so this
    never drops a pair that does."""
    for table in whole_tiles(batches):
        tile, role, ids, at, n = (table[c].to_numpy() for c in ("tile", "role", "id", "at", "n"))
        b0, b1 = (table[c].to_numpy().view(np.uint64) for c in ("b0", "b1"))

        def possible(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            # |A u B| = (n + m + d) / 2 and |A n B| = (n + m - d) / 2, where d words are on one side only
            near = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
            differing = np.bitwise_count(b0[i] ^ b0[j]).astype(np.int32) + np.bitwise_count(b1[i] ^ b1[j])
            return near & (differing * (num + den) <= (n[i] + n[j]) * (den - num))

        for i, j in meetings(tile, role, possible):
            l, r = np.where(role[i] == 1, i, j), np.where(role[i] == 1, j, i)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[l], ids[r], at[l], at[r])], ["a", "b", "l", "r"])


def overlapping_records(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str, num: int = 2, den: int = 3) -> DataFrame:
    """Rows ``left_key, right_key, shared, union, chained, seeds, left_cover, right_cover``: pairs of a record of ``left``
    and one of ``right`` whose sets of words share at least ``num/den`` of their union; whether the chain of their seeds
    proves it, its length, and the part of each text that lies in its extended runs.

    Equal texts form a class; classes are compared, and their members joined to the result, so copies cost nothing but
    their own rows. The only data on the driver is a histogram of 2**16 counts. Every pair that shares a run of
    ``K + WINDOW - 1`` words is a candidate (texts shorter than a run: the same whole text); of pairs without such a run
    at ``num/den`` = 2/3 9e-4 are missed, 2e-5 at 3/4, and none of sets of up to ``SMALL`` words.

    Null keys, and texts that are null, blank or without a word don't count; repeated rows count once; empty tables
    give no rows; other columns are ignored, whatever their names."""
    rows = [df.select(F.lit(s).alias("side"), F.col(k).cast("string").alias("key"), F.col(text).alias("text")) for df, k, s in ((left, left_key, "l"), (right, right_key, "r"))]
    rows = rows[0].unionByName(rows[1]).where("key is not null and text is not null")
    cls = F.unhex(F.md5("text")).alias("cls")
    texts = rows.groupBy("side", cls).agg(F.any_value("text").alias("text")).mapInArrow(_fold, "side string, cls binary, words string")
    texts = materialize(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    role = F.when(F.col("side") == "l", 1).otherwise(2).alias("role")
    marked = texts.select(role, "id", "words").mapInArrow(partial(_fingerprint, levels=_histogram(texts)), _SEEDS)
    marked = materialize(marked, "fingerprints")
    seeds = marked.select("role", "id", F.explode("seeds").alias("s")).select("role", "id", "s.h", "s.at")
    sides = seeds.groupBy("h").agg(F.count_if(F.col("role") == 1).alias("lefts"), F.count_if(F.col("role") == 2).alias("rights")).where("lefts > 0 and rights > 0")
    met = seeds.join(sides, "h").join(marked.select("id", "n", "b0", "b1"), "id")
    tiles = _tiles(met).repartition("tile").sortWithinPartitions("tile")
    places = tiles.mapInArrow(partial(_compare, num=num, den=den), "a long, b long, l int, r int")
    # a record has a bounded number of seeds for its length, and so has a pair
    pairs = places.groupBy("a", "b").agg(F.collect_set(F.when(F.col("l") >= 0, F.struct("l", "r"))).alias("seeds"))
    pairs = materialize(pairs, "pairs")
    words = {s: texts.where(F.col("side") == s) for s in ("l", "r")}
    both = pairs.join(words["l"].select(F.col("id").alias("a"), F.col("words").alias("wa"), F.col("cls").alias("ca")), "a")
    both = both.join(words["r"].select(F.col("id").alias("b"), F.col("words").alias("wb"), F.col("cls").alias("cb")), "b")
    sizes = [F.size(F.split(w, " ")).alias(f"n{w[1]}") for w in ("wa", "wb")]
    # written before it is filtered: a filter on a function's result would run the function twice
    judged = materialize(both.select("ca", "cb", *sizes, _verifier(num, den)("wa", "wb", "seeds").alias("v")), "judged").where("v.found")
    discard(pairs, marked)
    covers = [(F.col(f"v.{c}_words") / F.col(n)).alias(f"{c}_cover") for c, n in (("left", "na"), ("right", "nb"))]
    scored = judged.select("ca", "cb", "v.shared", "v.union", "v.chained", "v.seeds", *covers)
    ids = {s: rows.where(F.col("side") == s).select(cls.alias(c), F.col("key").alias(k)).distinct() for s, c, k in (("l", "ca", "left_key"), ("r", "cb", "right_key"))}
    return scored.join(ids["l"], "ca").join(ids["r"], "cb").drop("ca", "cb")


def matching_answers(left: str, right: str) -> Column:
    """Whether two arrays share an element, or one of them is null or empty."""
    empty = F.col(left).isNull() | F.col(right).isNull() | (F.size(left) == 0) | (F.size(right) == 0)
    return F.coalesce(empty | F.arrays_overlap(left, right), F.lit(False))
