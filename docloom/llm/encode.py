"""Encoding a corpus with a public byte-level BPE tokenizer, with reuse of content-defined chunks.

A text is cut where a rolling hash over its bytes says so, but only before a space that a visible character follows: the
tokenizer's own pre-tokenization always breaks there, so the ids of the chunks, put together, are the ids of the text.
A stretch without such a place that grows too long is cut at a fixed length first, and the join is then repaired: the
pieces of the pre-tokenization are followed from the last exact join until one of them ends at or after the cut, and the
join moves there. Each process encodes a chunk it has met before only once; nothing is shuffled, as moving the texts to
their copies would cost more than encoding them (see the README).
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: A cut needs this many zero bits of the rolling hash: one in 16 of the possible places.
MASK_BITS = 4
#: Bytes the rolling hash sees before a place.
HASH_WINDOW = 8
#: Bytes after which a stretch without a place to cut is cut by length.
MAX_CHUNK = 1 << 14
#: Bytes of chunks and ids a process remembers before it forgets all of them.
MEMO_BYTES = 48 << 20


def default_path(name: str = "byte_bpe_50k") -> str:
    """Where the installed vocabulary lies; any other path can be given instead."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


@lru_cache(maxsize=4)
def load_encoding(path: str):
    """The tokenizer of a vocabulary file of ranks, and its pre-tokenization; special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
    pattern = public_tokenizers.PATTERN
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)


# First bytes of UTF-8 characters some of which are white space; a space before them is never a place to cut.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def cut_places(data: np.ndarray) -> np.ndarray:
    """Positions in UTF-8 bytes where the content says to cut, in order."""
    n = len(data)
    spaces = np.flatnonzero(data[:-1] == 0x20) if n > 1 else np.empty(0, np.int64)
    spaces = spaces[(spaces >= HASH_WINDOW)]
    spaces = spaces[~_MAY_BE_SPACE[data[spaces + 1]]]
    rolled = np.zeros(len(spaces), np.uint32)
    with np.errstate(over="ignore"):
        for back in range(HASH_WINDOW, 0, -1):
            rolled = rolled * np.uint32(0x01000193) + data[spaces - back]
        rolled = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return spaces[(rolled >> np.uint32(32 - MASK_BITS)) == 0]


class ChunkEncoder:
    """Encodes texts chunk by chunk and remembers the chunks; one for each process and vocabulary."""

    def __init__(self, path: str):
        self.encoding, self.pieces = load_encoding(path)
        self.memo: dict[bytes, bytes] = {}
        self.held = 0

    def _encode(self, chunk: bytes) -> bytes:
        """The ids of a chunk as int32 bytes."""
        return self.encoding.encode_to_numpy(chunk.decode(), disallowed_special=()).astype(np.uint32, copy=False).tobytes()

    def _reused(self, chunk: bytes) -> bytes:
        ids = self.memo.get(chunk)
        if ids is None:
            ids = self._encode(chunk)
            if len(chunk) <= MAX_CHUNK:
                self.held += len(chunk) + len(ids) + 150
                if self.held > MEMO_BYTES:
                    self.memo.clear()
                    self.held = 0
                self.memo[chunk] = ids
        return ids

    def _repaired(self, stretch: bytes) -> list[bytes]:
        """A long stretch cut by length, with every join moved to where the pre-tokenization really breaks."""
        text, out, start, size = stretch.decode(), [], 0, 0
        for piece in self.pieces.finditer(text):
            size += len(piece.group().encode())
            if size >= MAX_CHUNK:
                out.append(text[start : piece.end()].encode())
                start, size = piece.end(), 0
        return out + [text[start:].encode()] if start < len(text) else out

    def encode_buffer(self, data: bytes, bounds: np.ndarray) -> list[bytes]:
        """The ids of every text of a buffer; text i lies between ``bounds[i]`` and ``bounds[i + 1]``."""
        places = cut_places(np.frombuffer(data, np.uint8)) if data else np.empty(0, np.int64)
        # a hash that looks back over the start of its text doesn't matter: the cut is exact anyway
        edges = np.unique(np.concatenate([places, bounds]))
        first = np.searchsorted(edges, bounds).tolist()
        edges = edges.tolist()
        out = []
        reused, memo = self._reused, self.memo
        for i in range(len(bounds) - 1):
            parts = []
            for k in range(first[i], first[i + 1]):
                chunk = data[edges[k] : edges[k + 1]]
                if len(chunk) > MAX_CHUNK:
                    parts.extend(map(reused, self._repaired(chunk)))
                else:
                    parts.append(memo.get(chunk) or reused(chunk))
            out.append(b"".join(parts))
        return out

    def encode(self, text: str) -> list[int]:
        data = text.encode()
        return np.frombuffer(self.encode_buffer(data, np.array([0, len(data)]))[0], np.int32).tolist()


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _buffer(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a string array and the bounds of its texts; null texts are empty."""
    filled = texts.fill_null("").cast(pa.large_string())
    filled = pa.concat_arrays([filled]) if filled.offset else filled
    _, offsets, data = filled.buffers()
    bounds = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = data.to_pybytes()[bounds[0] : bounds[-1]] if data is not None else b""
    return raw, bounds - bounds[0]


def ids_column(path: str):
    """Column function: the ids of each text; an empty list for empty and for null texts."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        found = _encoder(path).encode_buffer(*_buffer(texts))
        offsets = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
        ids = np.frombuffer(b"".join(found), np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    return encode


def token_counts(path: str):
    """Column function: how many ids each text has."""

    @F.arrow_udf(IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(x) // 4 for x in _encoder(path).encode_buffer(*_buffer(texts))], pa.int32())

    return count


def encode_texts(df: DataFrame, text: str, into: str = "ids", path: str | None = None) -> DataFrame:
    """Add the column ``into`` with the ids of ``text``, without special tokens, whose strings are ordinary text.

    One narrow pass over the rows. Empty and null texts have an empty list; repeated rows are encoded each, from the
    same chunks; other columns stay as they are, and ``into`` is replaced if it exists. ``path`` names a vocabulary file
    of ranks that every executor can read."""
    return df.withColumn(into, ids_column(path or default_path())(F.col(text)))
