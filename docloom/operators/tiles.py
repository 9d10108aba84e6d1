"""Comparing the records of a bucket within a task, so that only pairs worth a look leave it.

A tile is a bucket, or a block of a large one against another; its rows reach one task in the order of the tiles. A row
has a role: 0 asks and answers, 1 only asks, 2 only answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Tiles of up to so many rows are compared place by place, many at once; larger ones as a matrix, so many rows at once.
NARROW, ROWS = 64, 512

Possible = Callable[[np.ndarray, np.ndarray], np.ndarray]


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of complete tiles; the first column is the tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        tiles = batch.column(0).to_numpy()
        if not len(tiles):
            continue
        if held and held[-1].column(0)[-1].as_py() != tiles[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        ends = np.flatnonzero(tiles[1:] != tiles[:-1]) + 1
        if len(ends):
            yield pa.Table.from_batches([*held, batch.slice(0, int(ends[-1]))]).combine_chunks()
            held = [batch.slice(int(ends[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def meetings(tile: np.ndarray, role: np.ndarray, possible: Possible) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``i, j`` of rows of one tile of which one asks and the other answers and that are ``possible``, each pair
    once; in larger tiles ``i`` asks."""
    starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    sizes = np.diff(np.append(starts, len(tile)))
    last = np.repeat(starts + sizes, sizes)  # the end of each row's tile
    i = np.flatnonzero(np.repeat((sizes <= NARROW) & (sizes > 1), sizes))
    for step in range(1, NARROW):
        i = i[i + step < last[i]]
        if not len(i):
            break
        j = i + step
        meets = (role[i] != 2) & (role[j] != 1) | (role[i] != 1) & (role[j] != 2)
        x = i[meets]
        x = x[possible(x, x + step)]
        if len(x):
            yield x, x + step
    for lo, size in zip(starts[sizes > NARROW], sizes[sizes > NARROW]):
        span = np.arange(lo, lo + size)
        asks, answers = span[role[span] != 2], span[role[span] != 1]
        for at in range(0, len(asks), ROWS):
            a = asks[at : at + ROWS]
            i, j = np.nonzero(possible(a[:, None], answers[None, :]))
            i, j = a[i], answers[j]
            once = (role[i] != 0) | (role[j] != 0) | (i < j)
            if once.any():
                yield i[once], j[once]
