"""Arrow batches a few rows at a time: a worker holds Python's copies of a piece, never of a whole batch, so what it needs grows neither with the rows of a batch nor with what is made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS, BYTES = 512, 1 << 20


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value: texts, bytes, or lists of them."""
    if pa.types.is_list(column.type):
        ends, at = np.concatenate([[0], np.cumsum(sizes(column.values))]), column.offsets.to_numpy()
        return ends[at[1:]] - ends[at[:-1]]
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def pieces(column: pa.Array, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.Array]:
    """The column in order, `rows` and `size` bytes at most in each piece; a longer value is a piece of its own. An empty column is one piece."""
    ends, at = np.cumsum(sizes(column)), 0
    if not len(column):
        yield column
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield column.slice(at, stop - at)
        at = stop


def mapped(call: Callable, column: pa.Array, kind: pa.DataType) -> pa.Array:
    """call of each value (null stays null)."""
    return pa.concat_arrays([pa.array([None if x is None else call(x) for x in piece.to_pylist()], kind) for piece in pieces(column)])
