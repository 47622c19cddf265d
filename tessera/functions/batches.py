"""Arrow batches cut into pieces of bounded size.

A batch holds as many rows as the session says, however long their texts are; what
Python makes of a batch is several times as large.  Functions that turn texts into
Python objects therefore go through a batch piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES, PIECE_ROWS = 4 << 20, 4096


def cuts(sizes: np.ndarray, most: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Consecutive runs (begin, end) of items whose sizes add up to at most ``most``,
    of at most ``rows`` items; a larger item is a run of its own."""
    ends = np.cumsum(sizes, dtype=np.int64)
    begin, used = 0, 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, used + most, "right")))
        end = end if rows is None else min(end, begin + rows)
        yield begin, end
        begin, used = end, int(ends[end - 1])


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in pieces of about 4 MB of the text column; a
    longer text is a piece of its own."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    for begin, end in cuts(sizes, PIECE_BYTES, PIECE_ROWS):
        yield batch.slice(begin, end - begin)
