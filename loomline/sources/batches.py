"""Arrow batches in pieces, so that a worker makes Python objects of a bounded part of one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a column that are worked on at once.
PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of a column at most; a longer value is a slice of its own."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield batch.slice(at, end - at)
        at = end
