"""Arrow batches in parts of bounded size, as a batch has a number of rows and not of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose column has about ``most`` bytes of text, or elements of lists, at most; a row at least."""
    for batch in batches:
        c = batch.column(column)
        sizes = (c.value_lengths() if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else pc.binary_length(c)).fill_null(0)
        upto = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
