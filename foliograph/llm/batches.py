"""Record batches: mapInArrow for the operators that aren't native."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are Python objects at once.
SLICE_BYTES = 16_000_000


def map_rows(df: DataFrame, work: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInArrow over df; `work` maps an iterator of record batches to one of record batches."""
    return df.mapInArrow(work, schema)


def slices(batches: Iterator, column: int, most: int = SLICE_BYTES) -> Iterator:
    """The rows of record batches in slices whose texts, in the given column, have about `most` bytes, and one row at least."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), b.num_rows]
        yield from (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i)
