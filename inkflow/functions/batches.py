"""Functions on Arrow arrays whose memory follows a slice of a batch, whatever the session's rows per batch and the lengths of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Bytes of input that a function is handed at once; one longer value comes alone.
SLICE_BYTES = 1 << 20


def slices(arrays: tuple[pa.Array, ...], most: int | None = None) -> Iterator[tuple[pa.Array, ...]]:
    """The rows in their order, in runs of about ``most`` bytes of texts and lists."""
    rows = len(arrays[0])
    size = np.full(rows, 8, np.int64)
    for a in arrays:
        if pa.types.is_list(a.type):
            size += 8 * pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_string(a.type) or pa.types.is_binary(a.type):
            size += pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size) // (most or SLICE_BYTES)
    borders = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), rows]
    for low, high in zip(borders, borders[1:]):
        if low < high or not rows:
            yield tuple(a.slice(low, high - low) for a in arrays)


def arrow_function(f: Callable[..., pa.Array], kind: str):
    """A function of columns from ``f``, which gets slices of their arrays and gives an array of type ``kind`` with as many rows.

    Spark would work it out again for each filter on its result that it moves below; it is marked so that its result is a column that
    is made once, by one worker for each task.
    """

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            for part in slices((a,)):
                yield f(*part)

    def more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            for part in slices(tuple(arrays)):
                yield f(*part)

    single, several = (F.arrow_udf(g, kind).asNondeterministic() for g in (one, more))
    return lambda *columns: single(*columns) if len(columns) == 1 else several(*columns)
