"""Whole series out of a stream of sorted rows, many at a time as one matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 1 << 15


def by_series(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows in one exchange so that each series lies together, in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, order)


def whole_series(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole series of about ``rows`` rows (one series at least), and the n + 1 places where series begin."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        size += b.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            starts = _starts(table, keys)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]), starts
                held = table.slice(starts[-1]).combine_chunks().to_batches()
                size = table.num_rows - int(starts[-1])
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(_starts(table, keys), table.num_rows)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        code = table[k].combine_chunks().dictionary_encode()
        code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def padded(values: np.ndarray, starts: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """A row per series, as wide as the longest."""
    sizes = np.diff(starts)
    out = np.full((len(sizes), int(sizes.max(initial=0)), *values.shape[1:]), fill)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - starts[row]] = values
    return out
