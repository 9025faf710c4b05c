"""Streaming over Arrow batches of a partition that is sorted by group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's key differs from the row before (NULL equals NULL)."""
    out = np.zeros(table.num_rows, bool)
    if table.num_rows:
        out[0] = True
    for k in keys:
        col = table.column(k).combine_chunks()
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            col = pc.dictionary_encode(col)
            col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).indices
        missing = np.asarray(pc.is_null(col))
        values = np.asarray(pc.fill_null(col, 0))
        out[1:] |= (values[1:] != values[:-1]) | (missing[1:] != missing[:-1])
    return out


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups only, each with its dense group number per row.

    The last group of a batch may go on in the next one, so it is held back.
    Groups are bounded by the caller's blocks, so this holds ``least`` rows and one group.
    """
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least:
            continue
        joined = pa.concat_tables(held).combine_chunks()
        starts = changes(joined, keys)
        last = int(np.flatnonzero(starts)[-1])
        if last:
            yield joined.slice(0, last), np.cumsum(starts[:last]) - 1
        held = [joined.slice(last)]
        rows = joined.num_rows - last
    if held:
        joined = pa.concat_tables(held).combine_chunks()
        yield joined, np.cumsum(changes(joined, keys)) - 1


def floats(table: pa.Table, name: str) -> np.ndarray:
    """A float column as float64 with NULL as NaN."""
    return np.asarray(pc.fill_null(table.column(name).combine_chunks().cast(pa.float64()), np.nan), dtype=np.float64)


def group_median(gid: np.ndarray, values: np.ndarray, n_groups: int) -> np.ndarray:
    """Median per group (mean of the two middle values), NaN for an empty group; one sort for all groups."""
    out = np.full(n_groups, np.nan)
    if not len(values):
        return out
    order = np.lexsort((values, gid))
    v, g = values[order], gid[order]
    n = np.bincount(g, minlength=n_groups)
    start = np.cumsum(n) - n
    has = n > 0
    lo, hi = start[has] + (n[has] - 1) // 2, start[has] + n[has] // 2
    out[has] = (v[lo] + v[hi]) / 2
    return out
