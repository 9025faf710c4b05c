"""Numpy kernels over whole groups of a sorted partition."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string  # noqa: PLC2701

from mesoflow.operators.arrowgroups import whole_groups


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by ``keys`` over all shuffle partitions: kernels are heavy for their bytes, so small partitions must not be joined up."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def map_groups(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """``keys`` plus the kernel's columns (``schema``) for every group.

    The kernel gets a dict of numpy arrays (all columns of ``df``, sorted by
    ``order``; NULL numbers are NaN) and returns equally long arrays, or None.
    Groups must be bounded by nature (the particles of one image, the
    boundaries of one run); the shuffle is by ``keys`` and only these columns travel.
    """
    kinds = dict(df.dtypes)
    full = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(StructType.fromJson(layout))
        for t, gid in whole_groups(batches, keys):
            starts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
            ends = np.r_[starts[1:], len(gid)]
            cols = {}
            for name in t.column_names:
                c = t.column(name).combine_chunks()
                cols[name] = c.to_numpy(zero_copy_only=False)
            parts: list[tuple[int, dict[str, np.ndarray], int]] = []

            def batch() -> pa.RecordBatch:
                at = np.concatenate([np.full(n, a) for a, _, n in parts])
                arrays = [t.column(k).combine_chunks().take(pa.array(at)) for k in keys]
                for name, field in zip(names, list(target)[len(keys) :], strict=True):
                    values = [out[name] for _, out, _ in parts]
                    flat = np.concatenate([np.asarray(v) for v in values]) if not pa.types.is_list(field.type) else [x for v in values for x in v]
                    arrays.append(pa.array(flat, field.type, from_pandas=True))
                for i, field in enumerate(list(target)[: len(keys)]):
                    arrays[i] = arrays[i].cast(field.type)
                return pa.RecordBatch.from_arrays(arrays, schema=target)

            held = 0
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                out = kernel({n: v[a:b] for n, v in cols.items()})
                n = len(out[names[0]]) if out else 0
                if n:
                    parts.append((a, out, n))
                    held += n
                if held > 100_000:
                    yield batch()
                    parts, held = [], 0
            if parts:
                yield batch()

    layout = _parse_datatype_string(full).jsonValue()
    return spread(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, full)


def lag_sums(at: np.ndarray, most: int, terms: Callable[[slice, slice], list[np.ndarray]], least: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of ``terms`` over all pairs of rows of a series, by the difference of their places ``at`` (ascending) from ``least`` to ``most``.

    ``terms`` makes, of two equally long slices of rows (earlier, later), one array per sum. Rows are paired by
    one whole-array step per distance in rows, and the sums are folded from time to time, so memory stays in the order of the series.
    """
    n, width = len(at), len(terms(slice(0, 0), slice(0, 0)))
    done, lags, parts = 0, [np.zeros(0, np.int64)], [[np.zeros(0)] for _ in range(width)]

    def fold() -> None:
        own, where = np.unique(np.concatenate(lags), return_inverse=True)
        lags[:] = [own]
        for p in parts:
            p[:] = [np.bincount(where, np.concatenate(p), len(own))]

    for k in range(0 if least <= 0 else 1, n):
        lag = at[k:] - at[: n - k]
        if k and lag.min() > most:
            break
        keep = (lag >= least) & (lag <= most)
        lags.append(lag[keep].astype(np.int64))
        for p, v in zip(parts, terms(slice(0, n - k), slice(k, n)), strict=True):
            p.append(v[keep])
        done += int(keep.sum())
        if done > 1_000_000:
            fold()
            done = 0
    fold()
    return lags[0], [p[0] for p in parts]
