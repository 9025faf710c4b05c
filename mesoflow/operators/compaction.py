"""Many tiny files into few well-sized ones, by k-way merges of sorted runs per key range.

A file is a run: its records are in key order (frame) already, and a run of a file that is
not is put in order by itself. No table of records or blocks is ever sorted as a
whole; the merges alone bring equal keys together:

1. Where files are read, the runs of a batch of files are merged. Of the
   blocks (all records of one key in one file) of one key all but the latest
   version are superseded, and their records go no further.
2. What is left of each run is cut at key ranges (``SPAN`` frames of a run_id) and
   shuffled by range, as slices that are still sorted. Each range merges its
   slices and so finds the last version of each key.

So a key that lies in very many files costs its range one slice per batch of
files. Merged records are written in key order; output files are rolled by bytes
as their encoding is measured, and the range metadata is read from the
written files. Equal records within a block are kept: they are data.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesoflow.operators.arrowgroups import whole_groups

#: Frames of a run_id that one merge range spans.
SPAN = 256
#: Merges sorted runs; the only thing that brings equal keys together.
_merge = heapq.merge
#: Place of a NULL frame in the order: before all others.
_NULL = -(1 << 40)
#: From here on are the ranges that superseded blocks pass through.
_GONE = 1 << 41
_SLICE = "run_id string, rng bigint, written_us bigint, file_id bigint, copy bigint, frames array<int>, sizes array<int>, gone array<boolean>"


def _key(frame: int | None) -> int:
    return _NULL if frame is None else frame


def _version(at: int | None, file: int) -> tuple:
    """Order of the versions of a key: a NULL time is the earliest, ties go to the larger file_id."""
    return (at is not None, at or 0, file)


def merge_blocks(runs: list[list[tuple]]) -> Iterator[tuple[tuple, str]]:
    """(block, fate) of the blocks of sorted runs, in key order; fate is last, gone or repeat.

    A block is ``(key, version, copy, ...)`` and each run is in (key, version) order.
    Of the blocks of a key the last version is "last", earlier ones are "gone". The same version of
    another copy is the same file listed twice, "repeat"; of the same copy it is a piece of the block, and shares its fate.
    """
    held: list[tuple] = []
    for b in _merge(*runs, key=lambda b: b[:3]):
        if held and (b[0] != held[0][0] or b[1] != held[0][1]):
            fate = "gone" if b[0] == held[0][0] else "last"
            for h in held:
                yield h, fate if h[2] == held[0][2] else "repeat"
            held = []
        held.append(b)
    for h in held:
        yield h, "last" if h[2] == held[0][2] else "repeat"


def _slices(payload: list[str], types: list[pa.DataType]):
    """Step 1: rows of files in, slices of their runs out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, gid in whole_groups(batches, ["file_id", "copy"]):
            frame = t.column("frame").combine_chunks()
            order = np.asarray(frame.cast(pa.int64()).fill_null(_NULL))
            starts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
            ends = np.r_[starts[1:], len(gid)]
            # a file that is not in order is put in order by itself
            wrong = np.unique(gid[1:][(order[1:] < order[:-1]) & (gid[1:] == gid[:-1])])
            if len(wrong):
                place = np.arange(len(gid))
                for g in wrong:
                    place[starts[g] : ends[g]] = starts[g] + np.argsort(order[starts[g] : ends[g]], kind="stable")
                t, order = t.take(pa.array(place)), order[place]
            data = [t.column(c).combine_chunks() for c in payload]
            names, times, files, copies = (t.column(c).combine_chunks().take(pa.array(starts)).to_pylist() for c in ("run_id", "written_us", "file_id", "copy"))
            runs: dict[str | None, list[list[tuple]]] = {}
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                cuts = [a, *(a + 1 + np.flatnonzero(np.diff(order[a:b]))).tolist(), b]
                version = _version(times[i], files[i])
                runs.setdefault(names[i], []).append([(int(order[s]), version, copies[i], i, s, e) for s, e in zip(cuts, cuts[1:], strict=False)])
            out: dict[tuple, list[tuple]] = {}
            for mine in runs.values():
                for (key, _, _, i, s, e), fate in merge_blocks(mine):
                    if fate == "last":
                        # the merge goes up in key, so each slice is filled in key order
                        out.setdefault((i, _NULL if key == _NULL else key // SPAN), []).append((key, s, e, False))
                    elif fate == "gone" and not payload:
                        # decided; they are only passed on, evenly spread, and not to the ranges of their keys
                        out.setdefault((i, _GONE + files[i] % 4096), []).append((key, s, e, True))
            kept = list(out.items())
            blocks = [b for _, bs in kept for b in bs]
            ends_ = np.cumsum([0, *[len(bs) for _, bs in kept]])
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), pa.array(values, kind))
            cols = [pa.array([names[i] for (i, _), _ in kept], pa.string()), pa.array([r for (_, r), _ in kept], pa.int64()), pa.array([times[i] for (i, _), _ in kept], pa.int64()), pa.array([files[i] for (i, _), _ in kept], pa.int64()), pa.array([copies[i] for (i, _), _ in kept], pa.int64())]
            cols += [lists([None if k == _NULL else k for k, *_ in blocks], pa.int32()), lists([e - s for _, s, e, _ in blocks], pa.int32()), lists([g for *_, g in blocks], pa.bool_())]
            if payload:
                at = np.concatenate([np.arange(s, e) for _, s, e, _ in blocks] or [np.zeros(0, int)])
                upto = np.cumsum([0, *[sum(e - s for _, s, e, _ in bs) for _, bs in kept]])
                cols += [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), d.take(pa.array(at)).cast(k)) for d, k in zip(data, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _SLICE.split(", ")] + payload)

    return run


def _merged(payload: list[str], blocks_only: bool):
    """Step 2: slices of a key range in, merged blocks or records in key order out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, gid in whole_groups(batches, ["run_id", "rng"], least=2_000):
            starts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
            cols = {c: t.column(c).combine_chunks() for c in t.column_names}
            head = {c: cols[c].to_pylist() for c in ("run_id", "written_us", "file_id", "copy", "frames", "sizes", "gone")}
            base = {c: np.asarray(cols[c].offsets) for c in payload[:1]}
            rows: list[tuple] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(gid)], strict=True):
                runs = []
                for i in range(a, b):
                    at = int(base[payload[0]][i]) if payload else 0
                    mine = []
                    for frame, n, gone in zip(head["frames"][i], head["sizes"][i], head["gone"][i], strict=True):
                        if gone:
                            rows.append((i, frame, n, "gone", 0))
                            continue
                        mine.append((_key(frame), _version(head["written_us"][i], head["file_id"][i]), head["copy"][i], i, frame, n, at))
                        at += n
                    runs.append(mine)
                rows += [(i, frame, n, fate, at) for (_, _, _, i, frame, n, at), fate in merge_blocks(runs)]
            if blocks_only:
                rows = [r for r in rows if r[3] != "repeat"]
                pick = pa.array([i for i, *_ in rows], pa.int64())
                arrays = [cols["run_id"].take(pick), pa.array([f for _, f, *_ in rows], pa.int32()), cols["file_id"].take(pick), pa.array([n for _, _, n, *_ in rows], pa.int64()), pa.array([r[3] == "gone" for r in rows], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["run_id", "frame", "file_id", "n", "gone"])
                continue
            rows = [r for r in rows if r[3] == "last"]
            many = np.array([n for _, _, n, _, _ in rows], np.int64)
            at = pa.array(np.concatenate([np.arange(s, s + n) for *_, n, _, s in rows] or [np.zeros(0, np.int64)]))
            runs_ = cols["run_id"].take(pa.array(np.repeat([i for i, *_ in rows], many).astype(np.int64)))
            frames = pa.array([f for _, f, *_ in rows], pa.int32()).take(pa.array(np.repeat(np.arange(len(rows)), many)))
            whole = pa.Table.from_arrays([runs_, frames, *[cols[c].values.take(at) for c in payload[1:]]], ["run_id", "frame", *payload[1:]])
            yield from whole.to_batches(max_chunksize=50_000)

    return run


def _file_rows(files: DataFrame, fields: list[str]) -> DataFrame:
    """``run_id, written_us, file_id, copy, frame`` and ``fields``, a file's records one after another.

    ``files`` holds a file per row (``recs``), which ``copy`` numbers, or has the records themselves
    (``frame`` and the others, in file order), as ``sources.smallfiles`` reads them. Files without an id or records have no rows.
    """
    own = files.where(F.col("file_id").isNotNull())
    at = F.unix_micros("written_at").alias("written_us")
    if "recs" not in files.columns:
        return own.select("run_id", at, "file_id", F.lit(0).cast("bigint").alias("copy"), "frame", *fields)
    own = own.select("run_id", at, "file_id", F.monotonically_increasing_id().alias("copy"), "recs")
    rec = F.col("recs.frame") if not fields else F.col("recs")
    x = own.select("run_id", "written_us", "file_id", "copy", F.explode(rec).alias("rec"))
    if not fields:
        return x.withColumnRenamed("rec", "frame")
    return x.select("run_id", "written_us", "file_id", "copy", "rec.frame", *[F.col(f"rec.{f}").alias(f) for f in fields])


def merge_plan(files: DataFrame) -> DataFrame:
    """``run_id, frame, file_id, n, gone``: every key block of the files, ``gone`` if a later version of its key is merged.

    A NULL frame, or run_id, is a key like any other. Of a file listed twice (equal run_id, written_at and file_id)
    the blocks that are kept come once. Only the frames of the records are read.
    """
    slices = _file_rows(files, []).mapInArrow(_slices([], []), _SLICE)
    ranged = slices.repartition("run_id", "rng").sortWithinPartitions("run_id", "rng")
    return ranged.mapInArrow(_merged([], True), "run_id string, frame int, file_id bigint, n bigint, gone boolean")


def superseded(merged: DataFrame) -> DataFrame:
    """``run_id, frame, file_id`` of the blocks that must not reach the output, each once also where a file is listed twice."""
    return merged.where("gone").select("run_id", "frame", "file_id").distinct()


def kept(merged: DataFrame) -> DataFrame:
    """``run_id, frame, file_id, n`` of the blocks of the output, one per key."""
    return merged.where(~F.col("gone")).select("run_id", "frame", "file_id", "n")


def record_slices(files: DataFrame, fields: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The slices of the files' runs with their records (``frame_no`` and ``fields`` as arrays), as they leave the place where files are read, and the fields' types."""
    types = dict(files.dtypes)
    if "recs" in types:
        types = dict(files.select(F.explode("recs").alias("r")).select("r.*").dtypes)
    of = {"float": pa.float32(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    # the first payload column carries the row offsets of a slice
    full = f"{_SLICE}, frame_no array<int>, " + ", ".join(f"`{f}` array<{types[f]}>" for f in fields)
    rows = _file_rows(files, fields).withColumn("frame_no", F.lit(0))
    return rows.mapInArrow(_slices(["frame_no", *fields], [pa.int32(), *[of[types[f]] for f in fields]]), full), types


def merged_records(files: DataFrame, fields: list[str], ranges: int | None = None) -> DataFrame:
    """``run_id, frame`` and ``fields`` of the records that the merge keeps, in key order in each of ``ranges`` key ranges.

    Records move once: superseded blocks of a batch of files are left behind where they were read, the
    others are shuffled as sorted slices.
    """
    slices, types = record_slices(files, fields)
    keys = ["run_id", "rng"]
    ranged = (slices.repartitionByRange(ranges, *keys) if ranges else slices.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    return ranged.mapInArrow(_merged(["frame_no", *fields], False), "run_id string, frame int, " + ", ".join(f"`{f}` {types[f]}" for f in fields))


def _weigh(fields: list[str]):
    """Rows and encoded bytes of slices, where they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        rows = size = 0
        for b in batches:
            n = np.diff(np.asarray(b.column("frame_no").offsets)).astype(np.int64)
            frames = np.repeat(np.asarray(b.column("rng")), n).astype(np.int64)
            t = pa.table({"run_id": b.column("run_id").take(pa.array(np.repeat(np.arange(len(n)), n))), "frame": frames, **{f: b.column(f).flatten() for f in fields}})
            sink = pa.BufferOutputStream()
            pq.write_table(t, sink, compression="snappy")
            rows, size = rows + t.num_rows, size + (sink.getvalue().size if t.num_rows else 0)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([size])], ["rows", "bytes"])

    return run


def consolidate(files: DataFrame, path: str, fields: list[str], target_bytes: int = 128 << 20) -> DataFrame:
    """Write the merged records to ``path`` (Parquet, ordered by run_id, frame) and return its range metadata.

    ``files``: ``run_id, file_id, written_at`` and ``recs``, or the records themselves.
    Each (run_id, frame) comes out once, whole, from its latest file. Two jobs: the first
    weighs the records by their encoding where they are read, for the number of ranges and the rows of ``target_bytes``; the second
    moves and writes them. Returned, from the written files: one row per file with ``file, run_id_min, frame_min, run_id_max,
    frame_max, n_keys, n_rows, bytes``; neighbouring files of a range may share the key at which they are rolled.
    """
    spark = files.sparkSession
    total = record_slices(files, fields)[0].mapInArrow(_weigh(fields), "rows bigint, bytes bigint").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    size = max(1.0, (total["bytes"] or 0) / max(1, total["rows"] or 0))
    ranges = max(1, round((total["bytes"] or 0) / target_bytes))
    out = merged_records(files, fields, ranges)
    out.write.mode("errorifexists").option("maxRecordsPerFile", max(1, int(target_bytes / size))).parquet(path)
    return range_metadata(spark.read.parquet(path))


def range_metadata(written: DataFrame) -> DataFrame:
    """Key range, keys, rows and bytes of each file of a written table; only its key columns are read."""
    rows = written.select("run_id", "frame", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    # keys first: one row per key and task goes to the shuffle
    keys = rows.groupBy("file", "bytes", "run_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    key = F.struct("run_id", "frame")
    meta = keys.groupBy("file", "bytes").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))
    return meta.select("file", F.col("lo.run_id").alias("run_id_min"), F.col("lo.frame").alias("frame_min"), F.col("hi.run_id").alias("run_id_max"), F.col("hi.frame").alias("frame_max"), "n_keys", "n_rows", "bytes")


def chunk_check(job_meta: DataFrame, files: DataFrame) -> DataFrame:
    """Offloaded runs whose ``n_chunks_merged`` differs from the tasks present (NULL tasks, as of redone ranges, name no task).

    ``run_id, n_chunks, n_chunks_merged, tasks_present, tasks_missing``; a NULL
    ``n_chunks_merged`` does not fit either. Runs that were not offloaded (NULL n_chunks) are left out.
    """
    tasks = files.where(F.col("task").isNotNull()).groupBy("run_id").agg(F.countDistinct("task").alias("tasks_present"))
    m = job_meta.where(F.col("n_chunks").isNotNull()).select("run_id", "n_chunks", "n_chunks_merged").join(tasks, "run_id", "left").fillna(0, ["tasks_present"])
    m = m.withColumn("tasks_missing", F.col("n_chunks") - F.col("tasks_present"))
    return m.where(~F.col("n_chunks_merged").eqNullSafe(F.col("tasks_present").cast("int")))
