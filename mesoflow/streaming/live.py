"""Live path: per-frame statistics, windows, and stateful operators on Structured Streaming.

The folds (linking, decimation, hysteresis) are the batch ones with their state
kept by Spark per run, so a stream gives what a batch over the same rows gives.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mesoflow.operators.folds import link_step, new_links


def live_stats(detections: DataFrame, watermark: str = "10 minutes", window: str = "1 minute", slide: str | None = None) -> DataFrame:
    """``run_id, start, n, mean_mass, frac_round`` per run and window of ``arrived_at``.

    Works on a stream (rows later than the watermark are dropped) and on a table. NULL and NaN masses are
    not averaged. ``arrived_at`` must be a TIMESTAMP with zone.
    """
    mass = F.when(~F.isnan("mass") & (F.abs("mass") != float("inf")), F.col("mass").cast("double"))
    w = F.window("arrived_at", window, slide) if slide else F.window("arrived_at", window)
    g = detections.withWatermark("arrived_at", watermark).groupBy("run_id", w.alias("w"))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.avg(mass).alias("mean_mass"), F.avg((F.col("ecc") <= 0.3).cast("double")).alias("frac_round"))
    return out.select("run_id", F.col("w.start").alias("start"), "n", "mean_mass", "frac_round")


def sessions(detections: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """``run_id, start, end, n``: stretches of arrivals of a run without a pause of ``gap``."""
    g = detections.withWatermark("arrived_at", watermark).groupBy("run_id", F.session_window("arrived_at", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_deliveries(detections: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A stream without repeated deliveries: one row per ``det_id`` within the watermark."""
    return detections.withWatermark("arrived_at", watermark).dropDuplicatesWithinWatermark(["det_id"])


def frame_observables(points: DataFrame, pairs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``run_id, frame, n_particles, n_57_pairs, frac_defect, mean_psi6, n_lagb`` per frame that has points; frames without pairs or boundaries have 0 of them."""
    key = ["run_id", "frame"]
    count = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    own = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n_particles"), F.avg((F.col("coord") != 6).cast("double")).alias("frac_defect"), F.avg(F.hypot("psi_re", "psi_im")).alias("mean_psi6"))
    j = own.join(count(pairs, "n_57_pairs"), key, "left").join(count(boundaries.where("kind = 'LAGB'"), "n_lagb"), key, "left")
    return j.fillna(0, ["n_57_pairs", "n_lagb"]).select(*key, "n_particles", "n_57_pairs", "frac_defect", "mean_psi6", "n_lagb")


def record_structure(detections: DataFrame, folder: str, checkpoint: str, area_um2: float, start: float, max_pair: float = 96.0, trigger: dict | None = None):
    """Start recording the structure of each frame of a stream of ``run_id, frame, det_id, x, y, t`` as CSV; stop it with the returned query's ``stop()``.

    Columns: run_id, frame, t_s (``t`` less ``start``), n_particles, n_57_pairs, pairs_per_um2, frac_defect, mean_psi6, n_lagb, area_um2. A frame must not be
    split between micro-batches. A micro-batch that is done again replaces its own files, so no frame is recorded twice.
    """
    from mesoflow.operators import structure as S

    def write(batch: DataFrame, number: int) -> None:
        points = batch.select("run_id", "frame", "det_id", "x", "y").checkpoint()
        edges = S.delaunay_edges(points, "det_id").checkpoint()
        points = S.structure_points(points, edges, "det_id").checkpoint()
        pairs = S.pairs57(points, edges, "det_id", max_pair)
        o = frame_observables(points, pairs, S.boundaries(pairs)[0]).join(batch.groupBy("run_id", "frame").agg((F.min("t") - start).alias("t_s")), ["run_id", "frame"])
        o = o.withColumn("area_um2", F.lit(float(area_um2))).withColumn("pairs_per_um2", F.col("n_57_pairs") / F.greatest("area_um2", F.lit(1e-9)))
        out = o.select("run_id", "frame", "t_s", "n_particles", "n_57_pairs", "pairs_per_um2", "frac_defect", "mean_psi6", "n_lagb", "area_um2")
        out.write.mode("overwrite").option("header", True).csv(f"{folder}/batch={number}")

    return detections.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def record(stats: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Start appending a stream of statistics to CSV files with a header; stop it with the returned query's ``stop()``.

    ``trigger`` as of ``DataStreamWriter.trigger``; by default what is there is taken and the query ends.
    """
    w = stats.writeStream.format("csv").option("header", True).option("path", folder).option("checkpointLocation", checkpoint)
    return w.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def latest_only(batch: DataFrame) -> DataFrame:
    """Of each run the newest frame of a micro-batch (for ``foreachBatch``): stale frames are dropped as a live view does."""
    newest = batch.groupBy("run_id").agg(F.max("frame").alias("frame"))
    return batch.join(newest, ["run_id", "frame"], "left_semi")


def keep_at_rate(times: np.ndarray, last: float | None, gap: float) -> tuple[np.ndarray, float | None]:
    """Which of the ascending times to keep so that each is at least ``gap`` after the last one kept."""
    keep = np.zeros(len(times), bool)
    for i, t in enumerate(times.tolist()):
        if last is None or t - last >= gap:
            keep[i], last = True, t
    return keep, last


def decimate(frames: DataFrame, gap: float) -> DataFrame:
    """A stream of ``run_id, frame, t`` thinned to at most one frame per ``gap`` seconds since the last one kept, per run.

    Frames of a micro-batch are taken in order of t; one that comes after a later frame was seen is judged against the last kept.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        g = pd.concat(list(rows)).sort_values(["t", "frame"])
        keep, last = keep_at_rate(g["t"].to_numpy(), last, gap)
        if last is not None:
            state.update((last,))
        yield g.loc[keep, ["run_id", "frame", "t"]]

    return frames.select("run_id", "frame", "t").groupBy("run_id").applyInPandasWithState(step, "run_id string, frame int, t double", "last double", "append", GroupStateTimeout.NoTimeout)


def flag_stream(frames: DataFrame, on: float = 0.72, off: float = 0.35) -> DataFrame:
    """A stream of ``run_id, frame, value`` with ``flag``: on from a value of at least ``on`` until one of at most ``off``."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flag = bool(state.get[0]) if state.exists else False
        g = pd.concat(list(rows)).sort_values("frame")
        flags = []
        for v in g["value"]:
            flag = True if v >= on else False if v <= off else flag
            flags.append(flag)
        state.update((flag,))
        yield g.assign(flag=flags)[["run_id", "frame", "value", "flag"]]

    return frames.select("run_id", "frame", "value").groupBy("run_id").applyInPandasWithState(step, "run_id string, frame int, value double, flag boolean", "flag boolean", "append", GroupStateTimeout.NoTimeout)


def link_stream(points: DataFrame, reach: float, memory: int = 3) -> DataFrame:
    """A stream of ``run_id, frame, det_id, x, y`` with ``particle``: the linker with its live particles as state.

    A run's frames must come in order over micro-batches (within one they are sorted), and a frame must not be split
    between two; memory counts frames seen, as in the batch form.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = pickle.loads(state.get[0]) if state.exists else new_links()
        out = []
        for frame, g in pd.concat(list(rows)).sort_values(["frame", "det_id"]).groupby("frame", sort=True):
            x, y = (g[c].to_numpy().astype(np.float32).astype(np.float64) for c in ("x", "y"))
            out.append(pd.DataFrame({"run_id": key[0], "frame": np.int32(frame), "det_id": g["det_id"].to_numpy(), "particle": link_step(live, x, y, reach, memory, g["det_id"].to_numpy())}))
        state.update((pickle.dumps(live),))
        yield pd.concat(out)

    return points.select("run_id", "frame", "det_id", "x", "y").groupBy("run_id").applyInPandasWithState(step, "run_id string, frame int, det_id bigint, particle bigint", "live binary", "append", GroupStateTimeout.NoTimeout)
