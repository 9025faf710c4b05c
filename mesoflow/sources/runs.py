"""The run dimension: calibration and geometry of each run, from ``job_meta``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesoflow.session import sized_broadcast, table


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, video, dt, frame_start, frame_end, w, h, px_um, roi``, one row per run.

    dt is ``params.dt`` if above 0, else 1/fps if fps is above 0, else 1.0.
    Malformed or NULL params give NULL px_um and roi.
    """
    m = table(spark, sf_dir, "job_meta")
    dt = F.get_json_object("params", "$.dt").cast("double")
    return m.select(
        "run_id",
        "video",
        F.when(dt > 0, dt).when(F.col("fps") > 0, 1 / F.col("fps")).otherwise(1.0).alias("dt"),
        "frame_start",
        "frame_end",
        F.col("w").cast("double").alias("w"),
        F.col("h").cast("double").alias("h"),
        F.get_json_object("params", "$.px_um").cast("double").alias("px_um"),
        F.from_json(F.get_json_object("params", "$.roi_polygon"), "array<array<double>>").alias("roi"),
    )


def with_slots(tracks: DataFrame, meta: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tracks with ``slot`` (BIGINT): ``floor(t / dt + 0.5)``, or ``frame - frame_start`` where t is NULL, NaN or infinite.

    Tracks of a run that ``meta`` lacks have slots by dt = 1 and frame_start = 0. Columns of ``meta`` to ``keep`` come with it.
    """
    m = sized_broadcast(meta.select(F.col("run_id").alias("_run"), F.col("dt").alias("_dt"), F.col("frame_start").alias("_from"), *keep))
    slot = F.floor(F.col("t") / F.coalesce("_dt", F.lit(1.0)) + 0.5).cast("bigint")
    by_frame = (F.col("frame") - F.coalesce("_from", F.lit(0))).cast("bigint")
    timed = F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") != float("inf"))
    return tracks.join(m, F.col("run_id") == F.col("_run"), "left").withColumn("slot", F.when(timed, slot).otherwise(by_frame)).drop("_run", "_dt", "_from")
