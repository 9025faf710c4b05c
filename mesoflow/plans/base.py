"""Clean inputs for the analytics, and the same inputs as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesoflow.session import first_arrival, sized_broadcast, table
from mesoflow.sources.runs import runs


def finite(*cols: str):
    keep = F.lit(True)
    for c in cols:
        v = F.col(c).cast("double")
        keep = keep & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return keep


def detections(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """One row per detection that has a frame, a place and a positive mass: ``det_id, run_id, frame, x, y, mass`` and ``extra``, floats as double."""
    cols = ["run_id", "frame", "x", "y", "mass", *extra]
    d = first_arrival(table(spark, sf_dir, "detections"), "det_id", "arrived_at", cols)
    d = d.where(F.col("frame").isNotNull() & finite("x", "y", "mass") & (F.col("mass") > 0))
    kinds = dict(d.dtypes)
    return d.select("det_id", *[F.col(c).cast("double").alias(c) if kinds[c] == "float" else F.col(c) for c in cols])


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per reading of a track that has a frame and a place inside its run's image: ``obs_id, run_id, particle, frame, x_px, y_px, x_um, y_um``, places as double."""
    t = first_arrival(table(spark, sf_dir, "tracks"), "obs_id", "arrived_at", ["run_id", "particle", "frame", "x_px", "y_px", "x_um", "y_um"])
    t = with_run(t.where(F.col("frame").isNotNull() & finite("x_px", "y_px", "x_um", "y_um")), spark, sf_dir, "w", "h")
    t = t.where("x_px >= 0 and y_px >= 0 and x_px < w and y_px < h")
    return t.select("obs_id", "run_id", "particle", "frame", *[F.col(c).cast("double").alias(c) for c in ("x_px", "y_px", "x_um", "y_um")])


def with_run(df: DataFrame, spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Adds columns of the run's parameters and geometry (``params.KEY`` as a double, or a column of ``runs``)."""
    own = [c for c in cols if not c.startswith("params.")]
    meta = runs(spark, sf_dir).select("run_id", *own)
    keys = [c for c in cols if c.startswith("params.")]
    if keys:
        raw = table(spark, sf_dir, "job_meta").select("run_id", *[F.get_json_object("params", "$." + k[7:]).cast("double").alias(k[7:]) for k in keys])
        meta = meta.join(raw, "run_id")
    return df.join(sized_broadcast(meta), "run_id", "left")


D_SQL = """d as (select det_id, run_id, frame, cast(x as double) as x, cast(y as double) as y, cast(mass as double) as mass, cast(ecc as double) as ecc
  from (select *, row_number() over (partition by det_id order by arrived_at) as k from detections where det_id is not null)
  where k = 1 and frame is not null and isfinite(x) and isfinite(y) and isfinite(mass) and mass > 0)"""
T_SQL = """t as (select obs_id, o.run_id, particle, frame, cast(x_px as double) as x_px, cast(y_px as double) as y_px, x_um, y_um
  from (select *, row_number() over (partition by obs_id order by arrived_at) as k from tracks where obs_id is not null) o
  join job_meta j on o.run_id = j.run_id and x_px >= 0 and y_px >= 0 and x_px < j.w and y_px < j.h where k = 1 and frame is not null and isfinite(x_px) and isfinite(y_px) and isfinite(x_um) and isfinite(y_um))"""
M_SQL = """m as (select run_id, w, h, frame_start, frame_end, fps, params, cast(json_extract_string(params, '$.px_um') as double) as px_um,
  cast(json_extract_string(params, '$.edge_px') as double) as edge_px, cast(json_extract_string(params, '$.min_len') as double) as min_len,
  cast(json_extract_string(params, '$.max_step_um') as double) as max_step_um, cast(json_extract_string(params, '$.percentile') as double) as percentile,
  case when cast(json_extract_string(params, '$.dt') as double) > 0 then cast(json_extract_string(params, '$.dt') as double) when fps > 0 then 1 / fps else 1.0 end as dt
  from job_meta)"""
