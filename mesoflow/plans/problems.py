"""Queries of the general data problems over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesoflow.operators.compaction import chunk_check, consolidate, merge_plan, superseded
from mesoflow.operators.proximity import near_pairs, points_in_regions
from mesoflow.operators.quantiles import combine, percentiles_of_counts, value_counts
from mesoflow.operators.regrid import one_per_slot, regular_grid
from mesoflow.operators.spikes import Field, flag_readings
from mesoflow.session import ensure_checkpoint_dir, first_arrival, table
from mesoflow.sources.runs import runs, with_slots
from mesoflow.sources.smallfiles import FIELDS

MASS = [Field("mass", positive=True, stuck=8, spike="ratio", times=6.0, width=16)]
POSITION = [Field(c, below=b, stuck=6, spike="jump", times=15.0, enough=20, width=8) for c, b in (("x_px", "w"), ("y_px", "h"))]


def _odd_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd masses of each run and odd positions of each track: ``tbl, rec_id, field, kind, score``."""
    det = first_arrival(table(spark, sf_dir, "detections"), "det_id", "arrived_at", ["run_id", "mass"])
    masses = flag_readings(det, ["run_id"], ["det_id"], "det_id", MASS)
    meta = runs(spark, sf_dir)
    obs = first_arrival(table(spark, sf_dir, "tracks"), "obs_id", "arrived_at", ["run_id", "particle", "frame", "x_px", "y_px", "t"])
    obs = with_slots(obs, meta, ("w", "h"))
    # a track is a short source: blocks of 512 slots
    positions = flag_readings(obs, ["run_id", "particle"], ["slot", "t", "obs_id"], "obs_id", POSITION, block=512)
    return masses.withColumn("tbl", F.lit("detections")).unionByName(positions.withColumn("tbl", F.lit("tracks")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impossible, stuck and spiking readings."""
    return _odd_readings(spark, sf_dir).where(F.col("kind").bitwiseAND(F.lit(7)) > 0).select("tbl", "rec_id", "field")


def p1_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings off their source's normal behaviour by its low-rank split, with their score, whether or not a rule flags them too."""
    odd = _odd_readings(spark, sf_dir).where(F.col("kind").bitwiseAND(F.lit(8)) > 0)
    return odd.select("tbl", "rec_id", "field", "score", (F.col("kind").bitwiseAND(F.lit(4)) > 0).alias("is_spike"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of files that a later file of the run holds too."""
    return superseded(merge_plan(table(spark, sf_dir, "chunk_files").select("run_id", "file_id", "written_at", "recs"))).select("file_id", "frame")


def p2_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range metadata of the merged files, which are written to the shared folder."""
    at = f"{ensure_checkpoint_dir(spark)}/merged-{uuid.uuid4().hex}"
    return consolidate(table(spark, sf_dir, "chunk_files"), at, FIELDS)


def p2_misfit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose merged count does not fit the tasks present."""
    return chunk_check(table(spark, sf_dir, "job_meta"), table(spark, sf_dir, "chunk_files"))


PS = [0.05, 0.25, 0.5, 0.75, 0.95]
LEVELS = ["level", "video", "run_id", "frame"]


def _levels(det: DataFrame) -> DataFrame:
    """A detection counts for its video, its run and its frame; a frame belongs to one run of one video."""
    rows = det.withColumn("level", F.explode(F.array(F.lit("video"), F.lit("run"), F.lit("frame")))).where("level <> 'frame' or frame is not null")
    run = F.when(F.col("level") != "video", F.col("run_id"))
    return rows.withColumn("run_id", run).withColumn("frame", F.when(F.col("level") == "frame", F.col("frame")))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_arrival(table(spark, sf_dir, "detections"), "det_id", "arrived_at", ["video", "run_id", "frame", "mass"])


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of mass per video, run and frame, exact (rank and value error 0)."""
    counts = value_counts(_levels(_arrivals(spark, sf_dir)), LEVELS, "mass")
    return percentiles_of_counts(counts, LEVELS, PS)


def p3_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per video, from states kept per arrival day and combined; values within 0.5 %."""
    det = _arrivals(spark, sf_dir).withColumn("day", F.to_date("arrived_at"))
    days = value_counts(det, ["video"], "mass", relative_error=0.005, extra=["day"])
    return percentiles_of_counts(combine(days, ["video"]), ["video"], PS).withColumn("value", F.round("value", 4))


def p3_by_day_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per video, run and frame from states kept per arrival day and combined; values within 0.5 %, not rounded."""
    det = _arrivals(spark, sf_dir).withColumn("day", F.to_date("arrived_at"))
    days = value_counts(_levels(det), LEVELS, "mass", relative_error=0.005, extra=["day"])
    return percentiles_of_counts(combine(days, LEVELS), LEVELS, PS)


def _grid(spark: SparkSession, sf_dir: str, gap_limit: int | None) -> DataFrame:
    meta = runs(spark, sf_dir)
    readings = table(spark, sf_dir, "tracks").select("obs_id", "run_id", "particle", "frame", "t", "x_um")
    obs = with_slots(readings.where(F.col("x_um").isNotNull() & ~F.isnan("x_um")), meta, ("dt",))
    # of several readings in a slot the one nearest to the slot's time stands for it; a reading without t is taken to be on time
    obs = obs.withColumn("_off", F.coalesce(F.abs(F.nanvl(F.col("t"), F.lit(None).cast("double")) / F.coalesce("dt", F.lit(1.0)) - F.col("slot")), F.lit(0.0)))
    one = one_per_slot(obs, ["run_id", "particle"], "slot", "obs_id", ["x_um"], near="_off")
    return regular_grid(one, ["run_id", "particle"], "slot", "x_um", gap_limit)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots without a usable reading between a particle's first and last one."""
    return _grid(spark, sf_dir, None).where(~F.col("is_reading")).select("run_id", "particle", "slot")


def p4_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per slot, holes of up to 10 slots filled by interpolation, longer ones marked."""
    g = _grid(spark, sf_dir, 10)
    return g.select("run_id", "particle", "slot", "is_reading", F.when(F.col("is_reading"), F.col("value")).otherwise(F.round("filled", 6)).alias("x_um"), (~F.col("is_reading") & F.col("filled").isNull()).alias("is_missing"))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_arrival(table(spark, sf_dir, "detections"), "det_id", "arrived_at", ["run_id", "frame", "x", "y"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of detections of one run and frame at most 4 px apart."""
    pairs = near_pairs(_positions(spark, sf_dir), ["run_id", "frame"], "det_id", 4.0)
    return pairs.select(F.col("a").alias("det_id_a"), F.col("b").alias("det_id_b"))


def p5_in_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections inside the region polygon of their run."""
    rois = runs(spark, sf_dir).select("run_id", "roi")
    return points_in_regions(_positions(spark, sf_dir), rois, ["run_id"], "det_id", "roi").select("run_id", "det_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_residuals": p1_residuals,
    "p2_found": p2_found,
    "p2_consolidated": p2_consolidated,
    "p2_misfit_runs": p2_misfit_runs,
    "p3_percentiles": p3_percentiles,
    "p3_by_day": p3_by_day,
    "p3_by_day_levels": p3_by_day_levels,
    "p4_found": p4_found,
    "p4_regular": p4_regular,
    "p5_found": p5_found,
    "p5_in_roi": p5_in_roi,
}

_SLOTS = """
m as (select run_id, frame_start, case when cast(json_extract_string(params, '$.dt') as double) > 0 then cast(json_extract_string(params, '$.dt') as double)
  when fps > 0 then 1 / fps else 1.0 end as dt from job_meta),
s as (select t.run_id, particle, obs_id, x_um, case when t is not null and not isnan(t) then abs(t / dt - floor(t / dt + 0.5)) else 0.0 end as off,
  case when t is not null and not isnan(t) then cast(floor(t / dt + 0.5) as bigint) else cast(frame - frame_start as bigint) end as slot
  from (select distinct run_id, particle, obs_id, x_um, t, frame from tracks) t join m on t.run_id = m.run_id where x_um is not null and not isnan(x_um)),
r as (select run_id, particle, slot, x_um from (select *, row_number() over (partition by run_id, particle, slot order by off, obs_id) as k from s) where k = 1),
e as (select run_id, particle, min(slot) as a, max(slot) as b from r group by 1, 2),
g as (select run_id, particle, unnest(range(a, b + 1)) as slot from e)
"""



def _odd_positions(field: str, size: str) -> str:
    """The rules of p1 for one coordinate of the tracks, plainly."""
    order = "run_id, particle order by slot, t nulls first, obs_id"
    return f"""select 'tracks' as tbl, obs_id as rec_id, '{field}' as field from (
  with v as (select run_id, particle, slot, t, obs_id, cast({field} as double) as v, isinf({field}) or {field} < 0 or {field} >= {size} as bad from z where {field} is not null and not isnan({field})),
  c as (select *, case when v = lag(v) over (partition by {order}) then 0 else 1 end as cut from v),
  i as (select *, sum(cut) over (partition by {order} rows unbounded preceding) as island from c),
  s as (select obs_id, bad, count(*) over (partition by run_id, particle, island) >= 6 as stuck from i),
  o as (select *, v - lag(v) over w as a, v - lead(v) over w as b, lag(v) over w as p1, lag(v, 2) over w as p2, lead(v) over w as n1, lead(v, 2) over w as n2, count(*) over (partition by run_id, particle) as n
    from v where not bad window w as (partition by {order})),
  m as (select *, 15 * median(abs(a)) over (partition by run_id, particle) as lim from o),
  k as (select obs_id from m where n >= 20 and (
    (a > lim and b > lim) or (a < -lim and b < -lim)
    or (a > lim and v - n2 > lim and n1 - p1 > lim and n1 - n2 > lim) or (a < -lim and v - n2 < -lim and n1 - p1 < -lim and n1 - n2 < -lim)
    or (p1 - p2 > lim and p1 - n1 > lim and v - p2 > lim and b > lim) or (p1 - p2 < -lim and p1 - n1 < -lim and v - p2 < -lim and b < -lim)))
  select s.obs_id from s left join k on k.obs_id = s.obs_id where bad or stuck or k.obs_id is not null)"""


SQL: dict[str, str] = {
    "p1_found": f"""
with d as (select det_id, run_id, cast(mass as double) as v, isinf(mass) or mass <= 0 as bad from (select *, row_number() over (partition by det_id order by arrived_at) as k from detections where det_id is not null)
  where k = 1 and mass is not null and not isnan(mass)),
c as (select *, case when v = lag(v) over (partition by run_id order by det_id) then 0 else 1 end as cut, median(case when not bad then v end) over (partition by run_id) as med from d),
i as (select *, sum(cut) over (partition by run_id order by det_id rows unbounded preceding) as island from c),
f as (select *, count(*) over (partition by run_id, island) >= 8 as stuck from i),
m as (select run_id, w, h, frame_start, case when cast(json_extract_string(params, '$.dt') as double) > 0 then cast(json_extract_string(params, '$.dt') as double) when fps > 0 then 1 / fps else 1.0 end as dt from job_meta),
z as (select q.*, w, h, case when t is not null and not isnan(t) then cast(floor(t / dt + 0.5) as bigint) else cast(frame - frame_start as bigint) end as slot
  from (select * from (select *, row_number() over (partition by obs_id order by arrived_at) as k from tracks where obs_id is not null) where k = 1) q join m on m.run_id = q.run_id)
select 'detections' as tbl, det_id as rec_id, 'mass' as field from f where bad or stuck or v > 6 * med or v * 6 < med
union all {_odd_positions("x_px", "w")}
union all {_odd_positions("y_px", "h")}""",
    "p3_by_day": """
with d as (select video, cast(mass as double) as v from (select *, row_number() over (partition by det_id order by arrived_at) as k from detections where det_id is not null) where k = 1 and mass is not null and not isnan(mass)),
g as (select video, case when v = 0 or isinf(v) then v else sign(v) * exp((floor(ln(abs(v)) / ln(1.005::double / 0.995::double)) + 0.5) * ln(1.005::double / 0.995::double)) end as v from d),
o as (select *, count(*) over (partition by video) as n_rows, row_number() over (partition by video order by v) as pos from g),
p as (select unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) as p)
select video, n_rows, p, pos as rank, round(v, 4) as value from o, p where pos = greatest(1, ceil(round(p * n_rows, 6)))""",
    "p2_found": """
with k as (select distinct run_id, file_id, written_at, r.frame as frame from (select run_id, file_id, written_at, unnest(recs) as r from chunk_files)),
n as (select *, row_number() over (partition by run_id, frame order by written_at desc, file_id desc) as pos from k)
select file_id, frame from n where pos > 1""",
    "p2_misfit_runs": """
with t as (select run_id, count(distinct task) as tasks_present from chunk_files where task is not null group by 1)
select m.run_id, n_chunks, n_chunks_merged, coalesce(tasks_present, 0) as tasks_present, n_chunks - coalesce(tasks_present, 0) as tasks_missing
from job_meta m left join t on m.run_id = t.run_id where n_chunks is not null and n_chunks_merged is distinct from coalesce(tasks_present, 0)""",
    "p3_percentiles": """
with d as (select * from (select *, row_number() over (partition by det_id order by arrived_at) as k from detections where det_id is not null) where k = 1 and mass is not null and not isnan(mass)),
l as (select 'video' as level, video, cast(null as varchar) as run_id, cast(null as int) as frame, cast(mass as double) as mass from d
  union all select 'run', video, run_id, null, cast(mass as double) from d
  union all select 'frame', video, run_id, frame, cast(mass as double) from d where frame is not null),
o as (select *, count(*) over (partition by level, video, run_id, frame) as n_rows, row_number() over (partition by level, video, run_id, frame order by mass) as pos from l),
p as (select unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) as p)
select level, video, run_id, frame, n_rows, p, pos as rank, mass as value from o, p where pos = greatest(1, ceil(round(p * n_rows, 6)))""",
    "p4_found": f"with {_SLOTS} select g.run_id, g.particle, g.slot from g anti join r using (run_id, particle, slot)",
    "p4_regular": f"""
with {_SLOTS},
a as (select g.run_id, g.particle, g.slot, r.x_um, r.slot as here,
  max(r.slot) over (partition by g.run_id, g.particle order by g.slot) as lo,
  min(r.slot) over (partition by g.run_id, g.particle order by g.slot desc) as hi
  from g left join r on g.run_id = r.run_id and g.particle = r.particle and g.slot = r.slot),
f as (select a.*, l.x_um as xl, h.x_um as xh from a join r l on l.run_id = a.run_id and l.particle = a.particle and l.slot = a.lo
  join r h on h.run_id = a.run_id and h.particle = a.particle and h.slot = a.hi)
select run_id, particle, slot, here is not null as is_reading,
  case when here is not null then x_um when hi - lo <= 10 then round(xl * (1 - (slot - lo) / (hi - lo)) + xh * ((slot - lo) / (hi - lo)), 6) end as x_um,
  here is null and hi - lo > 10 as is_missing from f""",
    "p5_in_roi": """
with d as (select * from (select *, row_number() over (partition by det_id order by arrived_at) as k from detections where det_id is not null) where k = 1 and isfinite(x) and isfinite(y)),
r as (select run_id, cast(json_extract(params, '$.roi_polygon') as double[][]) as ring from job_meta where json_extract(params, '$.roi_polygon') is not null),
v as (select run_id, len(ring) as n, unnest(range(1, len(ring) + 1)) as i, ring from r where len(ring) >= 3),
e as (select run_id, ring[i][1] as ax, ring[i][2] as ay, ring[case when i = n then 1 else i + 1 end][1] as bx, ring[case when i = n then 1 else i + 1 end][2] as b_y from v)
select d.run_id, det_id from d join e on d.run_id = e.run_id where (ay > y) <> (b_y > y) and x < (bx - ax) * (y - ay) / (b_y - ay) + ax
group by 1, 2 having count(*) % 2 = 1""",
    "p5_found": """
with d as (select distinct det_id, run_id, frame, cast(x as double) as x, cast(y as double) as y from detections
  where frame is not null and x is not null and y is not null and not isnan(x) and not isnan(y) and det_id is not null)
select a.det_id as det_id_a, b.det_id as det_id_b from d a join d b on a.run_id = b.run_id and a.frame = b.frame and a.det_id < b.det_id
where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16""",
}
