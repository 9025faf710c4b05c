"""Queries over detections, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesoflow.operators import detect_stats as S
from mesoflow.operators.quantiles import linear_percentiles
from mesoflow.plans.base import D_SQL, M_SQL, detections, finite, with_run
from mesoflow.session import first_arrival, sized_broadcast, table

RUN = ["run_id"]
FRAME = ["run_id", "frame"]


def calibrate_edge_filter(spark: SparkSession, d: str) -> DataFrame:
    t = with_run(detections(spark, d), spark, d, "w", "h", "px_um", "params.edge_px")
    t = S.edge_filter(t, F.col("edge_px"), F.col("w"), F.col("h"))
    return t.select("det_id", "frame", F.col("x").alias("x_px"), F.col("y").alias("y_px"), (F.col("x") * F.col("px_um")).alias("x_um"), (F.col("y") * F.col("px_um")).alias("y_um"))


def frame_time(spark: SparkSession, d: str) -> DataFrame:
    t = with_run(detections(spark, d), spark, d, "dt")
    return S.frame_times(t, F.col("dt")).withColumn("t", F.round("t", 6))


def ecc_filter(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d, "ecc").where(F.col("ecc") <= 0.8).select("det_id", "run_id", "frame", "ecc")


def mad_outlier_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.mad_outliers(detections(spark, d), FRAME).select("det_id")


def adaptive_minmass(spark: SparkSession, d: str) -> DataFrame:
    return S.adaptive_min_mass(detections(spark, d), FRAME).select("det_id")


def percentile_mass_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.above_percentile(detections(spark, d), RUN, 0.8).select("det_id")


def sweep_minmass(spark: SparkSession, d: str) -> DataFrame:
    return S.sweep_counts(detections(spark, d), RUN, 500.0, 12000.0).withColumn("threshold", F.round("threshold", 6))


def sweep_minmass_per_run(spark: SparkSession, d: str) -> DataFrame:
    """The 20 thresholds of each run: a tenth (10 at least) to four times its own minmass (1000 if it has none)."""
    m = F.coalesce("minmass", F.lit(1000.0))
    t = with_run(detections(spark, d), spark, d, "params.minmass")
    return S.sweep_counts(t, RUN, F.greatest(F.lit(10.0), m * 0.1), m * 4).withColumn("threshold", F.round("threshold", 6))


def mass_histogram(spark: SparkSession, d: str) -> DataFrame:
    logs = detections(spark, d).select("run_id", "mass")
    return S.histogram(logs, RUN, "mass", 50)


def ecc_histogram(spark: SparkSession, d: str) -> DataFrame:
    t = detections(spark, d, "ecc").where(finite("ecc")).select("run_id", "ecc")
    return S.histogram(t, RUN, "ecc", 30)


def subpixel_histogram(spark: SparkSession, d: str) -> DataFrame:
    t = detections(spark, d).select("run_id", F.floor(F.pmod("x", F.lit(1.0)) * 20).cast("int").alias("bin"))
    return t.groupBy("run_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def otsu_256(spark: SparkSession, d: str) -> DataFrame:
    h = S.histogram(detections(spark, d).select("run_id", "mass"), RUN, "mass", 256)
    return S.otsu(h, RUN).withColumn("threshold", F.round("threshold", 4))


def auto_min_mass_otsu(spark: SparkSession, d: str) -> DataFrame:
    return S.auto_min_mass(detections(spark, d), RUN)


def pixel_locking(spark: SparkSession, d: str) -> DataFrame:
    return S.pixel_locking(detections(spark, d), RUN)


def frame_count_dips(spark: SparkSession, d: str) -> DataFrame:
    return S.count_dips(detections(spark, d), RUN)


def missing_frames(spark: SparkSession, d: str) -> DataFrame:
    return S.missing_frames(detections(spark, d), table(spark, d, "job_meta").select("run_id", "frame_start", "frame_end"))


def chunk_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Detections of each task's frame range; a frame's task is computed, so the join is an equality."""
    meta = table(spark, d, "job_meta").select("run_id", "frame_start", "frame_end", "chunk_size")
    n = detections(spark, d).groupBy("run_id", "frame").agg(F.count(F.lit(1)).alias("n")).join(sized_broadcast(meta), "run_id")
    n = n.where("chunk_size > 0 and frame between frame_start and frame_end").withColumn("task", F.floor((F.col("frame") - F.col("frame_start")) / F.col("chunk_size")).cast("int"))
    per = n.groupBy("run_id", "task").agg(F.sum("n").alias("n_detections"))
    return S.chunk_ranges(meta).join(per, ["run_id", "task"], "left").fillna(0, ["n_detections"])


def bundle_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.bundle_summary(detections(spark, d), table(spark, d, "job_meta").select("run_id", "frame_start", "frame_end"))


def stale_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose recorded number of detections is not that of the table."""
    n = first_arrival(table(spark, d, "detections"), "det_id", "arrived_at", ["run_id"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_found"))
    m = table(spark, d, "job_meta").select("run_id", "n_detections").join(n, "run_id", "left").fillna(0, ["n_found"])
    return m.where(~F.col("n_detections").eqNullSafe(F.col("n_found")))


def mass_bands(spark: SparkSession, d: str) -> DataFrame:
    """Mean mass of the lowest and highest quarter of a run, and the share above four times the 20th percentile."""
    t = detections(spark, d)
    cut = linear_percentiles(t, RUN, "mass", {"p20": 0.2, "p25": 0.25, "p75": 0.75}).drop("n_rows")
    j = t.join(cut, "run_id")
    m = F.col("mass")
    return j.groupBy("run_id").agg(
        F.round(F.avg(F.when(m <= F.col("p25"), m)), 4).alias("low_mean"),
        F.round(F.avg(F.when(m >= F.col("p75"), m)), 4).alias("high_mean"),
        F.round(F.avg(F.when(m > 4 * F.col("p20"), 1.0).otherwise(0.0)), 6).alias("active_share"),
    )


def newest_before(spark: SparkSession, d: str) -> DataFrame:
    """For every frame of a run's range the newest frame with detections at or before it: as-of merge of the asked frames and those with detections, in frame order."""
    m = table(spark, d, "job_meta").where("frame_end >= frame_start").select("run_id", F.explode(F.sequence("frame_start", "frame_end")).alias("frame"), F.lit(1).alias("asked"), F.lit(None).cast("bigint").alias("n"))
    n = detections(spark, d).groupBy("run_id", "frame").agg(F.lit(0).alias("asked"), F.count(F.lit(1)).alias("n")).select("run_id", "frame", "asked", "n")
    line = Window.partitionBy("run_id").orderBy("frame", "asked").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("n").isNotNull(), F.struct("frame", "n")), ignorenulls=True).over(line)
    both = n.unionByName(m).withColumn("_seen", seen).where("asked = 1")
    return both.select("run_id", F.col("frame").alias("target"), F.col("_seen.frame").alias("shown"), F.col("_seen.n").alias("n"))


#: The name that this had beside one of every tenth frame.
newest_before_every = newest_before


_NAMES = """calibrate_edge_filter frame_time ecc_filter mad_outlier_filter adaptive_minmass percentile_mass_filter sweep_minmass sweep_minmass_per_run mass_histogram
ecc_histogram subpixel_histogram otsu_256 auto_min_mass_otsu pixel_locking frame_count_dips missing_frames chunk_assignment bundle_summary
stale_metadata mass_bands newest_before newest_before_every""".split()
QUERIES = {n: globals()[n] for n in _NAMES}


def _hist(table_sql: str, column: str, bins: int) -> str:
    return f"""e as (select run_id, min({column}) as a0, max({column}) as b0 from {table_sql} group by 1),
f as (select run_id, case when a0 = b0 then a0 - 0.5 else a0 end as a, case when a0 = b0 then b0 + 0.5 else b0 end as b from e),
h as (select z.run_id, cast(least(floor(({column} - a) / (b - a) * {bins}), {bins - 1}) as int) as bin, a, b, count(*) as n from {table_sql} z join f on z.run_id = f.run_id group by 1, 2, 3, 4),
g as (select run_id, bin, a + bin * ((b - a) / {bins}) as lo, a + (bin + 1) * ((b - a) / {bins}) as hi, n from h)"""


_OTSU = """c as (select run_id, bin, (lo + hi) / 2 as mid, n, sum(n) over w as w0, sum(n * ((lo + hi) / 2)) over w as s0,
  sum(n) over (partition by run_id) as w1, sum(n * ((lo + hi) / 2)) over (partition by run_id) as s1 from g window w as (partition by run_id order by bin)),
v as (select run_id, bin, mid, round((w0 / w1) * (1 - w0 / w1) * (s0 / w0 - (s1 - s0) / (w1 - w0)) * (s0 / w0 - (s1 - s0) / (w1 - w0)), 9) as v from c where w0 > {least} and w1 - w0 > {least}),
k as (select run_id, mid, row_number() over (partition by run_id order by v desc, bin) as k from v)"""

SQL = {
    "calibrate_edge_filter": f"""with {D_SQL}, {M_SQL} select det_id, frame, x as x_px, y as y_px, x * px_um as x_um, y * px_um as y_um
from d join m on d.run_id = m.run_id where x >= edge_px and x <= w - 1 - edge_px and y >= edge_px and y <= h - 1 - edge_px""",
    "frame_time": f"""with {D_SQL}, {M_SQL}, f as (select run_id, min(frame) as f0 from d group by 1)
select distinct d.run_id, d.frame, round((d.frame - f0) * dt, 6) as t from d join f on d.run_id = f.run_id join m on m.run_id = d.run_id""",
    "ecc_filter": f"with {D_SQL} select det_id, run_id, frame, ecc from d where ecc <= 0.8 and not isnan(ecc)",
    "mad_outlier_filter": f"""with {D_SQL}, a as (select *, median(mass) over (partition by run_id, frame) as med, count(*) over (partition by run_id, frame) as n from d),
b as (select *, abs(mass - med) as dev, median(abs(mass - med)) over (partition by run_id, frame) as mad from a),
c as (select *, max(case when dev <= 2.5 * 1.4826 * mad then 1 else 0 end) over (partition by run_id, frame) as anyone from b)
select det_id from c where n < 5 or mad <= 1e-9 or anyone = 0 or dev <= 2.5 * 1.4826 * mad""",
    "adaptive_minmass": f"""with {D_SQL}, a as (select *, median(mass) over (partition by run_id, frame) as med, count(*) over (partition by run_id, frame) as n from d)
select det_id from a where n < 8 or med <= 0 or mass >= 0.05 * med""",
    "percentile_mass_filter": f"""with {D_SQL}, a as (select run_id, quantile_cont(mass, 0.8) as q from d group by 1) select det_id from d join a on d.run_id = a.run_id where mass > q""",
    "sweep_minmass": f"""with {D_SQL}, s as (select unnest(range(20)) as step), r as (select distinct run_id from d),
g as (select run_id, cast(step as int) as step, cast(500.0 as double) + cast(11500.0 as double) / 19 * step as threshold from r, s)
select g.run_id, g.step, round(g.threshold, 6) as threshold, count(d.det_id) as n from g left join d on d.run_id = g.run_id and d.mass >= g.threshold group by 1, 2, 3""",
    "sweep_minmass_per_run": f"""with {D_SQL}, s as (select unnest(range(20)) as step), r as (select d.run_id, any_value(coalesce(cast(json_extract_string(params, '$.minmass') as double), 1000)) as mm
  from d left join job_meta j on j.run_id = d.run_id group by 1), e as (select run_id, greatest(10.0::double, mm * 0.1::double) as a, mm * 4 as b from r),
g as (select run_id, cast(step as int) as step, a + (b - a) / 19 * step as threshold from e, s)
select g.run_id, g.step, round(g.threshold, 6) as threshold, count(d.det_id) as n from g left join d on d.run_id = g.run_id and d.mass >= g.threshold group by 1, 2, 3""",
    "mass_histogram": f"with {D_SQL}, {_hist('d', 'mass', 50)} select * from g",
    "ecc_histogram": f"with {D_SQL}, x as (select run_id, ecc from d where isfinite(ecc)), {_hist('x', 'ecc', 30)} select * from g",
    "subpixel_histogram": f"with {D_SQL} select run_id, cast(floor((x - floor(x)) * 20) as int) as bin, count(*) as n from d group by 1, 2",
    "otsu_256": f"with {D_SQL}, {_hist('d', 'mass', 256)}, {_OTSU.format(least=0)} select run_id, round(mid, 4) as threshold from k where k = 1",
    "auto_min_mass_otsu": f"""with {D_SQL}, l as (select run_id, ln(1 + mass) as v from d),
e as (select run_id, quantile_cont(v, 0.02) as a, quantile_cont(v, 0.98) as b, count(*) as n from l group by 1 having count(*) >= 10),
h as (select l.run_id, cast(least(floor((v - a) / (b - a) * 200), 199) as int) as bin, a, b, count(*) as n from l join e on l.run_id = e.run_id where b > a and v >= a and v <= b group by 1, 2, 3, 4),
g as (select run_id, bin, a + bin * ((b - a) / 200) as lo, a + (bin + 1) * ((b - a) / 200) as hi, n from h), {_OTSU.format(least=2)}
select run_id, cast(floor(exp(mid) - 1) as bigint) as minmass from k where k = 1""",
    "pixel_locking": f"""with {D_SQL}, f as (select run_id, x - floor(x) as fx, y - floor(y) as fy from d),
a as (select run_id, count(*) as n, (avg(fx * fx) - avg(fx) * avg(fx) + (avg(fy * fy) - avg(fy) * avg(fy))) / (2 / 12) as r from f group by 1)
select run_id, round(case when n < 20 then 1.0 else r end, 3) as ratio, case when n < 20 then 1.0 else r end < 0.5 as is_locked from a""",
    "frame_count_dips": f"""with {D_SQL}, n as (select run_id, frame, count(*) as n from d group by 1, 2), m as (select run_id, median(n) as med from n group by 1)
select n.run_id, frame, n from n join m on n.run_id = m.run_id where n < 0.5 * med""",
    "missing_frames": f"""with {D_SQL}, e as (select run_id, cast(unnest(range(frame_start, frame_end + 1)) as int) as frame from job_meta)
select e.run_id, e.frame from e anti join d on e.run_id = d.run_id and e.frame = d.frame""",
    "chunk_assignment": f"""with {D_SQL}, c as (select run_id, cast(unnest(range(0, (frame_end - frame_start) // chunk_size + 1)) as int) as task, frame_start, frame_end, chunk_size from job_meta where chunk_size > 0),
r as (select run_id, task, cast(frame_start + task * chunk_size as int) as first, cast(least(frame_start + (task + 1) * chunk_size - 1, frame_end) as int) as last from c)
select r.run_id, task, first, last, count(d.det_id) as n_detections from r left join d on d.run_id = r.run_id and d.frame between first and last group by 1, 2, 3, 4""",
    "bundle_summary": f"""with {D_SQL}, a as (select run_id, count(*) as n, count(distinct frame) as f, count(distinct case when in_range then frame end) as g from
  (select d.*, d.frame between frame_start and frame_end as in_range from d join job_meta j on d.run_id = j.run_id) group by 1)
select j.run_id, frame_end - frame_start + 1 as frames_expected, coalesce(n, 0) as n_detections, coalesce(f, 0) as frames_with_detections,
  frame_end - frame_start + 1 - coalesce(g, 0) as frames_without_detections from job_meta j left join a on j.run_id = a.run_id""",
    "stale_metadata": """with n as (select run_id, count(distinct det_id) as n_found from detections where det_id is not null group by 1)
select j.run_id, n_detections, coalesce(n_found, 0) as n_found from job_meta j left join n on j.run_id = n.run_id where n_detections is distinct from coalesce(n_found, 0)""",
    "mass_bands": f"""with {D_SQL}, c as (select run_id, quantile_cont(mass, 0.2) as p20, quantile_cont(mass, 0.25) as p25, quantile_cont(mass, 0.75) as p75 from d group by 1)
select d.run_id, round(avg(case when mass <= p25 then mass end), 4) as low_mean, round(avg(case when mass >= p75 then mass end), 4) as high_mean,
  round(avg(case when mass > 4 * p20 then 1.0 else 0.0 end), 6) as active_share from d join c on d.run_id = c.run_id group by 1""",
    "newest_before": f"""with {D_SQL}, t as (select run_id, cast(unnest(range(frame_start, frame_end + 1)) as int) as target from job_meta),
n as (select run_id, frame, count(*) as n from d group by 1, 2)
select t.run_id, t.target, max(frame) as shown, max_by(n, frame) as n from t left join n on n.run_id = t.run_id and n.frame <= t.target group by 1, 2""",
}
SQL["newest_before_every"] = SQL["newest_before"]
