"""Queries over tracks and positions, with their oracles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesoflow.operators import correlation as C
from mesoflow.operators import series as R
from mesoflow.operators import track_stats as K
from mesoflow.operators.detect_stats import histogram
from mesoflow.plans.detection_queries import _hist
from mesoflow.plans.base import D_SQL, M_SQL, T_SQL, detections, finite, tracks, with_run
from mesoflow.session import first_arrival, table


def track_counts(spark: SparkSession, d: str) -> DataFrame:
    t = K.track_lengths(tracks(spark, d))
    return t.withColumn("mean_x", F.round("mean_x", 6)).withColumn("mean_y", F.round("mean_y", 6))


def track_length_filter(spark: SparkSession, d: str) -> DataFrame:
    t = with_run(tracks(spark, d), spark, d, "params.min_len")
    return K.long_tracks(t, F.col("min_len")).select("obs_id", "run_id", "particle", "frame")


def track_length_hist(spark: SparkSession, d: str) -> DataFrame:
    return histogram(K.track_lengths(tracks(spark, d)).select("run_id", "n").withColumnRenamed("n", "length"), ["run_id"], "length", 30)


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).groupBy("run_id").agg(F.count_distinct("particle").alias("n_tracks"), F.count_distinct("frame").alias("n_frames"), F.count(F.lit(1)).alias("n_rows"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    t = with_run(tracks(spark, d), spark, d, "frame_start", "frame_end", "w", "h", "params.edge_px")
    return K.flag_events(t, F.col("frame_start"), F.col("frame_end"), F.col("w"), F.col("h"), F.col("edge_px"))


def flag_events(spark: SparkSession, d: str) -> DataFrame:
    f = _flags(spark, d)
    return f.withColumn("x_px", F.round("x_px", 6)).withColumn("y_px", F.round("y_px", 6))


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return K.drop_rate(tracks(spark, d), _flags(spark, d))


def step_tip(spark: SparkSession, d: str) -> DataFrame:
    """Where the suggested maximum step is more than 30 % off the run's."""
    t = tracks(spark, d)
    return K.step_tip(t, with_run(t.select("run_id").distinct(), spark, d, "params.max_step_um"))


def track_steps(spark: SparkSession, d: str) -> DataFrame:
    return K.steps(tracks(spark, d))


def auto_max_step(spark: SparkSession, d: str) -> DataFrame:
    return K.suggested_max_step(tracks(spark, d))


def auto_min_length(spark: SparkSession, d: str) -> DataFrame:
    return K.suggested_min_length(tracks(spark, d))


def displacement_arrows(spark: SparkSession, d: str) -> DataFrame:
    t = with_run(tracks(spark, d), spark, d, "px_um", "params.max_step_um")
    return K.arrows(t, F.col("max_step_um") / F.col("px_um")).withColumn("strength", F.round("strength", 6))


def mutual_nn(spark: SparkSession, d: str) -> DataFrame:
    return K.mutual_nearest(detections(spark, d).select("run_id", "frame", "det_id", "x", "y"), "det_id", 12.0).withColumn("dist", F.round("dist", 6))


def msd(spark: SparkSession, d: str) -> DataFrame:
    """The whole curve: lags up to half of each run's own span."""
    return K.msd(tracks(spark, d), None).withColumn("msd", F.round("msd", 6))


#: The name that the whole curve had beside one cut at lag 20.
msd_half_span = msd


def _curves(spark: SparkSession, d: str) -> DataFrame:
    """MSD curves to 9 digits, so that a curve of one pair is 0 and not the rest of a rounding."""
    return with_run(K.msd(tracks(spark, d), None).withColumn("msd", F.round("msd", 9)), spark, d, "dt").withColumn("lag_t", F.col("lag") * F.col("dt"))


def msd_slopes(spark: SparkSession, d: str) -> DataFrame:
    """Local log-log slopes of the MSD curve, and the stretch in which it is near 1."""
    s = R.log_gradient(_curves(spark, d), ["run_id"], "lag", "msd")
    run = R.longest_run(s, ["run_id"], "lag", F.abs(F.col("slope") - 1) <= 0.18).where("n > 1")
    return s.select("run_id", "lag", "slope").join(run, "run_id", "left").select("run_id", "lag", F.round("slope", 6).alias("slope"), "first", "last")


def diffusion_fit(spark: SparkSession, d: str) -> DataFrame:
    f = K.diffusion(_curves(spark, d))
    f = f.select("run_id", "n_points", "regime", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("D", "D_err", "intercept", "r2", "terminal_slope", "plateau")])
    return f.withColumn("radius_um", F.round(F.when(F.col("D") > 0, K.stokes_einstein(F.col("D"))), 6))


def affine_step(spark: SparkSession, d: str) -> DataFrame:
    t = with_run(tracks(spark, d), spark, d, "dt")
    out = K.affine_step(t, F.col("dt"), 8)
    return out.select("run_id", "frame", "next_frame", "n", *[F.round(c, 4).alias(c) for c in ("a_x", "b_x", "c_x", "a_y", "b_y", "c_y")])


def cage_relative(spark: SparkSession, d: str) -> DataFrame:
    c = K.cage_relative(tracks(spark, d))
    return c.select("obs_id", F.round("x_cr", 6).alias("x_cr"), F.round("y_cr", 6).alias("y_cr"))


def nn_spacing(spark: SparkSession, d: str) -> DataFrame:
    return K.nn_spacing(detections(spark, d).select("run_id", "frame", "det_id", "x", "y"), "det_id").withColumn("spacing", F.round("spacing", 6))


def local_order_proxy(spark: SparkSession, d: str) -> DataFrame:
    return K.local_order(detections(spark, d).select("run_id", "frame", "det_id", "x", "y"), "det_id").withColumn("score", F.round("score", 6))


def _spins(spark: SparkSession, d: str) -> DataFrame:
    """Up or down by which side of its track's mean a particle is on (ties up)."""
    t = tracks(spark, d)
    side = F.col("y_px") >= F.round(F.avg("y_px").over(Window.partitionBy("run_id", "particle")), 3)
    return t.select("run_id", "particle", "frame", F.when(side, 1).otherwise(-1).alias("s"))


def spin_flips(spark: SparkSession, d: str) -> DataFrame:
    s = with_run(_spins(spark, d), spark, d, "dt")
    return R.spin_stats(s, ["run_id", "particle"], "frame", F.col("dt")).withColumn("up_fraction", F.round("up_fraction", 6)).withColumn("flip_rate", F.round("flip_rate", 6))


def spin_median3(spark: SparkSession, d: str) -> DataFrame:
    return R.median3(_spins(spark, d), ["run_id", "particle"], "frame")


def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    """The whole curve: every lag that two readings of a track are apart."""
    a = R.autocorrelation(_spins(spark, d), ["run_id"], ["particle"], "frame", "s", None)
    return a.withColumn("c", F.round("c", 6)).withColumn("c_norm", F.round("c_norm", 6))


autocorrelation_all_lags = autocorrelation


def stretched_exp_fit(spark: SparkSession, d: str) -> DataFrame:
    """Decay of the spin autocorrelation of each run."""
    import numpy as np

    from mesoflow.operators.groupmap import map_groups

    a = R.autocorrelation(_spins(spark, d), ["run_id"], ["particle"], "frame", "s", None)
    a = with_run(a, spark, d, "dt").select("run_id", (F.col("lag") * F.col("dt")).alias("t"), "c_norm", "dt")

    def one(g):
        fit = R.fit_stretched(g["t"], g["c_norm"], float(g["dt"][0]))
        return fit and {k: np.array([v]) for k, v in fit.items()}

    return map_groups(a, ["run_id"], ["t"], one, "c0 double, tau double, beta double, rms double")


def frame_step(spark: SparkSession, d: str) -> DataFrame:
    """Seconds between frames as the readings' own times have them."""
    t = first_arrival(table(spark, d, "tracks"), "obs_id", "arrived_at", ["run_id", "frame", "t"])
    return K.frame_step(t.where(F.col("frame").isNotNull() & finite("t"))).withColumn("dt", F.round("dt", 9))


def moving_average(spark: SparkSession, d: str) -> DataFrame:
    n = detections(spark, d).groupBy("run_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return R.moving_average(n, ["run_id"], "frame", "n", 3).withColumn("smooth", F.round("smooth", 6))


def smoothed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Detections per frame under the window that grows with the run."""
    n = detections(spark, d).groupBy("run_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return R.smoothed(n, ["run_id"], "frame", "n").withColumn("smooth", F.round("smooth", 6))


def progress_eta(spark: SparkSession, d: str) -> DataFrame:
    """Per run and minute of arrival: detections there so far, their rate over 20 minutes, and the seconds left, plain and smoothed."""
    a = first_arrival(table(spark, d, "detections"), "det_id", "arrived_at", ["run_id"]).where("run_id is not null and arrived_at is not null")
    n = a.groupBy("run_id", (F.floor(F.unix_seconds("arrived_at") / 60) * 60).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy("run_id").agg(F.sum("n").alias("total"))
    n = n.withColumn("done", F.sum("n").over(Window.partitionBy("run_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))).join(whole, "run_id")
    r = R.progress_rate(n, ["run_id"], "t", "done", F.col("total"), 1200)
    return r.select("run_id", "t", "done", "total", *[F.round(c, 6).alias(c) for c in ("rate", "eta", "eta_smooth")])


def hysteresis_flag(spark: SparkSession, d: str) -> DataFrame:
    n = detections(spark, d, "ecc").groupBy("run_id", "frame").agg(F.round(F.avg((F.col("ecc") > 0.15).cast("double")), 6).alias("share"))
    return R.hysteresis(n, ["run_id"], "frame", "share", 0.6, 0.3)


def core_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Detections of a frame joined along x while at most 4 px apart."""
    t = detections(spark, d)
    c = R.collapse_cores(t, ["run_id", "frame"], "x", "y", 4.0)
    return c.withColumn("s", F.round("s", 6)).withColumn("h", F.round("h", 6))


def pair_hist_gofr(spark: SparkSession, d: str) -> DataFrame:
    g = C.pair_correlation(detections(spark, d).select("run_id", "frame", "det_id", "x", "y"), "det_id", 60.0, 2.0)
    return g.withColumn("r", F.round("r", 6)).withColumn("g", F.round("g", 6))


def gofr_interior(spark: SparkSession, d: str) -> DataFrame:
    return C.pair_counts(detections(spark, d).select("run_id", "frame", "det_id", "x", "y"), "det_id", 40.0, 2.0, interior=True)


def spacing_hist(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-neighbour distances over their run's mean, below 3 in 24 bins, beside the level-spacing densities."""
    from mesoflow.operators.proximity import nearest

    n = nearest(detections(spark, d).select("run_id", "frame", "det_id", "x", "y"), ["run_id", "frame"], "det_id", 1)
    n = n.select("run_id", F.sqrt("dist2").alias("_d"))
    mean = n.groupBy("run_id").agg(F.avg("_d").alias("_mean"))
    n = n.join(mean, "run_id").withColumn("_s", F.round(F.col("_d") / F.col("_mean"), 9)).where("_s < 3")
    g = n.groupBy("run_id", F.floor(F.col("_s") * 8).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    s = (F.col("bin") + 0.5) / 8
    return g.select("run_id", "bin", "n", *[F.round(R.wigner(s, b), 9).alias(f"wigner_{b}") for b in (0, 1, 2, 4)])


_NAMES = """track_counts track_length_filter track_length_hist run_summary flag_events quality_gate step_tip track_steps auto_max_step auto_min_length displacement_arrows
mutual_nn msd msd_half_span msd_slopes diffusion_fit affine_step cage_relative nn_spacing local_order_proxy spin_flips spin_median3 autocorrelation autocorrelation_all_lags stretched_exp_fit frame_step moving_average smoothed_counts progress_eta
hysteresis_flag core_collapse pair_hist_gofr gofr_interior spacing_hist""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_STEPS = "s as (select run_id, particle, frame, x_um - lag(x_um) over w as dx, y_um - lag(y_um) over w as dy, frame - lag(frame) over w as gap from t window w as (partition by run_id, particle order by frame))"
_FLAGS = """g as (select t.run_id, particle, min(frame) as f0, max(frame) as f1, avg(x_px) as x_px, avg(y_px) as y_px, any_value(frame_start) as s, any_value(frame_end) as e,
  any_value(w) as w, any_value(h) as h, any_value(edge_px) as edge from t join m on t.run_id = m.run_id group by 1, 2),
i as (select * from g where x_px >= edge and x_px <= w - edge and y_px >= edge and y_px <= h - edge),
f as (select run_id, particle, 'appeared' as kind, f0 as frame, x_px, y_px from i where f0 > s + 5 union all select run_id, particle, 'disappeared', f1, x_px, y_px from i where f1 < e - 5)"""
_MSD = """r as (select run_id, greatest(1, (max(frame) - min(frame)) // 2) as most from t group by 1),
p as (select a.run_id, cast(b.frame - a.frame as bigint) as lag, b.x_um - a.x_um as dx, b.y_um - a.y_um as dy from t a join t b on b.run_id = a.run_id and b.particle = a.particle join r on r.run_id = a.run_id
  where b.frame - a.frame between 1 and most),
q as (select run_id, lag, count(*) as n_pairs, avg(dx * dx + dy * dy) - avg(dx) * avg(dx) - avg(dy) * avg(dy) as msd from p group by 1, 2)"""
_SPIN = "s as (select run_id, particle, frame, case when y_px >= round(avg(y_px) over (partition by run_id, particle), 3) then 1 else -1 end as s from t)"
_KNN = """n as (select a.det_id as a, b.det_id as b, a.run_id, a.frame, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as dist,
  row_number() over (partition by a.det_id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.det_id) as k
  from d a join d b on a.run_id = b.run_id and a.frame = b.frame and a.det_id <> b.det_id)"""
_PI = "cast(3.141592653589793 as double)"

SQL = {
    "track_length_hist": f"""with {T_SQL}, c as (select run_id, particle, count(*) as length from t group by 1, 2), {_hist("c", "length", 30)} select * from g""",
    "frame_step": """with t as (select * from (select *, row_number() over (partition by obs_id order by arrived_at) as k from tracks where obs_id is not null) where k = 1 and frame is not null and isfinite(t)),
m as (select run_id, frame, median(t) as v from t group by 1, 2), g as (select run_id, v - lag(v) over (partition by run_id order by frame) as gap from m)
select run_id, round(median(gap), 9) as dt from g where gap is not null group by 1""",
    "track_counts": f"with {T_SQL} select run_id, particle, count(*) as n, min(frame) as first_frame, max(frame) as last_frame, round(avg(x_px), 6) as mean_x, round(avg(y_px), 6) as mean_y from t group by 1, 2",
    "track_length_filter": f"""with {T_SQL}, {M_SQL}, c as (select t.run_id, particle from t join m on t.run_id = m.run_id group by 1, 2 having count(*) >= max(min_len))
select obs_id, t.run_id, t.particle, frame from t join c on t.run_id = c.run_id and t.particle = c.particle""",
    "run_summary": f"with {T_SQL} select run_id, count(distinct particle) as n_tracks, count(distinct frame) as n_frames, count(*) as n_rows from t group by 1",
    "flag_events": f"with {T_SQL}, {M_SQL}, {_FLAGS} select run_id, particle, kind, frame, round(x_px, 6) as x_px, round(y_px, 6) as y_px from f",
    "quality_gate": f"""with {T_SQL}, {M_SQL}, {_FLAGS}, c as (select run_id, count(*) as n from f group by 1)
select r.run_id, coalesce(n, 0) as n_events, case when coalesce(n, 0) > 10 then 'check linking' else 'ok' end as verdict from (select distinct run_id from t) r left join c on c.run_id = r.run_id""",
    "track_steps": f"with {T_SQL}, {_STEPS} select * from s where gap is not null",
    "auto_max_step": f"with {T_SQL}, {_STEPS} select run_id, round(quantile_cont(sqrt(dx * dx + dy * dy), 0.99) * 1.5, 2) as max_step_um from s where gap is not null group by 1 having count(*) >= 5",
    "auto_min_length": f"with {T_SQL}, c as (select run_id, particle, count(*) as n from t group by 1, 2) select run_id, cast(greatest(3, floor(quantile_cont(n, 0.2))) as int) as min_len from c group by 1",
    "displacement_arrows": f"""with {T_SQL}, {M_SQL}, p as (select a.run_id, a.particle, a.frame, b.x_px - a.x_px as dx, b.y_px - a.y_px as dy from t a join t b
  on a.run_id = b.run_id and a.particle = b.particle and b.frame = a.frame + 1)
select p.run_id, particle, frame, dx, dy, round(least(1.0, sqrt(dx * dx + dy * dy) / (max_step_um / px_um)), 6) as strength from p join m on m.run_id = p.run_id""",
    "mutual_nn": f"""with {D_SQL}, p as (select a.run_id, a.frame, a.det_id as a, b.det_id as b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2
  from d a join d b on a.run_id = b.run_id and b.frame = a.frame + 1),
r as (select *, row_number() over (partition by run_id, frame, a order by d2, b) as i, row_number() over (partition by run_id, frame, b order by d2, a) as j from p where d2 < 144)
select run_id, frame, a, b, round(sqrt(d2), 6) as dist from r where i = 1 and j = 1""",
    "msd": f"with {T_SQL}, {_MSD} select run_id, lag, n_pairs, round(msd, 6) as msd from q",
    "affine_step": f"""with {T_SQL}, {M_SQL}, f as (select run_id, frame, lead(frame) over (partition by run_id order by frame) as next_frame from (select distinct run_id, frame from t)),
j as (select a.run_id, a.frame, f.next_frame, a.x_um as x, a.y_um as y, (b.x_um - a.x_um) / ((f.next_frame - a.frame) * dt) as u, (b.y_um - a.y_um) / ((f.next_frame - a.frame) * dt) as v
  from t a join f on a.run_id = f.run_id and a.frame = f.frame join t b on b.run_id = a.run_id and b.particle = a.particle and b.frame = f.next_frame join m on m.run_id = a.run_id),
c as (select run_id, frame, next_frame, count(*) as n, avg(x) as mx, avg(y) as my, avg(u) as mu, avg(v) as mv, avg(x * x) - avg(x) * avg(x) as sxx, avg(y * y) - avg(y) * avg(y) as syy,
  avg(x * y) - avg(x) * avg(y) as sxy, avg(x * u) - avg(x) * avg(u) as pu, avg(y * u) - avg(y) * avg(u) as qu, avg(x * v) - avg(x) * avg(v) as pv, avg(y * v) - avg(y) * avg(v) as qv from j group by 1, 2, 3 having count(*) >= 8),
b as (select *, (pu * syy - qu * sxy) / (sxx * syy - sxy * sxy) as b_x, (qu * sxx - pu * sxy) / (sxx * syy - sxy * sxy) as c_x,
  (pv * syy - qv * sxy) / (sxx * syy - sxy * sxy) as b_y, (qv * sxx - pv * sxy) / (sxx * syy - sxy * sxy) as c_y from c where sxx * syy - sxy * sxy > 1e-12)
select run_id, frame, next_frame, n, round(mu - b_x * mx - c_x * my, 4) + 0.0 as a_x, round(b_x, 4) + 0.0 as b_x, round(c_x, 4) + 0.0 as c_x, round(mv - b_y * mx - c_y * my, 4) + 0.0 as a_y, round(b_y, 4) + 0.0 as b_y, round(c_y, 4) + 0.0 as c_y from b""",
    "cage_relative": f"""with {T_SQL}, n as (select a.obs_id, b.x_px as bx, b.y_px as y2, row_number() over (partition by a.obs_id order by (a.x_px - b.x_px) * (a.x_px - b.x_px) + (a.y_px - b.y_px) * (a.y_px - b.y_px), b.obs_id) as k
  from t a join t b on a.run_id = b.run_id and a.frame = b.frame and a.obs_id <> b.obs_id),
c as (select obs_id, avg(bx) as mx, avg(y2) as my from n where k <= 8 group by 1)
select t.obs_id, round(x_px - coalesce(mx, 0), 6) as x_cr, round(y_px - coalesce(my, 0), 6) as y_cr from t left join c on c.obs_id = t.obs_id""",
    "nn_spacing": f"""with {D_SQL}, f as (select run_id, frame, count(*) as n from d group by 1, 2),
o as (select *, row_number() over (partition by run_id order by frame) - 1 as pos, greatest(1, floor(count(*) over (partition by run_id) / 12)) as step from f),
u as (select run_id, frame from o where pos % step = 0 and floor(pos / step) < 12 and n >= 8), {_KNN}
select n.run_id, count(*) as n, round(median(dist), 6) as spacing from n join u on n.run_id = u.run_id and n.frame = u.frame where k = 1 group by 1""",
    "local_order_proxy": f"""with {D_SQL}, {_KNN}, g as (select a, count(*) as c, avg(dist * dist) - avg(dist) * avg(dist) as v, median(dist) as m from n where k <= 6 group by 1)
select det_id, case when c >= 6 then round(least(1.0, greatest(0.0, 1 - sqrt(greatest(v, 0.0)) / m / 0.5)), 6) else 0.0 end as score from d left join g on g.a = d.det_id""",
    "spin_flips": f"""with {T_SQL}, {M_SQL}, {_SPIN}, f as (select *, case when s <> lag(s) over (partition by run_id, particle order by frame) then 1 else 0 end as fl from s),
g as (select run_id, particle, count(*) as n, avg(case when s > 0 then 1.0 else 0.0 end) as up, sum(fl) as flips from f group by 1, 2)
select g.run_id, particle, n, round(up, 6) as up_fraction, cast(flips as bigint) as flips, case when n > 1 then round(flips / (dt * (n - 1)), 6) end as flip_rate from g join m on m.run_id = g.run_id""",
    "spin_median3": f"""with {T_SQL}, {_SPIN} select run_id, particle, frame, cast(sign(coalesce(lag(s) over w, s) + s + coalesce(lead(s) over w, s)) as int) as s from s window w as (partition by run_id, particle order by frame)""",
    "autocorrelation": f"""with {T_SQL}, {_SPIN},
q as (select a.run_id, cast(b.frame - a.frame as bigint) as lag, count(*) as n_pairs, avg(cast(a.s * b.s as double)) as c from s a join s b on b.run_id = a.run_id and b.particle = a.particle and b.frame >= a.frame group by 1, 2)
select q.run_id, q.lag, q.n_pairs, round(q.c, 6) as c, round(q.c / z.c, 6) as c_norm from q join q z on z.run_id = q.run_id and z.lag = 0""",
    "step_tip": f"""with {T_SQL}, {M_SQL}, {_STEPS}, u as (select run_id, round(quantile_cont(sqrt(dx * dx + dy * dy), 0.99) * 1.5, 2) as auto_step_um from s where gap is not null group by 1 having count(*) >= 5)
select u.run_id, max_step_um, auto_step_um, abs(auto_step_um - max_step_um) / greatest(max_step_um, 0.01) > 0.3 as tip from u join m on m.run_id = u.run_id""",
    "msd_slopes": f"""with {T_SQL}, {_MSD}, c as (select run_id, lag, ln(lag) as a, ln(round(msd, 9)) as b from q where round(msd, 9) > 0),
h as (select *, a - lag(a) over w as ha, lead(a) over w - a as hb, b - lag(b) over w as da, lead(b) over w - b as db from c window w as (partition by run_id order by lag)),
g as (select run_id, lag, coalesce((ha * ha * db + hb * hb * da) / (ha * hb * (ha + hb)), db / hb, da / ha) as slope from h),
i as (select *, row_number() over (partition by run_id order by lag) as pos from g),
f as (select *, pos - row_number() over (partition by run_id order by lag) as island from i where abs(slope - 1) <= 0.18),
e as (select run_id, min(lag) as first, max(lag) as last, count(*) as n from f group by run_id, island),
o as (select *, row_number() over (partition by run_id order by n desc, first) as k from e)
select g.run_id, g.lag, round(slope, 6) as slope, o.first, o.last from g left join o on o.run_id = g.run_id and o.k = 1 and o.n > 1""",
    "diffusion_fit": f"""with {T_SQL}, {M_SQL}, {_MSD}, c as (select q.run_id, lag * dt as x, round(msd, 9) as y from q join m on m.run_id = q.run_id where round(msd, 9) > 0 and lag * dt > 0),
h as (select *, ln(x) - lag(ln(x)) over w as ha, lead(ln(x)) over w - ln(x) as hb, ln(y) - lag(ln(y)) over w as da, lead(ln(y)) over w - ln(y) as db, row_number() over w as pos, count(*) over (partition by run_id) as n from c window w as (partition by run_id order by x)),
g as (select run_id, x, y, pos, n, coalesce((ha * ha * db + hb * hb * da) / (ha * hb * (ha + hb)), db / hb, da / ha) as slope from h where n >= 2),
f as (select *, pos - row_number() over (partition by run_id order by pos) as island from g where abs(slope - 1) <= 0.18),
e as (select run_id, min(pos) as a, max(pos) as b, count(*) as k from f group by run_id, island), o as (select *, row_number() over (partition by run_id order by k desc, a) as r from e where k >= 2),
l as (select g.run_id, median(slope) as terminal, median(y) as plateau from g where pos > n - greatest(2, n // 3) group by 1),
u as (select g.run_id, x, y from g left join o on o.run_id = g.run_id and o.r = 1 where case when o.a is not null then pos between o.a and o.b when n - n * 2 // 3 >= 2 then pos > n * 2 // 3 else true end),
v as (select run_id, count(*) as k, avg(x) as mx, avg(y) as my from u group by 1),
w as (select u.run_id, any_value(k) as k, any_value(mx) as mx, any_value(my) as my, sum((x - mx) * (x - mx)) as sxx, sum((x - mx) * (y - my)) as sxy, sum((y - my) * (y - my)) as syy from u join v on v.run_id = u.run_id group by 1),
z as (select u.run_id, sum(pow(y - my - sxy / sxx * (x - mx), 2)) as sse from u join w on w.run_id = u.run_id group by 1),
res as (select w.run_id, k, round(sxy / sxx / 4, 6) + 0.0 as d, case when k > 2 then round(sqrt(sse / (k - 2) / sxx) / 4, 6) end as de, round(my - sxy / sxx * mx, 6) + 0.0 as ic, case when syy > 0 then round(1 - sse / syy, 6) + 0.0 end as r2 from w join z on z.run_id = w.run_id)
select res.run_id, cast(k as int) as n_points, case when terminal >= 0.5 then 'diffusive' else 'caged' end as regime, d as "D", de as "D_err", ic as intercept, r2, round(terminal, 6) + 0.0 as terminal_slope, round(plateau, 6) as plateau,
  case when d > 0 then round({K.K_B * 298.0 / (6 * math.pi * 1e-3) * 1e18!r}::double / d, 6) end as radius_um from res join l on l.run_id = res.run_id""",
    "smoothed_counts": f"""with {D_SQL}, n as (select run_id, frame, count(*) as n from d group by 1, 2),
w as (select *, count(*) over (partition by run_id) as c, row_number() over (partition by run_id order by frame) as pos from n),
h as (select *, case when c < 3 then 0 else (least(greatest(3, least(31, c // 8)), c) - 1) // 2 end as half from w)
select a.run_id, a.frame, any_value(a.n) as n, round(avg(b.n), 6) as smooth from h a join h b on a.run_id = b.run_id and b.pos between a.pos - a.half and a.pos + a.half group by 1, 2""",
    "moving_average": f"with {D_SQL}, n as (select run_id, frame, count(*) as n from d group by 1, 2) select run_id, frame, n, round(avg(n) over (partition by run_id order by frame rows between 3 preceding and 3 following), 6) as smooth from n",
    "hysteresis_flag": f"""with {D_SQL}, n as (select run_id, frame, round(avg(case when ecc > 0.15 then 1.0 when ecc <= 0.15 then 0.0 end), 6) as share from d group by 1, 2),
s as (select *, case when share >= 0.6 then true when share <= 0.3 then false end as said from n)
select run_id, frame, share, coalesce(last_value(said ignore nulls) over (partition by run_id order by frame rows unbounded preceding), false) as flag from s""",
    "core_collapse": f"""with {D_SQL}, a as (select *, case when x - lag(x) over (partition by run_id, frame order by x, det_id) > 4 then 1 else 0 end as cut from d),
b as (select *, sum(cut) over (partition by run_id, frame order by x, det_id rows unbounded preceding) as c from a)
select run_id, frame, cast(c as int) as core_no, round(avg(x), 6) as s, round(avg(y), 6) as h, count(*) as n from b group by 1, 2, 3""",
    "pair_hist_gofr": f"""with {D_SQL}, f as (select run_id, frame, count(*) as n, (max(x) - min(x)) * (max(y) - min(y)) as a from d group by 1, 2),
u as (select run_id, count(*) as fr, avg(n) as nn, avg(case when n > 1 then a else 0.0 end) as aa from f group by 1),
p as (select a.run_id, cast(least(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2.0), 29) as int) as bin, count(*) as n from d a join d b
  on a.run_id = b.run_id and a.frame = b.frame and a.det_id < b.det_id where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 3600 group by 1, 2),
e as (select u.*, cast(unnest(range(30)) as int) as bin from u)
select e.run_id, e.bin, cast((e.bin + 0.5) * 2.0 as double) as r, coalesce(p.n, 0) as n, case when aa > 0 then round(2 * coalesce(p.n, 0) / (fr * nn * (nn / aa) * (2 * {_PI} * 2.0) * ((e.bin + 0.5) * 2.0)), 6) end as g
from e left join p on p.run_id = e.run_id and p.bin = e.bin""",
    "gofr_interior": f"""with {D_SQL}, o as (select run_id, frame, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from d group by 1, 2),
i as (select d.* from d join o on d.run_id = o.run_id and d.frame = o.frame where x > x0 + 40 and x < x1 - 40 and y > y0 + 40 and y < y1 - 40)
select a.run_id, cast(least(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2.0), 19) as int) as bin, count(*) as n from i a join i b
  on a.run_id = b.run_id and a.frame = b.frame and a.det_id < b.det_id where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 1600 group by 1, 2""",
    "spacing_hist": f"""with {D_SQL}, {_KNN}, s as (select run_id, round(dist / avg(dist) over (partition by run_id), 9) as s from n where k = 1),
g as (select run_id, cast(floor(s * 8) as int) as bin, count(*) as n from s where s < 3 group by 1, 2), v as (select *, cast(bin + 0.5 as double) / 8 as s from g)
select run_id, bin, n, round(exp(-s), 9) as wigner_0, round({_PI} / 2 * s * exp(-{_PI} / 4 * s * s), 9) as wigner_1,
  round(32 / ({_PI} * {_PI}) * s * s * exp(-4 / {_PI} * s * s), 9) as wigner_2, round(262144 / (729 * {_PI} * {_PI} * {_PI}) * pow(s, 4) * exp(-64 / (9 * {_PI}) * s * s), 9) as wigner_4 from v""",
}
SQL["msd_half_span"], SQL["autocorrelation_all_lags"] = SQL["msd"], SQL["autocorrelation"]
