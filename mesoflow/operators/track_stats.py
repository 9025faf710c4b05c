"""Operators on linked tracks: lengths, steps, flags, displacement statistics, drift."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesoflow.operators.groupmap import lag_sums, map_groups
from mesoflow.operators.proximity import nearest
from mesoflow.operators.quantiles import bounded_medians, exact_medians, linear_percentiles

TRACK = ["run_id", "particle"]
#: Boltzmann's constant in J/K (fixed value).
K_B = 1.380649e-23


def track_lengths(t: DataFrame) -> DataFrame:
    """``run_id, particle, n, first_frame, last_frame, mean_x, mean_y``."""
    return t.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.avg("x_px").alias("mean_x"), F.avg("y_px").alias("mean_y"))


def long_tracks(t: DataFrame, least: Column) -> DataFrame:
    """Rows of tracks of at least ``least`` rows (a semi-join with the counts, so no track is gathered)."""
    kept = t.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_n"), F.max(least).alias("_least")).where("_n >= _least")
    return t.join(kept.select(*TRACK), TRACK, "left_semi")


def flag_events(t: DataFrame, start: Column, end: Column, w: Column, h: Column, edge: Column, thresh: int = 5) -> DataFrame:
    """``run_id, particle, kind, frame, x_px, y_px``: tracks that appear or disappear inside the image.

    A track whose mean place is within ``edge`` of the rim is left out. One that
    begins more than ``thresh`` frames after the start has appeared, one that
    ends more than ``thresh`` before the end has disappeared; a track can do both.
    """
    g = t.groupBy(*TRACK).agg(F.min("frame").alias("_f0"), F.max("frame").alias("_f1"), F.avg("x_px").alias("x_px"), F.avg("y_px").alias("y_px"), F.first(start).alias("_s"), F.first(end).alias("_e"), F.first(w).alias("_w"), F.first(h).alias("_h"), F.first(edge).alias("_edge"))
    g = g.where((F.col("x_px") >= F.col("_edge")) & (F.col("x_px") <= F.col("_w") - F.col("_edge")) & (F.col("y_px") >= F.col("_edge")) & (F.col("y_px") <= F.col("_h") - F.col("_edge")))
    new = F.when(F.col("_f0") > F.col("_s") + thresh, F.struct(F.lit("appeared").alias("kind"), F.col("_f0").alias("frame")))
    gone = F.when(F.col("_f1") < F.col("_e") - thresh, F.struct(F.lit("disappeared").alias("kind"), F.col("_f1").alias("frame")))
    return g.withColumn("_k", F.explode(F.array_compact(F.array(new, gone)))).select(*TRACK, "_k.kind", "_k.frame", "x_px", "y_px")


def steps(t: DataFrame) -> DataFrame:
    """``run_id, particle, frame, dx, dy, gap``: change against the track's previous row, however many frames before (``gap``)."""
    line = Window.partitionBy(*TRACK).orderBy("frame")
    d = t.select(*TRACK, "frame", (F.col("x_um") - F.lag("x_um").over(line)).alias("dx"), (F.col("y_um") - F.lag("y_um").over(line)).alias("dy"), (F.col("frame") - F.lag("frame").over(line)).alias("gap"))
    return d.where(F.col("gap").isNotNull())


def suggested_max_step(t: DataFrame) -> DataFrame:
    """``run_id, max_step_um``: 1.5 times the 99th percentile of the step lengths, 2 digits; runs under 5 steps have no row."""
    d = steps(t).select("run_id", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("_d"))
    q = linear_percentiles(d, ["run_id"], "_d", {"_q": 0.99}).where("n_rows >= 5")
    return q.select("run_id", F.round(F.col("_q") * 1.5, 2).alias("max_step_um"))


def suggested_min_length(t: DataFrame) -> DataFrame:
    """``run_id, min_len``: the 20th percentile of the track lengths, at least 3."""
    n = t.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_n"))
    q = linear_percentiles(n, ["run_id"], "_n", {"_q": 0.2})
    return q.select("run_id", F.greatest(F.lit(3), F.floor("_q")).cast("int").alias("min_len"))


def arrows(t: DataFrame, max_step: Column) -> DataFrame:
    """``run_id, particle, frame, dx, dy, strength``: motion from a frame to exactly the next one, ``strength`` = min(1, length / max_step)."""
    nxt = t.select(*TRACK, (F.col("frame") - 1).alias("frame"), F.col("x_px").alias("_x1"), F.col("y_px").alias("_y1"))
    j = t.join(nxt, [*TRACK, "frame"]).withColumn("dx", F.col("_x1") - F.col("x_px")).withColumn("dy", F.col("_y1") - F.col("y_px"))
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return j.select(*TRACK, "frame", "dx", "dy", F.least(F.lit(1.0), length / max_step).alias("strength"))


def half_spans(t: DataFrame) -> DataFrame:
    """``run_id, max_lag``: half the run's span of frames, at least 1."""
    span = F.max("frame") - F.min("frame")
    return t.groupBy("run_id").agg(F.greatest(F.lit(1), F.floor(span / 2)).cast("bigint").alias("max_lag"))


def displacement_sums(t: DataFrame, max_lag: int | None, x: str = "x_um", y: str = "y_um") -> DataFrame:
    """``run_id, lag, n_pairs, sum_sq, sum_x, sum_y`` over all pairs of readings of a track exactly ``lag`` frames apart.

    Without ``max_lag`` each run's lags go up to half its own span. A reading is shuffled once, by its track; a task
    sums its tracks lag by lag (a track is bounded by the length of its video), so no pair leaves it.
    """
    t = t.select(*TRACK, "frame", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    t = t.join(half_spans(t), "run_id") if max_lag is None else t.withColumn("max_lag", F.lit(max_lag).cast("bigint"))

    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        x, y = g["_x"], g["_y"]

        def terms(i: slice, j: slice) -> list[np.ndarray]:
            dx, dy = x[j] - x[i], y[j] - y[i]
            return [np.ones(len(dx)), dx * dx + dy * dy, dx, dy]

        lag, sums = lag_sums(g["frame"], int(g["max_lag"][0]), terms, 1)
        return {"lag": lag, "_n": sums[0].astype(np.int64), "_s": sums[1], "_x": sums[2], "_y": sums[3]} if len(lag) else None

    per = map_groups(t, TRACK, ["frame", "_x", "_y"], one, "lag bigint, _n bigint, _s double, _x double, _y double")
    return per.groupBy("run_id", "lag").agg(F.sum("_n").alias("n_pairs"), F.sum("_s").alias("sum_sq"), F.sum("_x").alias("sum_x"), F.sum("_y").alias("sum_y"))


def msd(t: DataFrame, max_lag: int | None, drift_subtract: bool = True) -> DataFrame:
    """``run_id, lag, n_pairs, msd``: mean squared displacement over particles and times, the mean displacement of a lag taken off unless told otherwise; ``max_lag`` as in ``displacement_sums``."""
    mean = lambda c: F.col(c) / F.col("n_pairs")
    drift = mean("sum_x") * mean("sum_x") + mean("sum_y") * mean("sum_y") if drift_subtract else F.lit(0.0)
    return displacement_sums(t, max_lag).select("run_id", "lag", "n_pairs", (mean("sum_sq") - drift).alias("msd"))


def fit_diffusion(lag_t: np.ndarray, values: np.ndarray, dim: int = 2, slope_tol: float = 0.18, cage_slope: float = 0.5) -> dict[str, float | str | int] | None:
    """Diffusion constant and regime of one curve; None if fewer than two points are positive and finite.

    The regime comes from the median log-log slope of the last third. The line
    is fitted to the longest stretch (the first of equals, two points at
    least) whose log-log slope is within ``slope_tol`` of 1, else to the last third.
    """
    good = np.isfinite(lag_t) & np.isfinite(values) & (lag_t > 0) & (values > 0)
    x, y = lag_t[good], values[good]
    n = len(x)
    if n < 2:
        return None
    slopes = np.gradient(np.log(y), np.log(x))
    tail = max(2, n // 3)
    terminal = float(np.median(slopes[-tail:]))
    flat = np.r_[False, np.abs(slopes - 1) <= slope_tol, False].astype(int)
    begin, end = np.flatnonzero(np.diff(flat) == 1), np.flatnonzero(np.diff(flat) == -1)
    keep = slice(n * 2 // 3, n)
    if len(begin) and (end - begin).max() >= 2:
        i = int(np.argmax(end - begin))
        keep = slice(int(begin[i]), int(end[i]))
    if len(x[keep]) < 2:
        keep = slice(0, n)
    fx, fy = x[keep], y[keep]
    sxx = float(((fx - fx.mean()) ** 2).sum())
    slope = float(((fx - fx.mean()) * (fy - fy.mean())).sum() / sxx)
    rest = fy - fy.mean() - slope * (fx - fx.mean())
    total = float(((fy - fy.mean()) ** 2).sum())
    error = float(np.sqrt((rest**2).sum() / (len(fx) - 2) / sxx)) if len(fx) > 2 else float("nan")
    return {
        "D": slope / (2 * dim),
        "D_err": error / (2 * dim),
        "intercept": float(fy.mean() - slope * fx.mean()),
        "r2": 1 - float((rest**2).sum()) / total if total > 0 else float("nan"),
        "n_points": len(fx),
        "regime": "diffusive" if terminal >= cage_slope else "caged",
        "terminal_slope": terminal,
        "plateau": float(np.median(y[-tail:])),
    }


def diffusion(curves: DataFrame) -> DataFrame:
    """``run_id`` and the fit of its MSD curve (``run_id, lag_t, msd``; a curve has one row per lag)."""

    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        fit = fit_diffusion(g["lag_t"], g["msd"])
        return fit and {k: np.array([v]) for k, v in fit.items()}

    return map_groups(curves.select("run_id", "lag_t", "msd"), ["run_id"], ["lag_t"], one, "D double, D_err double, intercept double, r2 double, n_points int, regime string, terminal_slope double, plateau double")


def stokes_einstein(d_um2: Column, temperature: float = 298.0, viscosity: float = 1e-3) -> Column:
    """Particle radius in um that diffuses at ``d_um2`` um^2/s in a fluid: kT / (6 pi eta D)."""
    return F.lit(K_B * temperature / (6 * np.pi * viscosity) * 1e18) / d_um2


def boltzmann_estimate(d_um2: Column, radius_um: float, temperature: float = 298.0, viscosity: float = 1e-3) -> Column:
    """Boltzmann's constant from a diffusion constant and a known radius: 6 pi eta a D / T."""
    return d_um2 * F.lit(6 * np.pi * viscosity * radius_um * 1e-18 / temperature)


def frame_step(t: DataFrame) -> DataFrame:
    """``run_id, dt``: median difference between the median times (``t``) of consecutive present frames."""
    mid = bounded_medians(t.select("run_id", "frame", "t"), ["run_id", "frame"], "t").select("run_id", "frame", F.col("median").alias("_t"))
    gap = mid.withColumn("_d", F.col("_t") - F.lag("_t").over(Window.partitionBy("run_id").orderBy("frame"))).where("_d is not null")
    return exact_medians(gap, ["run_id"], "_d").select("run_id", F.col("median").alias("dt"))


def affine_step(t: DataFrame, dt: Column, least: int = 20) -> DataFrame:
    """``run_id, frame, next_frame, n, a_x, b_x, c_x, a_y, b_y, c_y``: velocity field v = a + b x + c y between a frame and the next present one.

    Least squares over the particles of both frames by their moments (3 x 3
    normal equations, centred); pairs of frames with fewer than ``least`` shared
    particles, or with all of them on a line, have no row.
    """
    frames = t.select("run_id", "frame").distinct()
    follow = frames.withColumn("next_frame", F.lead("frame").over(Window.partitionBy("run_id").orderBy("frame"))).where("next_frame is not null")
    a = t.select(*TRACK, "frame", "x_um", "y_um", dt.alias("_dt")).join(follow, ["run_id", "frame"])
    b = t.select(*TRACK, F.col("frame").alias("next_frame"), F.col("x_um").alias("_x1"), F.col("y_um").alias("_y1"))
    span = (F.col("next_frame") - F.col("frame")) * F.col("_dt")
    j = a.join(b, [*TRACK, "next_frame"]).withColumn("u", (F.col("_x1") - F.col("x_um")) / span).withColumn("v", (F.col("_y1") - F.col("y_um")) / span)
    x, y, u, v = (F.col(c) for c in ("x_um", "y_um", "u", "v"))
    m = j.groupBy("run_id", "frame", "next_frame").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(k) for k, c in {"mx": x, "my": y, "mu": u, "mv": v, "xx": x * x, "yy": y * y, "xy": x * y, "xu": x * u, "yu": y * u, "xv": x * v, "yv": y * v}.items()]).where(F.col("n") >= least)
    c = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q)
    sxx, syy, sxy = c("mx", "mx", "xx"), c("my", "my", "yy"), c("mx", "my", "xy")
    det = sxx * syy - sxy * sxy
    out = m.withColumn("_det", det).where(F.col("_det") > 1e-12)
    cols = []
    for axis, mean, px, py in (("x", "mu", "xu", "yu"), ("y", "mv", "xv", "yv")):
        p, q = c("mx", mean, px), c("my", mean, py)
        slope_x, slope_y = (p * syy - q * sxy) / F.col("_det"), (q * sxx - p * sxy) / F.col("_det")
        cols += [(F.col(mean) - slope_x * F.col("mx") - slope_y * F.col("my")).alias(f"a_{axis}"), slope_x.alias(f"b_{axis}"), slope_y.alias(f"c_{axis}")]
    return out.select("run_id", "frame", "next_frame", "n", *cols)


def cage_relative(t: DataFrame, k: int = 8, cutoff: float | None = None) -> DataFrame:
    """``obs_id, run_id, particle, frame, x_cr, y_cr``: positions (px) against the mean of the ``k`` nearest others of the frame.

    With ``cutoff`` only neighbours within it count, unless there are none. A row alone in its frame stays as it is.
    """
    p = t.select("run_id", "frame", "obs_id", F.col("x_px").alias("x"), F.col("y_px").alias("y"))
    n = nearest(p, ["run_id", "frame"], "obs_id", k)
    n = n.join(p.select(F.col("obs_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), "b")
    if cutoff is not None:
        inside = F.col("dist2") <= cutoff * cutoff
        some = F.max(inside.cast("int")).over(Window.partitionBy("a"))
        n = n.withColumn("_some", some).where(inside | (F.col("_some") == 0))
    mean = n.groupBy(F.col("a").alias("obs_id")).agg(F.avg("bx").alias("_mx"), F.avg("by").alias("_my"))
    return t.join(mean, "obs_id", "left").select("obs_id", *TRACK, "frame", (F.col("x_px") - F.coalesce("_mx", F.lit(0.0))).alias("x_cr"), (F.col("y_px") - F.coalesce("_my", F.lit(0.0))).alias("y_cr"))


def mutual_nearest(t: DataFrame, rec: str, limit: float) -> DataFrame:
    """``run_id, frame, a, b, dist``: rows of a frame and of the next one that are each other's nearest within ``limit`` px (strict), ties by id.

    A frame and its successor are one group of points, told apart by parity.
    """
    from mesoflow.operators.proximity import near_pairs

    now = t.select("run_id", F.col("frame").alias("g"), (F.col(rec) * 2).alias("_id"), F.col("x"), F.col("y"))
    nxt = t.select("run_id", (F.col("frame") - 1).alias("g"), (F.col(rec) * 2 + 1).alias("_id"), F.col("x"), F.col("y"))
    p = near_pairs(now.unionByName(nxt), ["run_id", "g"], "_id", limit).where((F.pmod("a", F.lit(2)) != F.pmod("b", F.lit(2))) & (F.col("dist2") < limit * limit))
    even = F.pmod("a", F.lit(2)) == 0
    q = p.select("run_id", F.col("g").alias("frame"), F.floor(F.when(even, F.col("a")).otherwise(F.col("b")) / 2).cast("bigint").alias("a"), F.floor(F.when(even, F.col("b")).otherwise(F.col("a")) / 2).cast("bigint").alias("b"), "dist2")
    there = Window.partitionBy("run_id", "frame", "a").orderBy("dist2", "b")
    back = Window.partitionBy("run_id", "frame", "b").orderBy("dist2", "a")
    q = q.withColumn("_i", F.row_number().over(there)).withColumn("_j", F.row_number().over(back)).where("_i = 1 and _j = 1")
    return q.select("run_id", "frame", "a", "b", F.sqrt("dist2").alias("dist"))


def nn_spacing(points: DataFrame, rec: str, sample: int = 12, least: int = 8) -> DataFrame:
    """``run_id, n, spacing``: median distance to the nearest other point over up to ``sample`` evenly spread frames of a run.

    Every ``max(1, n_frames // sample)``-th frame counts, the first ``sample`` of them; frames under ``least`` points are passed over.
    """
    size = points.groupBy("run_id", "frame").agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy("run_id").orderBy("frame")
    size = size.withColumn("_at", F.row_number().over(line) - 1).withColumn("_step", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy("run_id")) / sample)))
    chosen = size.where((F.pmod("_at", F.col("_step")) == 0) & (F.floor(F.col("_at") / F.col("_step")) < sample) & (F.col("_n") >= least))
    p = points.join(chosen.select("run_id", "frame"), ["run_id", "frame"])
    n = nearest(p, ["run_id", "frame"], rec, 1).withColumn("_d", F.sqrt("dist2"))
    return exact_medians(n, ["run_id"], "_d").select("run_id", F.col("n_rows").alias("n"), F.col("median").alias("spacing"))


def local_order(points: DataFrame, rec: str, k: int = 6) -> DataFrame:
    """``rec, score``: evenness of a point's ``k`` neighbour distances, 1 - (std / median) / 0.5 cut to [0, 1]; 0 in frames of at most ``k`` points."""
    n = nearest(points, ["run_id", "frame"], rec, k).withColumn("_d", F.sqrt("dist2"))
    lo, hi = (k - 1) // 2 + 1, k // 2 + 1
    g = n.groupBy("a").agg(F.count(F.lit(1)).alias("_n"), (F.avg(F.col("_d") * F.col("_d")) - F.avg("_d") * F.avg("_d")).alias("_var"), ((F.max(F.when(F.col("rank") == lo, F.col("_d"))) + F.max(F.when(F.col("rank") == hi, F.col("_d")))) / 2).alias("_med"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.sqrt(F.greatest("_var", F.lit(0.0))) / F.col("_med") / 0.5))
    return points.select(rec).join(g.where(F.col("_n") >= k).select(F.col("a").alias(rec), score.alias("_s")), rec, "left").select(rec, F.coalesce("_s", F.lit(0.0)).alias("score"))


def drop_rate(t: DataFrame, flags: DataFrame, limit: int = 10) -> DataFrame:
    """``run_id, n_events, verdict``: runs with more than ``limit`` flag events are to be looked at."""
    n = flags.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events"))
    j = t.select("run_id").distinct().join(n, "run_id", "left").fillna(0, ["n_events"])
    return j.withColumn("verdict", F.when(F.col("n_events") > limit, "check linking").otherwise("ok"))


def step_tip(t: DataFrame, current: DataFrame, share: float = 0.3) -> DataFrame:
    """``run_id, max_step_um, auto_step_um, tip``: true where the suggested maximum step differs from the run's (``current``) by more than ``share`` of that (0.01 at least)."""
    j = current.select("run_id", "max_step_um").join(suggested_max_step(t).withColumnRenamed("max_step_um", "auto_step_um"), "run_id")
    return j.withColumn("tip", F.abs(F.col("auto_step_um") - F.col("max_step_um")) / F.greatest(F.col("max_step_um"), F.lit(0.01)) > share)
