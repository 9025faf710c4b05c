"""Ordered-series operators: moving averages, spins, autocorrelation, hysteresis, curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesoflow.operators.groupmap import lag_sums, map_groups


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, half: int, out: str = "smooth") -> DataFrame:
    """Adds the centred mean of ``2 * half + 1`` rows; NULLs are passed over and the window shrinks at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return df.withColumn(out, F.avg(value).over(w))


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, most: int = 31, share: int = 8, out: str = "smooth") -> DataFrame:
    """Adds the centred mean over a window that grows with the series: n / ``share`` rows, 3 to ``most``, made odd downwards; series under 3 rows stay as they are."""
    w = Window.partitionBy(*keys).orderBy(order)
    size = F.greatest(F.lit(3), F.least(F.lit(most), F.floor(F.col("_rows") / share)))
    half = F.when(F.col("_rows") < 3, 0).otherwise(F.floor((F.least(size, F.col("_rows")) - 1) / 2)).cast("int")
    x = df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("_half", half)
    means = F.col(value).cast("double")
    for k in range(1, (most - 1) // 2 + 1):
        means = F.when(F.col("_half") == k, F.avg(value).over(w.rowsBetween(-k, k))).otherwise(means)
    return x.withColumn(out, means).drop("_rows", "_half")


def exponential_mean(df: DataFrame, keys: list[str], order: str, value: str, keep: float = 0.6, out: str = "ema") -> DataFrame:
    """Adds the running mean ``keep`` * before + (1 - ``keep``) * now, which begins with the first value; NULLs are passed over.

    The weight of what lies further back than the window (``keep`` to the power of its length, below 1e-16) is lost to rounding anyway.
    """
    rows = max(1, int(np.ceil(np.log(1e-16) / np.log(keep))))
    seen = F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, 0))
    x = df.withColumn("_seen", seen)
    fold = F.aggregate(F.slice("_seen", 2, rows + 1), F.element_at("_seen", 1).cast("double"), lambda a, v: a * keep + v * (1 - keep))
    return x.withColumn(out, F.when(F.size("_seen") > 0, fold)).drop("_seen")


def median3(df: DataFrame, keys: list[str], order: str, spin: str = "s") -> DataFrame:
    """Spins (+1, -1) after a median of three in time; the first and last row take themselves for the missing neighbour."""
    w = Window.partitionBy(*keys).orderBy(order)
    around = F.coalesce(F.lag(spin).over(w), F.col(spin)) + F.col(spin) + F.coalesce(F.lead(spin).over(w), F.col(spin))
    return df.withColumn(spin, F.signum(around).cast("int"))


def spin_stats(df: DataFrame, keys: list[str], order: str, dt: Column, spin: str = "s") -> DataFrame:
    """``keys, n, up_fraction, flips, flip_rate``: share of +1, changes of sign, and changes per second (NULL for one row)."""
    w = Window.partitionBy(*keys).orderBy(order)
    f = df.withColumn("_flip", (F.col(spin) != F.lag(spin).over(w)).cast("int")).withColumn("_dt", dt)
    g = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(spin) > 0).cast("double")).alias("up_fraction"), F.coalesce(F.sum("_flip"), F.lit(0)).alias("flips"), F.max("_dt").alias("_dt"))
    return g.select(*keys, "n", "up_fraction", "flips", F.when(F.col("n") > 1, F.col("flips") / (F.col("_dt") * (F.col("n") - 1))).alias("flip_rate"))


def autocorrelation(df: DataFrame, group: list[str], site: list[str], order: str, value: str, max_lag: int | None, centre: bool = False) -> DataFrame:
    """``group, lag, n_pairs, c, c_norm``: mean product of values ``lag`` steps apart over sites and times, lag 0 to ``max_lag``, or all lags there are.

    Pairs need both values. With ``centre`` each site's mean is taken off first. ``c_norm`` is c over c at lag 0, NULL where
    that is 0. One shuffle by site; a task sums a site's pairs lag by lag (a site is bounded by the length of its video).
    """
    x = df.select(*group, *site, F.col(order).cast("bigint").alias("_k"), F.col(value).cast("double").alias("_v")).where("_v is not null")

    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        v = g["_v"] - g["_v"].mean() if centre else g["_v"]
        lag, sums = lag_sums(g["_k"], max_lag if max_lag is not None else 1 << 62, lambda i, j: [np.ones(len(v[i])), v[i] * v[j]])
        return {"lag": lag, "_n": sums[0].astype(np.int64), "_s": sums[1]} if len(lag) else None

    per = map_groups(x, [*group, *site], ["_k", "_v"], one, "lag bigint, _n bigint, _s double")
    g = per.groupBy(*group, "lag").agg(F.sum("_n").alias("n_pairs"), F.sum("_s").alias("_s"))
    g = g.select(*group, "lag", "n_pairs", (F.col("_s") / F.col("n_pairs")).alias("c"))
    # one row per lag
    zero = F.max(F.when(F.col("lag") == 0, F.col("c"))).over(Window.partitionBy(*group))
    return g.withColumn("_zero", zero).select(*group, "lag", "n_pairs", "c", F.when(F.col("_zero") != 0, F.col("c") / F.col("_zero")).alias("c_norm"))


def hysteresis(df: DataFrame, keys: list[str], order: str, value: str, on: float = 0.72, off: float = 0.35) -> DataFrame:
    """Adds ``flag``: true from a value of at least ``on`` until one of at most ``off``; false before the first of either."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col(value) >= on, True).when(F.col(value) <= off, False)
    return df.withColumn("flag", F.coalesce(F.last(said, ignorenulls=True).over(w), F.lit(False)))


def collapse_cores(df: DataFrame, keys: list[str], s: str, h: str, core: float | Column) -> DataFrame:
    """``keys, core_no, s, h, n``: points along a line joined while they are at most ``core`` apart, each group by its mean."""
    line = Window.partitionBy(*keys).orderBy(s, h)
    cut = df.withColumn("_new", (F.coalesce(F.col(s) - F.lag(s).over(line), F.lit(0.0)) > core).cast("int"))
    cut = cut.withColumn("core_no", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return cut.groupBy(*keys, "core_no").agg(F.avg(s).alias("s"), F.avg(h).alias("h"), F.count(F.lit(1)).alias("n"))


def log_gradient(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Adds ``slope``: d ln y / d ln x by second-order differences on uneven steps, one-sided at the ends; NULL where x or y is not positive."""
    good = df.where((F.col(x) > 0) & (F.col(y) > 0)).withColumn("_a", F.log(x)).withColumn("_b", F.log(y))
    w = Window.partitionBy(*keys).orderBy(x)
    ha, hb = F.col("_a") - F.lag("_a").over(w), F.lead("_a").over(w) - F.col("_a")
    da, db = F.col("_b") - F.lag("_b").over(w), F.lead("_b").over(w) - F.col("_b")
    inner = (ha * ha * db + hb * hb * da) / (ha * hb * (ha + hb))
    return good.withColumn("slope", F.coalesce(inner, db / hb, da / ha)).drop("_a", "_b")


def longest_run(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """``keys, first, last, n``: the longest stretch of consecutive rows for which ``flag`` holds, the first of equals."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("_f", flag).withColumn("_i", F.row_number().over(w.orderBy(order))).where("_f")
    r = r.withColumn("_g", F.col("_i") - F.row_number().over(w.orderBy(order)))
    g = r.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    best = g.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("_neg"), "first", "last")).alias("_b"))
    return best.select(*keys, "_b.first", "_b.last", "_b.n")


def progress_rate(df: DataFrame, keys: list[str], t: str, done: str, total: Column, seconds: int = 20) -> DataFrame:
    """Adds ``rate`` (units a second over the last ``seconds``) and ``eta`` (seconds left at that rate, never above an earlier finish by the clock) and ``eta_smooth``, its running mean (0.6 before, 0.4 now).

    Progress that goes back counts as standing still. NULL where nothing was done in the window.
    """
    df = df.withColumn(done, F.max(done).over(Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*keys).orderBy(F.col(t)).rangeBetween(-seconds, 0)
    past = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    span = F.col(t) - F.min(t).over(w)
    r = df.withColumn("rate", F.when(span > 0, (F.col(done) - F.min(done).over(w)) / span))
    finish = F.when(F.col("rate") > 0, F.col(t) + (total - F.col(done)) / F.col("rate"))
    r = r.withColumn("_end", finish).withColumn("eta", F.greatest(F.lit(0.0), F.min("_end").over(past) - F.col(t))).drop("_end")
    return exponential_mean(r, keys, t, "eta", 0.6, "eta_smooth")


def active_share(df: DataFrame, keys: list[str], value: str, times: float = 3.0) -> DataFrame:
    """``keys, share``: rows whose value is above ``times`` the 20th percentile of their group."""
    from mesoflow.operators.quantiles import linear_percentiles

    cut = linear_percentiles(df, keys, value, {"_q": 0.2}).drop("n_rows")
    return df.join(cut, keys).groupBy(*keys).agg(F.avg((F.col(value) > times * F.col("_q")).cast("double")).alias("share"))


def wigner(s: Column, beta: int) -> Column:
    """Level-spacing density at spacing ``s`` for the ensembles of Dyson index 0, 1, 2 and 4; other indices are an error."""
    pi = float(np.pi)
    forms = {
        0: F.exp(-s),
        1: pi / 2 * s * F.exp(-pi / 4 * s * s),
        2: 32 / pi**2 * s * s * F.exp(-4 / pi * s * s),
        4: 2**18 / (3**6 * pi**3) * F.pow(s, F.lit(4)) * F.exp(-64 / (9 * pi) * s * s),
    }
    if beta not in forms:
        raise ValueError(f"beta must be one of {sorted(forms)}")
    return forms[beta]


def stretched(t: Column, c0: Column, tau: Column, beta: Column) -> Column:
    """c0 + (1 - c0) exp(-(|t| / tau) ^ beta)."""
    return c0 + (1 - c0) * F.exp(-F.pow(F.abs(t) / tau, beta))


def fit_stretched(t: np.ndarray, c: np.ndarray, dt: float, rounds: int = 200) -> dict[str, float] | None:
    """c0, tau and beta of a decay curve by damped least squares inside 0 <= c0 <= 1, dt <= tau <= 5 max(t), 0.2 <= beta <= 2; None under four points."""
    good = np.isfinite(t) & np.isfinite(c)
    t, c = np.abs(t[good]), c[good]
    if len(t) < 4 or t.max() <= 0:
        return None
    low, high = np.array([0.0, dt, 0.2]), np.array([1.0, max(5 * t.max(), dt * 1.001), 2.0])

    def model(p: np.ndarray) -> np.ndarray:
        return p[0] + (1 - p[0]) * np.exp(-((t / p[1]) ** p[2]))

    best, cost = None, np.inf
    for tau0 in (t.max() / 10, t.max() / 3, t.max()):
        p, damp = np.clip([max(0.0, float(c[-1])), tau0, 1.0], low, high), 1e-2
        r = c - model(p)
        now = float(r @ r)
        for _ in range(rounds):
            step = 1e-6 * np.maximum(np.abs(p), 1e-3)
            jac = np.stack([(model(p + np.eye(3)[k] * step[k]) - model(p)) / step[k] for k in range(3)], axis=1)
            a = jac.T @ jac
            move = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), jac.T @ r, rcond=None)[0]
            q = np.clip(p + move, low, high)
            rq = c - model(q)
            if float(rq @ rq) < now:
                done = now - float(rq @ rq) < 1e-14 * max(now, 1e-30)
                p, r, now, damp = q, rq, float(rq @ rq), damp / 3
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e9:
                    break
        if now < cost:
            best, cost = p, now
    return {"c0": float(best[0]), "tau": float(best[1]), "beta": float(best[2]), "rms": float(np.sqrt(cost / len(t)))}
