import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesoflow.operators import series as R
from mesoflow.operators import track_stats as K
from mesoflow.operators.correlation import default_range, pair_correlation
from mesoflow.operators.detect_stats import implied_ratio_verdict, odd

RNG = np.random.default_rng(5)


def test_brownian_curve_gives_its_constant():
    t = np.arange(1, 40) * 0.1
    fit = K.fit_diffusion(t, 4 * 0.7 * t)
    assert fit["D"] == pytest.approx(0.7) and fit["regime"] == "diffusive" and fit["r2"] == pytest.approx(1)
    caged = K.fit_diffusion(t, 0.3 * (1 - np.exp(-t / 0.05)))
    assert caged["regime"] == "caged" and caged["plateau"] == pytest.approx(0.3, abs=1e-3)
    assert K.fit_diffusion(t[:1], t[:1]) is None and K.fit_diffusion(t, -t) is None


def test_pure_drift_has_no_msd(spark):
    rows = [("r", p, f, p * 3.0 + 0.5 * f, p * 2.0 - 0.25 * f) for p in range(6) for f in range(20)]
    t = spark.createDataFrame(rows, "run_id string, particle bigint, frame int, x_um double, y_um double")
    got = K.msd(t, 5).collect()
    assert len(got) == 5 and all(abs(r["msd"]) < 1e-9 for r in got)
    assert K.msd(t, 5, drift_subtract=False).where("lag = 2").first()["msd"] == pytest.approx(1 + 0.25)


def test_gradient_and_longest_run(spark):
    x = np.array([1, 2, 3, 5, 9, 14.0])
    y = np.exp(RNG.normal(0, 1, 6))
    df = spark.createDataFrame([("r", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    s = R.log_gradient(df, ["g"], "x", "y")
    got = [r["slope"] for r in s.orderBy("x").collect()]
    assert got == pytest.approx(np.gradient(np.log(y), np.log(x)).tolist())
    flags = spark.createDataFrame([("r", i, v) for i, v in enumerate([1, 1, 0, 1, 1, 0, 1])], "g string, i int, v int")
    r = R.longest_run(flags, ["g"], "i", F.col("v") == 1).first()
    assert (r["first"], r["last"], r["n"]) == (0, 1, 2)


def test_autocorrelation_equals_numpy(spark):
    v = RNG.normal(size=(3, 40))
    df = spark.createDataFrame([("r", s, k, float(v[s, k])) for s in range(3) for k in range(40)], "run string, site int, k int, v double")
    got = {r["lag"]: r["c"] for r in R.autocorrelation(df, ["run"], ["site"], "k", "v", 5, centre=True).collect()}
    c = v - v.mean(1, keepdims=True)
    for lag in range(6):
        assert got[lag] == pytest.approx((c[:, : 40 - lag] * c[:, lag:]).mean())


def test_stretched_exponential_is_recovered():
    t = np.arange(0, 30) * 0.5
    c = 0.2 + 0.8 * np.exp(-((t / 3.0) ** 0.7))
    fit = R.fit_stretched(t, c, 0.5)
    assert (fit["c0"], fit["tau"], fit["beta"]) == pytest.approx((0.2, 3.0, 0.7), rel=0.02)
    assert R.fit_stretched(t[:3], c[:3], 0.5) is None


def test_uniform_points_are_uncorrelated(spark):
    rows = [("r", f, f * 1000 + i, float(x), float(y)) for f in range(4) for i, (x, y) in enumerate(RNG.uniform(0, 400, (400, 2)))]
    p = spark.createDataFrame(rows, "run_id string, frame int, id bigint, x double, y double")
    g = [r["g"] for r in pair_correlation(p, "id", 40.0, 4.0).orderBy("bin").collect()]
    assert len(g) == 10 and all(abs(v - 1) < 0.25 for v in g[1:])
    r, dr = default_range(F.lit(1.5))
    assert tuple(spark.range(1).select(r, dr).first()) == (15.0, 0.15)


def test_small_formulas(spark):
    one = spark.createDataFrame([(0.5,)], "s double")
    for beta in (0, 1, 2, 4):
        xs = np.linspace(0, 8, 4001)
        df = spark.createDataFrame([(float(v),) for v in xs], "s double")
        w = np.array([r[0] for r in df.select(R.wigner(F.col("s"), beta)).collect()])
        assert np.trapezoid(w, xs) == pytest.approx(1, abs=2e-3)
    with pytest.raises(ValueError):
        R.wigner(F.col("s"), 3)
    assert one.select(K.stokes_einstein(F.lit(0.5))).first()[0] == pytest.approx(1.380649e-23 * 298 / (6 * math.pi * 1e-3 * 0.5e-12) * 1e6)
    h, verdict = implied_ratio_verdict(F.lit(0.9))
    r = one.select(h.alias("h"), verdict.alias("v")).first()
    assert r["h"] == pytest.approx(1 + math.sqrt(1 - 0.81)) and r["v"] == "buckling"
    said = [one.select(*implied_ratio_verdict(F.lit(x))).first() for x in (0.7, 0.99, 1.2)]
    assert [r[1] for r in said] == ["second layer", "no asymmetry", "no asymmetry"] and said[2][0] is None
    assert [one.select(odd(F.lit(x))).first()[0] for x in (3.2, 4.0, 7.9)] == [3, 5, 9]


def test_running_means(spark):
    v = [float(x) for x in RNG.normal(size=150)]
    df = spark.createDataFrame([("r", i, x if i % 9 else None) for i, x in enumerate(v)] + [("s", 0, None)], "g string, i int, v double")
    want, now = [], None
    for i, x in enumerate(v):
        if i % 9:
            now = x if now is None else 0.6 * now + 0.4 * x
        want.append(now)
    got = [r["ema"] for r in R.exponential_mean(df, ["g"], "i", "v").where("g = 'r'").orderBy("i").collect()]
    assert got[0] is None and got[1:] == pytest.approx(want[1:], abs=1e-12)
    assert R.exponential_mean(df, ["g"], "i", "v").where("g = 's'").first()["ema"] is None
    few = spark.createDataFrame([("a", i, float(i * i)) for i in range(40)] + [("b", i, 1.0 * i) for i in range(2)], "g string, i int, v double")
    rows = {(r["g"], r["i"]): r["smooth"] for r in R.smoothed(few, ["g"], "i", "v").collect()}
    assert rows["a", 10] == pytest.approx(np.mean([k * k for k in range(8, 13)])) and rows["a", 0] == pytest.approx(np.mean([0, 1, 4])) and rows["b", 1] == 1.0


def test_remaining_time_is_smoothed(spark):
    df = spark.createDataFrame([("r", 10 * i, min(5 * i, 5 * i if i != 4 else 2)) for i in range(9)], "g string, t int, done int")
    rows = R.progress_rate(df, ["g"], "t", "done", F.lit(100)).orderBy("t").collect()
    assert [r["done"] for r in rows] == [0, 5, 10, 15, 15, 25, 30, 35, 40]
    etas = [r["eta"] for r in rows if r["eta"] is not None]
    smooth = [r["eta_smooth"] for r in rows if r["eta"] is not None]
    now = etas[0]
    for a, b in zip(etas, smooth):
        now = a if a is etas[0] else 0.6 * now + 0.4 * a
        assert b == pytest.approx(now)
