"""Lag curves reach as far as each run does, whatever the others' length."""

import numpy as np
import pytest
from oracle import duck_rows, spark_rows

from mesoflow.operators import series as R
from mesoflow.operators import track_stats as K
from mesoflow.plans import track_queries as Q
from mesoflow.plans.base import T_SQL

MSD = f"""with {T_SQL}, r as (select run_id, greatest(1, (max(frame) - min(frame)) // 2) as most from t group by 1),
p as (select a.run_id, b.frame - a.frame as lag, b.x_um - a.x_um as dx, b.y_um - a.y_um as dy from t a join t b on b.run_id = a.run_id and b.particle = a.particle join r on r.run_id = a.run_id
  where b.frame - a.frame between 1 and most)
select run_id, lag, count(*) as n_pairs, round(avg(dx * dx + dy * dy) - avg(dx) * avg(dx) - avg(dy) * avg(dy), 6) as msd from p group by 1, 2"""
SPINS = f"""with {T_SQL}, {Q._SPIN}, q as (select a.run_id, b.frame - a.frame as lag, count(*) as n_pairs, avg(cast(a.s * b.s as double)) as c
  from s a join s b on b.run_id = a.run_id and b.particle = a.particle and b.frame >= a.frame group by 1, 2)
select q.run_id, q.lag, q.n_pairs, round(q.c, 6) as c, round(q.c / z.c, 6) as c_norm from q join q z on z.run_id = q.run_id and z.lag = 0"""


@pytest.mark.parametrize(("name", "sql"), [("msd_half_span", MSD), ("autocorrelation_all_lags", SPINS)])
def test_whole_curve_equals_sql(spark, sf_dir, name, sql):
    got, want = spark_rows(Q.QUERIES[name](spark, sf_dir)), duck_rows(sql, sf_dir)
    assert got == want
    at = got[0].index("lag")
    assert max(eval(r)[at] for r in got[1]) > 20


def test_lags_follow_the_span_of_their_run(spark):
    rows = [("long", 1, f, float(f % 7), 0.0) for f in range(101)] + [("short", 1, f, float(f), 0.0) for f in range(6)] + [("one", 1, 3, 0.0, 0.0)]
    t = spark.createDataFrame(rows, "run_id string, particle long, frame int, x_um double, y_um double")
    got = {r["run_id"]: (r["n"], r["top"]) for r in K.msd(t, None).groupBy("run_id").agg({"lag": "max", "n_pairs": "sum"}).toDF("run_id", "top", "n").collect()}
    assert got == {"long": (sum(101 - k for k in range(1, 51)), 50), "short": (5 + 4, 2)}
    c = R.autocorrelation(t, ["run_id"], ["particle"], "frame", "x_um", None).where("run_id = 'long'")
    assert sorted((r["lag"], r["n_pairs"]) for r in c.collect()) == [(k, 101 - k) for k in range(101)]


def test_fits_and_slopes_use_the_tail(spark, monkeypatch):
    """Free at first, caged from lag 30 on: only the tail tells."""
    rng = np.random.default_rng(1)
    rows = []
    for p in range(40):
        x, pos = rng.normal(0, 10, 2), np.zeros(2)
        for f in range(301):
            pos = pos * 0.97 + rng.normal(0, 1, 2)
            rows.append((f"{p}-{f}", "r", p, f, *map(float, x + pos), *map(float, x + pos)))
    t = spark.createDataFrame(rows, "obs_id string, run_id string, particle long, frame int, x_px double, y_px double, x_um double, y_um double").cache()
    from pyspark.sql import functions as F

    monkeypatch.setattr(Q, "tracks", lambda *_: t)
    monkeypatch.setattr(Q, "with_run", lambda df, *_: df.withColumn("dt", F.lit(1.0)))
    assert Q.msd_slopes(spark, "").agg({"lag": "max"}).first()[0] == 150
    fit = Q.diffusion_fit(spark, "").first()
    assert fit["regime"] == "caged" and K.fit_diffusion(*(np.array(v, float) for v in zip(*[(r["lag"], r["msd"]) for r in K.msd(t, 20).orderBy("lag").collect()], strict=True)))["regime"] == "diffusive"
    assert Q.stretched_exp_fit(spark, "").count() == 1
