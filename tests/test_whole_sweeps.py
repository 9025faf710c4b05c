"""Sweeps cover each run's own range in all 20 steps; boundary statistics take all points and the run's length."""

import numpy as np
from oracle import duck_rows, spark_rows
from pyspark.sql import functions as F

from mesoflow.operators import boundary_stats as B
from mesoflow.plans import detection_queries as Q
from mesoflow.plans.base import D_SQL

OWN = f"""with {D_SQL}, s as (select unnest(range(20)) as step), r as (select d.run_id, any_value(coalesce(cast(json_extract_string(params, '$.minmass') as double), 1000)) as mm
  from d left join job_meta j on j.run_id = d.run_id group by 1), e as (select run_id, greatest(10.0::double, mm * 0.1::double) as a, mm * 4 as b from r),
g as (select run_id, cast(step as int) as step, a + (b - a) / 19 * step as threshold from e, s)
select g.run_id, g.step, round(g.threshold, 6) as threshold, count(d.det_id) as n from g left join d on d.run_id = g.run_id and d.mass >= g.threshold group by 1, 2, 3"""


def test_minmass_of_each_run(spark, sf_dir):
    assert spark_rows(Q.QUERIES["sweep_minmass_per_run"](spark, sf_dir)) == duck_rows(OWN, sf_dir)


def test_lasting_by_the_length_of_the_run(spark):
    m = spark.createDataFrame([(r, "g", f, True, n) for r, n in (("a", 100), ("b", 20)) for f in range(12)], "run_id string, gb_id string, frame int, low boolean, nf int")
    kept = B.lasting(m, F.greatest(F.lit(10), F.floor(F.col("nf") / 5))).select("run_id").distinct().collect()
    assert [r[0] for r in kept] == ["b"]


def test_structure_factor_at_all_points(spark):
    cores = spark.createDataFrame([("a", 0, f, 1.5 * i, 0.0) for f in range(12) for i in range(5)], "run_id string, gb_id bigint, frame int, s double, h double")
    summary = spark.createDataFrame([("a", 0, 1.5, 6.0)], "run_id string, gb_id bigint, D_um double, L_um double")
    sq = B.structure_factor(cores, summary).collect()
    q = np.linspace(0.05, 3.5, 1600) * 2 * np.pi / 1.5
    want = np.abs(np.exp(1j * np.outer(q, 1.5 * np.arange(5))).sum(1)) ** 2 / 5
    assert len(sq) == 1600 and all(abs(r["S_q"] - want[r["k"]]) < 1e-9 and abs(r["q_um_inv"] - q[r["k"]]) < 1e-9 for r in sq)
