"""The as-of lookup answers for every frame of a run's range."""

from oracle import duck_rows, spark_rows

from mesoflow.plans import detection_queries as Q
from mesoflow.plans.base import D_SQL

EVERY = f"""with {D_SQL}, t as (select run_id, cast(unnest(range(frame_start, frame_end + 1)) as int) as target from job_meta),
n as (select run_id, frame, count(*) as n from d group by 1, 2)
select t.run_id, t.target, max(frame) as shown, max_by(n, frame) as n from t left join n on n.run_id = t.run_id and n.frame <= t.target group by 1, 2"""


def test_every_frame_is_answered(spark, sf_dir):
    got = spark_rows(Q.QUERIES["newest_before_every"](spark, sf_dir))
    assert got == duck_rows(EVERY, sf_dir)
    frames = spark.read.parquet(f"{sf_dir}/job_meta.parquet").selectExpr("sum(frame_end - frame_start + 1)").first()[0]
    assert len(got[1]) == frames
