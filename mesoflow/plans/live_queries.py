"""The live operators over the tables (a stream over the same rows gives the same; see tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesoflow.session import first_arrival, table
from mesoflow.streaming.live import live_stats, sessions


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return first_arrival(table(spark, d, "detections"), "det_id", "arrived_at", ["run_id", "frame", "mass", "ecc"])


def window_tumbling_stats(spark: SparkSession, d: str) -> DataFrame:
    s = live_stats(_arrivals(spark, d), window="1 minute")
    return s.withColumn("mean_mass", F.round("mean_mass", 3)).withColumn("frac_round", F.round("frac_round", 6))


def arrival_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(_arrivals(spark, d))


QUERIES = {"window_tumbling_stats": window_tumbling_stats, "arrival_sessions": arrival_sessions}
_A = "a as (select * from (select *, row_number() over (partition by det_id order by arrived_at) as k from detections where det_id is not null) where k = 1 and arrived_at is not null)"
SQL = {
    "window_tumbling_stats": f"""with {_A} select run_id, date_trunc('minute', arrived_at) as start, count(*) as n, round(avg(case when isfinite(mass) then cast(mass as double) end), 3) as mean_mass,
round(avg(case when ecc is not null then case when ecc <= 0.3 then 1.0 else 0.0 end end), 6) as frac_round from a group by 1, 2""",
    "arrival_sessions": f"""with {_A}, g as (select run_id, arrived_at, case when arrived_at - lag(arrived_at) over (partition by run_id order by arrived_at) < interval 30 minute then 0 else 1 end as cut from a),
s as (select run_id, arrived_at, sum(cut) over (partition by run_id order by arrived_at rows unbounded preceding) as k from g)
select run_id, min(arrived_at) as start, max(arrived_at) + interval 30 minute as "end", count(*) as n from s group by run_id, k""",
}
