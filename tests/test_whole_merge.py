"""What is derived from a merge plan is the same however the shuffle is cut."""

import datetime as dt

from mesoflow.operators.compaction import kept, merge_plan, superseded

SHUFFLE, AQE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"


def test_ranges_are_the_same_for_all_reads(spark):
    at = dt.datetime(2026, 1, 1)
    files = spark.createDataFrame([("r", i, at + dt.timedelta(minutes=i), [(f % 9,) for f in range(i, i + 6)]) for i in range(40)], "run_id string, file_id long, written_at timestamp, recs array<struct<frame:int>>")
    was = {c: spark.conf.get(c) for c in (SHUFFLE, AQE)}
    read = lambda df: sorted(map(tuple, df.collect()))
    try:
        spark.conf.set(AQE, "false")
        seen = []
        for n in ("2", "7"):
            spark.conf.set(SHUFFLE, n)
            plan = merge_plan(files)
            seen.append((read(superseded(plan)), read(kept(plan))))
        assert seen[0] == seen[1]
        n = plan.count()
        assert superseded(plan).count() + kept(plan).count() == n and kept(plan).count() == 9
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
