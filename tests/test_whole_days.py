"""Day states give the percentiles of videos, runs and frames, within 0.5 % at any size of value."""

import datetime as dt

from mesoflow.plans import problems


def close(spark, folder):
    key = lambda r: (r["level"], r["video"], r["run_id"], r["frame"], r["p"])
    got = {key(r): r for r in problems.QUERIES["p3_by_day_levels"](spark, folder).collect()}
    want = {key(r): r for r in problems.p3_percentiles(spark, folder).collect()}
    assert set(got) == set(want) and {k[0] for k in got} == {"video", "run", "frame"}
    for k, r in want.items():
        assert (got[k]["n_rows"], got[k]["rank"]) == (r["n_rows"], r["rank"])
        a, b = got[k]["value"], r["value"]
        assert a == b or abs(a - b) <= 0.00501 * abs(b)


def test_days_add_up_to_all_levels(spark, sf_dir):
    close(spark, sf_dir)


def test_tiny_values_keep_their_error(spark, tmp_path):
    day = dt.datetime(2026, 1, 1)
    rows = [(i, "v", f"r{i % 2}", i % 3, 1e-7 * (i + 1), day + dt.timedelta(days=i % 4)) for i in range(60)]
    spark.createDataFrame(rows, "det_id long, video string, run_id string, frame int, mass double, arrived_at timestamp").write.parquet(f"{tmp_path}/detections.parquet")
    close(spark, str(tmp_path))
