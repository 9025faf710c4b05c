import numpy as np
import pytest
from pyspark.sql import functions as F

from mesoflow.operators.folds import link_nearest
from mesoflow.operators.series import hysteresis
from mesoflow.streaming import live as V

RNG = np.random.default_rng(9)


def through(spark, df, folder, parts, order, make, mode="append"):
    """A batch's rows as a file stream of ``parts`` micro-batches in the order of ``order``."""
    src = str(folder / "in")
    cut = np.array_split(np.array(sorted(r[order] for r in df.select(order).distinct().collect())), parts)
    for values in cut:
        df.where(F.col(order).between(values[0].item(), values[-1].item())).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    name = f"out_{folder.name}".replace("-", "_")
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_linker_equals_batch(spark, tmp_path):
    p, rows, k = RNG.uniform(0, 200, (8, 2)), [], 0
    for f in range(12):
        p = p + RNG.normal(0, 0.5, p.shape)
        for q in range(8):
            if (q + f) % 7:
                rows.append(("r", f, k, float(p[q, 0]), float(p[q, 1])))
                k += 1
    df = spark.createDataFrame(rows, "run_id string, frame int, det_id bigint, x double, y double")
    got = {r["det_id"]: r["particle"] for r in through(spark, df, tmp_path, 4, "frame", lambda s: V.link_stream(s, 6.0)).collect()}
    want = {r["det_id"]: r["particle"] for r in link_nearest(df.withColumn("reach", F.lit(6.0)), "det_id").collect()}
    assert got == want


def test_stream_flag_equals_batch(spark, tmp_path):
    rows = [("r", i, float(v)) for i, v in enumerate(RNG.uniform(0, 1, 40))]
    df = spark.createDataFrame(rows, "run_id string, frame int, value double")
    got = {(r["frame"], r["flag"]) for r in through(spark, df, tmp_path, 5, "frame", V.flag_stream).collect()}
    assert got == {(r["frame"], r["flag"]) for r in hysteresis(df, ["run_id"], "frame", "value").collect()}


def test_decimation_keeps_a_rate(spark, tmp_path):
    t = np.cumsum(RNG.uniform(0.05, 0.4, 60))
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(t)], "run_id string, frame int, t double")
    got = sorted(r["t"] for r in through(spark, df, tmp_path, 6, "frame", lambda s: V.decimate(s, 0.5)).collect())
    assert got == t[V.keep_at_rate(t, None, 0.5)[0]].tolist()
    assert all(b - a >= 0.5 for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("window", ["1 minute"])
def test_stream_windows_equal_batch(spark, sf_dir, tmp_path, window):
    df = spark.read.parquet(f"{sf_dir}/detections.parquet").where("arrived_at is not null")
    df = df.withColumn("part", F.pmod("det_id", F.lit(3)))
    out = through(spark, df, tmp_path, 3, "part", lambda s: V.live_stats(s, "365 days", window), mode="complete")
    rows = lambda x: {(r["run_id"], r["start"], r["n"]) for r in x.collect()}
    assert rows(out) == rows(V.live_stats(df, window=window))


def test_latest_only(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 2)], "run_id string, frame int")
    assert sorted(tuple(r) for r in V.latest_only(df).collect()) == [("a", 3), ("a", 3), ("b", 2)]


def test_recorded_structure_equals_batch(spark, tmp_path):
    """A live recording has one line per frame, with the batch's numbers."""
    from mesoflow.operators import structure as S

    rows = []
    for f in range(4):
        n = 60 + f
        rows += [("r", f, 1000 * f + i, float(x), float(y), 100.0 + 0.5 * f) for i, (x, y) in enumerate(RNG.uniform(0, 300, (n, 2)))]
    df = spark.createDataFrame(rows, "run_id string, frame int, det_id bigint, x double, y double, t double")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for f in range(4):
        df.where(f"frame = {f}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(src)
    V.record_structure(stream, out, str(tmp_path / "cp"), 50.0, 100.0).awaitTermination(120)
    got = {r["frame"]: r for r in spark.read.option("header", True).option("inferSchema", True).csv(out).collect()}
    p = df.drop("t")
    e = S.delaunay_edges(p, "det_id")
    s = S.structure_points(p, e, "det_id")
    pairs = S.pairs57(s, e, "det_id", 96.0)
    want = {r["frame"]: r for r in V.frame_observables(s, pairs, S.boundaries(pairs)[0]).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for f, r in got.items():
        assert r["t_s"] == 0.5 * f and r["n_particles"] == 60 + f and r["area_um2"] == 50.0
        assert all(r[c] == pytest.approx(want[f][c]) for c in ("n_57_pairs", "frac_defect", "mean_psi6", "n_lagb"))
        assert r["pairs_per_um2"] == pytest.approx(r["n_57_pairs"] / 50)
