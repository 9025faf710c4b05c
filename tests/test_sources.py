import json

import pytest

from mesoflow.sources import bundle as B

T = "frame int, x float, y float, mass float, ecc float, signal float, chunk int"


def rows(frames, chunk):
    return [(f, 1.0, 2.0, 3.0, 0.1, 5.0, chunk) for f in frames]


def test_merge_refuses_missing_tasks_and_names_them(spark, tmp_path):
    df = spark.createDataFrame(rows([0, 1], 0) + rows([2], 1) + rows([6, 6], 3), T)
    B.write_chunks(df, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="missing tasks: 2"):
        B.merge_chunks(spark, str(tmp_path / "c"), 4, 0, 7, str(tmp_path / "out"))


def test_merge_writes_a_bundle(spark, tmp_path):
    df = spark.createDataFrame(rows([0, 1], 0) + rows([2], 1) + rows([5, 5], 2), T)
    B.write_chunks(df, str(tmp_path / "c"))
    meta = B.merge_chunks(spark, str(tmp_path / "c"), 3, 0, 5, str(tmp_path / "out"))
    assert meta == {"schema_version": 1, "n_detections": 5, "frames_with_detections": 4, "frames_expected": 6, "frames_without_detections": [3, 4], "n_chunks_merged": 3}
    d, sidecar = B.read_bundle(spark, str(tmp_path / "out"))
    assert d.count() == 5 and sidecar["n_detections"] == 5


def test_bundle_without_a_column_is_refused(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "frame int, x float").write.parquet(str(tmp_path / "detections.parquet"))
    with pytest.raises(ValueError, match="y"):
        B.read_bundle(spark, str(tmp_path))


def test_empty_chunk_keeps_its_schema(spark, tmp_path):
    B.write_chunks(spark.createDataFrame([], T), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).columns[:3] == ["frame", "x", "y"]


def test_params_merge_over_defaults():
    p = B.Params.from_json(json.dumps({"params": {"px_um": 0.2, "dt": None, "unknown": 1}}))
    assert (p.px_um, p.dt, p.memory) == (0.2, 0.0, 3)
    assert B.Params.from_json('{"min_len": 7}').min_len == 7 and B.Params.from_json(None) == B.Params()
    assert B.Params.from_json(p.to_json()) == p
    assert (p.step_dt(20.0), p.step_dt(0.0), p.step_dt(None)) == (0.05, 1.0, 1.0)
    with pytest.raises(ValueError):
        B.Params.from_json('{"px_um": 0}')


def test_csv_export(spark, tmp_path):
    B.export_csv(spark.createDataFrame([(1, 2.5)], "frame int, x double"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True).first() == (1, 2.5)


def test_a_set_of_tables_is_exported_by_name(spark, tmp_path):
    t = {n: spark.createDataFrame([(n, 1.5)], f"{n} string, v double") for n in ("summary", "fluct", "sq", "spacings")}
    B.export_set(t, str(tmp_path / "lagb"))
    for n in t:
        assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "lagb" / n)).collect()] == [(n, "1.5")]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from mesoflow.session import ensure_checkpoint_dir

    made = []
    far = SimpleNamespace(sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None, setCheckpointDir=made.append), conf=SimpleNamespace(get=lambda k, d=None: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(far)
    far.conf.get = lambda k, d=None: "hdfs://shared/x"
    assert ensure_checkpoint_dir(far) == "hdfs://shared/x" and made == ["hdfs://shared/x"]
