"""Bundles: detections as Parquet beside a JSON sidecar, and CSV exports."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("frame", "x", "y")


@dataclass(frozen=True)
class Params:
    """Parameters of a run; defaults stand in for what a file leaves out."""

    diameter: int = 19
    separation: int = 19
    minmass: float = 3000.0
    percentile: float = 80.0
    max_step_um: float = 3.0
    memory: int = 3
    min_len: int = 15
    edge_px: int = 38
    appear_thresh: int = 5
    pair_dist_px: float = 48.0
    lagb_eps_px: float = 76.0
    lagb_min_n: int = 3
    lagb_aspect: float = 2.0
    lagb_angle_deg: float = 15.0
    px_um: float = 0.11
    dt: float = 0.0

    @classmethod
    def from_json(cls, text: str | None) -> Params:
        """From ``{"params": {...}}`` or the bare object; unknown keys and NULLs are passed over."""
        raw = json.loads(text) if text else {}
        raw = raw.get("params", raw)
        known = {f.name for f in fields(cls)}
        p = cls(**{k: v for k, v in raw.items() if k in known and v is not None})
        if p.px_um <= 0 or p.diameter < 3:
            raise ValueError("px_um must be positive and diameter at least 3")
        return p

    def to_json(self) -> str:
        return json.dumps({"params": asdict(self)})

    def step_dt(self, fps: float | None) -> float:
        return self.dt if self.dt > 0 else 1 / fps if fps and fps > 0 else 1.0


def read_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """Detections and sidecar of a bundle; a table without frame, x or y is refused by name."""
    d = spark.read.parquet(f"{folder}/detections.parquet")
    gone = [c for c in REQUIRED if c not in d.columns]
    if gone:
        raise ValueError(f"detections lack {', '.join(gone)}")
    meta = spark.read.option("multiLine", True).json(f"{folder}/job_meta.json").first()
    return d, meta.asDict(recursive=True) if meta else {}


def write_chunks(df: DataFrame, folder: str) -> None:
    """``folder/chunk=N/*.parquet``; an empty table keeps its schema in an empty file."""
    if df.isEmpty():
        df.drop("chunk").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/chunk=0")
    else:
        df.repartition("chunk").sortWithinPartitions("chunk", "frame").write.mode("errorifexists").partitionBy("chunk").parquet(folder)


def merge_chunks(spark: SparkSession, folder: str, n_chunks: int, frame_start: int, frame_end: int, out: str) -> dict:
    """Merge a run's chunks into a bundle, ordered by frame; refuse if tasks are missing, naming them.

    A task that found nothing must have left a (typed, empty) file, as its absence cannot be told from a failure otherwise.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    names = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    there = {int(n.split("=")[1]) for n in names if n.startswith("chunk=")}
    missing = sorted(set(range(n_chunks)) - there)
    if missing:
        raise ValueError(f"missing tasks: {', '.join(map(str, missing))}")
    d = spark.read.parquet(folder).drop("chunk")
    d.repartitionByRange("frame").sortWithinPartitions("frame").write.mode("errorifexists").parquet(f"{out}/detections.parquet")
    m = spark.read.parquet(f"{out}/detections.parquet").agg(F.count(F.lit(1)).alias("n_detections"), F.count_distinct("frame").alias("frames_with_detections")).first()
    frames = spark.range(frame_start, frame_end + 1).withColumnRenamed("id", "frame")
    gone = frames.join(d.select("frame").distinct(), "frame", "left_anti").orderBy("frame")
    expected = frame_end - frame_start + 1
    # one number per frame of one video: bounded by the video's length
    meta = {"schema_version": 1, "n_detections": m["n_detections"], "frames_with_detections": m["frames_with_detections"], "frames_expected": expected, "frames_without_detections": [r["frame"] for r in gone.collect()], "n_chunks_merged": len(there)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{out}/job_meta.json")
    return meta


def export_csv(df: DataFrame, folder: str) -> None:
    """A folder of CSV files with a header each; nothing is gathered into one task."""
    df.write.mode("errorifexists").option("header", True).csv(folder)


def export_set(tables: dict[str, DataFrame], folder: str) -> None:
    """A CSV folder per table, named for it (such as summary, fluct, sq and spacings of low-angle boundaries)."""
    for name, df in tables.items():
        export_csv(df, f"{folder}/{name}")
