"""Real small files as input of the compaction operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["x", "y", "mass", "ecc", "signal"]
RECORD = "frame INT, x FLOAT, y FLOAT, mass FLOAT, ecc FLOAT, signal FLOAT"


def read_small_files(spark: SparkSession, folder: str) -> DataFrame:
    """``run_id, file_id, written_at`` and the records of ``folder/run_id=.../*.parquet``, in file order.

    ``written_at`` is the file's modification time; ``file_id`` is a hash of
    its path, so it does not depend on listing order. Spark packs many files into a task; nothing is
    shuffled or nested. Empty files give no row, as they hold no key.
    """
    rows = spark.read.schema(RECORD + ", run_id STRING").option("recursiveFileLookup", "false").parquet(folder)
    return rows.select("run_id", F.xxhash64("_metadata.file_path").alias("file_id"), F.col("_metadata.file_modification_time").alias("written_at"), "frame", *FIELDS)
