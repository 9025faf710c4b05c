"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, as the optimizer estimates them from the files, up to which a dimension table may be broadcast.
BROADCAST_BYTES = 32 << 20


def build_session(app: str = "mesoflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return builder.config(map=base | conf).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Read from ``spark.checkpoint.dir``; where that is unset a local session
    (tests, a laptop) gets a temporary folder, and a cluster an error, as its machines share none.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(where)
    return sc.getCheckpointDir() or where


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the optimizer's size of the table (its files' bytes, no job) is at most ``max_bytes``; else leave the choice to Spark."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df


def first_arrival(df: DataFrame, key: str, arrived: str, cols: list[str]) -> DataFrame:
    """One row per ``key``: its earliest delivery (ties: the smallest values, so the result is fixed).

    Partial aggregation folds repeated deliveries before the shuffle, so one
    key that holds a third of all rows costs one row per map task. Rows whose
    key is NULL are dropped: they name no record.
    """
    one = F.min(F.struct(F.col(arrived), *[F.col(c) for c in cols if c not in (key, arrived)])).alias("_first")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(one).select(key, "_first.*")
