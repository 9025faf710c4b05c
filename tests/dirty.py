"""Copies of the tables with extra columns, rows of NULLs, and without rows."""

from pyspark.sql import functions as F

CLASHES = ["_first", "_run", "_dt", "_from", "_off", "slot", "dt", "value", "_block", "_tag", "_tile", "_code", "level", "day", "roi", "part", "last", "edge", "n", "rec", "field", "kind", "_b", "_size", "tokens", "copy", "position", "shape"]


def write_dirty(spark, src, dst, names):
    for name in names:
        df = spark.read.parquet(f"{src}/{name}.parquet")
        nulls = df.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        for c in CLASHES:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
                nulls = nulls.withColumn(c, F.lit("clash"))
        df.unionByName(nulls).write.parquet(f"{dst}/{name}.parquet")


def write_empty(spark, src, dst, names):
    for name in names:
        spark.read.parquet(f"{src}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{dst}/{name}.parquet")


def rows(df):
    return sorted(map(repr, df.collect()))
