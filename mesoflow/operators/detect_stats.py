"""Filters, histograms and quality measures of detections (row and aggregate operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesoflow.operators.quantiles import exact_medians, linear_percentiles


def edge_filter(df: DataFrame, edge: Column, w: Column, h: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Rows at least ``edge`` px inside the image, bounds included."""
    return df.where((F.col(x) >= edge) & (F.col(x) <= w - 1 - edge) & (F.col(y) >= edge) & (F.col(y) <= h - 1 - edge))


def frame_times(df: DataFrame, dt: Column, keys: list[str] | None = None) -> DataFrame:
    """``keys, frame, t`` of the frames present, t in seconds since the first one of the group."""
    keys = keys or ["run_id"]
    frames = df.select(*keys, "frame", dt.alias("_dt")).distinct()
    first = df.groupBy(*keys).agg(F.min("frame").alias("_f0"))
    return frames.join(first, keys).select(*keys, "frame", ((F.col("frame") - F.col("_f0")) * F.col("_dt")).alias("t"))


def mad_outliers(df: DataFrame, keys: list[str], value: str = "mass", mult: float = 2.5, least: int = 5) -> DataFrame:
    """Rows within ``mult * 1.4826`` median absolute deviations of their group's median; ``keys`` name an image.

    A group is left whole if it has fewer than ``least`` rows, a deviation of 0, or would lose every row.
    """
    w = Window.partitionBy(*keys)
    v = F.col(value).cast("double")
    # a group is one image, so one window holds it: one shuffle for both medians and the test
    t = df.withColumn("_med", F.median(v).over(w)).withColumn("_n", F.count(value).over(w)).withColumn("_off", F.abs(v - F.col("_med")))
    t = t.withColumn("_mad", F.median("_off").over(w)).withColumn("_in", F.col("_off") <= mult * 1.4826 * F.col("_mad"))
    t = t.withColumn("_some", F.max(F.col("_in").cast("int")).over(w))
    kept = t.where((F.col("_n") < least) | (F.col("_mad") <= 1e-9) | (F.col("_some") == 0) | F.col("_in"))
    return kept.drop("_med", "_n", "_off", "_mad", "_in", "_some")


def adaptive_min_mass(df: DataFrame, keys: list[str], share: float = 0.05, least: int = 8) -> DataFrame:
    """Rows of at least ``share`` of their group's median mass; groups under ``least`` rows or with a median of 0 or less are left whole."""
    w = Window.partitionBy(*keys)
    t = df.withColumn("_med", F.median(F.col("mass").cast("double")).over(w)).withColumn("_n", F.count("mass").over(w))
    return t.where((F.col("_n") < least) | (F.col("_med") <= 0) | (F.col("mass") >= share * F.col("_med"))).drop("_med", "_n")


def above_percentile(df: DataFrame, keys: list[str], p: float, value: str = "mass") -> DataFrame:
    """Rows strictly above their group's interpolated percentile."""
    cut = linear_percentiles(df, keys, value, {"_cut": p}).drop("n_rows")
    return df.join(cut, keys).where(F.col(value) > F.col("_cut")).drop("_cut")


def sweep_counts(df: DataFrame, keys: list[str], low: float | Column, high: float | Column, steps: int = 20, value: str = "mass") -> DataFrame:
    """``keys, step, threshold, n``: rows at or above each of ``steps`` evenly spaced thresholds, counted in one pass.

    Every row is put into the highest step that it reaches; the counts are then summed from above.
    Ends that are columns are the same for all rows of a key.
    """
    ends = isinstance(low, Column) or isinstance(high, Column)
    if ends:
        df = df.withColumn("_low", low if isinstance(low, Column) else F.lit(low)).withColumn("_high", high if isinstance(high, Column) else F.lit(high))
        low, high = F.col("_low"), F.col("_high")
    width = (high - low) / (steps - 1)
    at = lambda i: low + width * i if ends else F.lit(low + width * i)
    # the grid itself decides, not a division: counts at equal values must not depend on rounding
    grid = F.array(*[at(i) for i in range(steps)])
    reached = df.withColumn("step", F.size(F.filter(grid, lambda g: F.col(value) >= g)) - 1).where("step >= 0")
    n = reached.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("n"))
    every = df.select(*keys, *["_low", "_high"] * ends).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    down = Window.partitionBy(*keys).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    full = every.join(n, [*keys, "step"], "left").fillna(0, ["n"])
    return full.select(*keys, "step", ((low if ends else F.lit(low)) + (width if ends else F.lit(width)) * F.col("step")).alias("threshold"), F.sum("n").over(down).alias("n"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """``keys, bin, lo, hi, n``: equal-width bins between the group's extremes, the last one closed; empty bins have no row.

    A group of one distinct value is centred in a range of width 1.
    """
    v = F.col(value)
    ends = df.where(v.isNotNull()).groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    ends = ends.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_a"), F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_b"))
    at = F.least(F.floor((v - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)).cast("int")
    counted = df.where(v.isNotNull()).join(ends, keys).groupBy(*keys, at.alias("bin"), "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("_b") - F.col("_a")) / bins
    return counted.select(*keys, "bin", (F.col("_a") + F.col("bin") * step).alias("lo"), (F.col("_a") + (F.col("bin") + 1) * step).alias("hi"), "n")


def otsu(hist: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    """``keys, threshold``: the bin centre of greatest between-class variance, the first of equals.

    ``least``: rows that both classes must exceed. Groups without such a cut have no row.
    """
    mid = (F.col("lo") + F.col("hi")) / 2
    line = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = hist.withColumn("_mid", mid).withColumn("_w", F.sum("n").over(line)).withColumn("_s", F.sum(F.col("n") * F.col("_mid")).over(line))
    h = h.withColumn("_wall", F.sum("n").over(whole)).withColumn("_sall", F.sum(F.col("n") * F.col("_mid")).over(whole))
    h = h.where((F.col("_w") > least) & (F.col("_wall") - F.col("_w") > least))
    lower, upper = F.col("_s") / F.col("_w"), (F.col("_sall") - F.col("_s")) / (F.col("_wall") - F.col("_w"))
    between = F.round((F.col("_w") / F.col("_wall")) * (1 - F.col("_w") / F.col("_wall")) * (lower - upper) * (lower - upper), 9)
    best = h.groupBy(*keys).agg(F.max(F.struct(between.alias("v"), (-F.col("bin")).alias("b"), F.col("_mid").alias("m"))).alias("_best"))
    return best.select(*keys, F.col("_best.m").alias("threshold"))


def auto_min_mass(df: DataFrame, keys: list[str], bins: int = 200) -> DataFrame:
    """``keys, minmass``: the noise boundary by Otsu's rule on log(1 + mass) between its percentiles 2 and 98; groups under 10 rows have no row."""
    logs = df.select(*keys, F.log1p("mass").alias("_v"))
    ends = linear_percentiles(logs, keys, "_v", {"_a": 0.02, "_b": 0.98}).where("n_rows >= 10 and _b > _a")
    inside = logs.join(ends, keys).where("_v >= _a and _v <= _b")
    at = F.least(F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)).cast("int")
    step = (F.col("_b") - F.col("_a")) / bins
    h = inside.groupBy(*keys, at.alias("bin"), "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    h = h.select(*keys, "bin", (F.col("_a") + F.col("bin") * step).alias("lo"), (F.col("_a") + (F.col("bin") + 1) * step).alias("hi"), "n")
    return otsu(h, keys, least=2).select(*keys, F.floor(F.expm1("threshold")).cast("bigint").alias("minmass"))


def pixel_locking(df: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """``keys, ratio, is_locked``: variance of the positions' fractional parts against a uniform one (1/12); groups under ``least`` rows count as unlocked with ratio 1."""
    fx, fy = (F.pmod(F.col(c), F.lit(1.0)) for c in ("x", "y"))
    var = lambda f: F.avg(f * f) - F.avg(f) * F.avg(f)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), ((var(fx) + var(fy)) / (2 / 12)).alias("_r"))
    ratio = F.when(F.col("_n") < least, F.lit(1.0)).otherwise(F.col("_r"))
    return g.select(*keys, F.round(ratio, 3).alias("ratio"), (ratio < 0.5).alias("is_locked"))


def count_dips(df: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """``keys, frame, n``: frames with fewer detections than ``share`` of the group's median frame."""
    n = df.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("n"))
    med = exact_medians(n, keys, "n").drop("n_rows")
    return n.join(med, keys).where(F.col("n") < share * F.col("median")).drop("median")


def missing_frames(df: DataFrame, expected: DataFrame, key: str = "run_id") -> DataFrame:
    """``key, frame`` of the frames in ``expected`` (key, frame_start, frame_end) that have no row."""
    every = expected.where("frame_end >= frame_start").select(key, F.explode(F.sequence("frame_start", "frame_end")).alias("frame"))
    return every.join(df.select(key, "frame").distinct(), [key, "frame"], "left_anti")


def chunk_ranges(expected: DataFrame, key: str = "run_id") -> DataFrame:
    """``key, task, first, last``: the frame range of each task of ``chunk_size`` frames; frames past the end belong to none."""
    n = F.floor((F.col("frame_end") - F.col("frame_start")) / F.col("chunk_size")).cast("int")
    t = expected.where("frame_end >= frame_start and chunk_size > 0").withColumn("task", F.explode(F.sequence(F.lit(0), n)))
    first = F.col("frame_start") + F.col("task") * F.col("chunk_size")
    return t.select(key, "task", first.alias("first"), F.least(first + F.col("chunk_size") - 1, F.col("frame_end")).alias("last"))


def bundle_summary(df: DataFrame, expected: DataFrame, key: str = "run_id") -> DataFrame:
    """``key, n_detections, frames_with_detections, frames_expected, frames_without_detections`` per run."""
    there = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_detections"), F.count_distinct("frame").alias("frames_with_detections"))
    out = expected.select(key, (F.col("frame_end") - F.col("frame_start") + 1).alias("frames_expected")).join(there, key, "left").fillna(0, ["n_detections", "frames_with_detections"])
    gone = missing_frames(df, expected, key).groupBy(key).agg(F.count(F.lit(1)).alias("frames_without_detections"))
    return out.join(gone, key, "left").fillna(0, ["frames_without_detections"])


def implied_ratio_verdict(ratio: Column) -> tuple[Column, Column]:
    """Height over diameter that a mixed-to-same bond length ratio below 1 implies, and a verdict on how much shorter mixed bonds are: 1.5 to 25 % is buckling."""
    height = F.when((ratio > 0) & (ratio < 1), 1 + F.sqrt(F.greatest(F.lit(0.0), 1 - ratio * ratio)))
    percent = (1 - ratio) * 100
    return height, F.when(percent >= 25, "second layer").when(percent >= 1.5, "buckling").otherwise("no asymmetry")


def odd(n: Column) -> Column:
    """The odd whole number at or next above the rounded value."""
    return F.round(n).cast("int").bitwiseOR(F.lit(1))
