"""Pair correlations g(r) and g6(r) by distance histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesoflow.operators.proximity import near_pairs


def pair_counts(points: DataFrame, rec: str, rmax: float, dr: float, interior: bool = False, weight: Column | None = None) -> DataFrame:
    """``run_id, bin, n`` (and ``w``): pairs of a frame by distance below ``rmax``, in bins of width rmax / max(1, floor(rmax / dr)).

    ``interior`` keeps pairs of which both points are further than ``rmax`` from the
    frame's bounding box. ``weight`` is an expression on a and b columns of ``psi_re, psi_im`` (as a_re, a_im, b_re, b_im).
    """
    bins = max(1, int(rmax / dr))
    p = near_pairs(points, ["run_id", "frame"], rec, rmax).where(F.col("dist2") < rmax * rmax)
    if interior or weight is not None:
        cols = [c for c in ("x", "y", "psi_re", "psi_im") if c in points.columns]
        side = lambda s: points.select(F.col(rec).alias(s), *[F.col(c).alias(f"{s}_{c.removeprefix('psi_')}") for c in cols])
        p = p.join(side("a"), "a").join(side("b"), "b")
    if interior:
        box = points.groupBy("run_id", "frame").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
        p = p.join(box, ["run_id", "frame"])
        for s in ("a", "b"):
            p = p.where((F.col(f"{s}_x") > F.col("_x0") + rmax) & (F.col(f"{s}_x") < F.col("_x1") - rmax) & (F.col(f"{s}_y") > F.col("_y0") + rmax) & (F.col(f"{s}_y") < F.col("_y1") - rmax))
    at = F.least(F.floor(F.sqrt("dist2") / (rmax / bins)), F.lit(bins - 1)).cast("int")
    sums = [F.count(F.lit(1)).alias("n")] + ([F.sum(weight).alias("w")] if weight is not None else [])
    return p.groupBy("run_id", at.alias("bin")).agg(*sums)


def pair_correlation(points: DataFrame, rec: str, rmax: float, dr: float, interior: bool = False) -> DataFrame:
    """``run_id, bin, r, n, g``: totals over a run's frames, normalised once.

    Area is the bounding box of a frame's points; frames under two points add to
    the mean number but have no area. The mean number counts all points, with or without ``interior``.
    """
    bins = max(1, int(rmax / dr))
    width = rmax / bins
    frame = points.groupBy("run_id", "frame").agg(F.count(F.lit(1)).alias("_n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("_a"))
    run = frame.groupBy("run_id").agg(F.count(F.lit(1)).alias("_f"), F.avg("_n").alias("_N"), F.avg(F.when(F.col("_n") > 1, F.col("_a")).otherwise(0.0)).alias("_A"))
    n = pair_counts(points, rec, rmax, dr, interior)
    every = run.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    r = (F.col("bin") + 0.5) * width
    rho = F.col("_N") / F.col("_A")
    g = 2 * F.col("n") / (F.col("_f") * F.col("_N") * rho * (2 * math.pi * width) * r)
    out = every.join(n, ["run_id", "bin"], "left").fillna(0, ["n"])
    return out.select("run_id", "bin", r.alias("r"), "n", F.when(F.col("_A") > 0, g).alias("g"))


def default_range(diameter_um: Column) -> tuple[Column, Column]:
    """rmax and dr for a particle diameter: ten diameters within 0.5 to 100, a tenth of one within 0.01 to 5."""
    clip = lambda v, lo, hi: F.least(F.greatest(v, F.lit(lo)), F.lit(hi))
    return clip(10 * diameter_um, 0.5, 100.0), clip(diameter_um / 10, 0.01, 5.0)


def structure_functions(points: DataFrame, rec: str, ranges: DataFrame) -> DataFrame:
    """``run_id, bin, r_um, n_pairs, g_r, g6_r, g6_over_g_r``: both pair correlations of each run, totals over its frames normalised once.

    ``points``: ``run_id, frame, rec, x, y, psi_re, psi_im`` in px; ``ranges``: ``run_id, px_um, rmax, dr`` in um, the run's own
    (runs without are left out). Bins have the width rmax / max(1, floor(rmax / dr)). Area is a frame's bounding box. g6_r is
    NULL in empty bins, the ratio where g_r is 0 too.
    """
    own = ranges.where("px_um > 0 and rmax > 0 and dr > 0").withColumn("_bins", F.greatest(F.lit(1), F.floor(F.col("rmax") / F.col("dr"))).cast("int"))
    own = own.withColumn("_w", F.col("rmax") / F.col("_bins"))
    p = points.join(own.select("run_id", "px_um", (F.col("rmax") / F.col("px_um")).alias("_r")), "run_id")
    pairs = near_pairs(p, ["run_id", "frame"], rec, None)
    side = lambda s: points.select(F.col(rec).alias(s), F.col("psi_re").alias(f"{s}_re"), F.col("psi_im").alias(f"{s}_im"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").join(own.select("run_id", "px_um", "rmax", "_w", "_bins"), "run_id")
    d = F.sqrt("dist2") * F.col("px_um")
    at = F.least(F.floor(d / F.col("_w")), F.col("_bins") - 1).cast("int")
    g = pairs.where(d < F.col("rmax")).groupBy("run_id", at.alias("bin")).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("a_re") * F.col("b_re") + F.col("a_im") * F.col("b_im")).alias("_g6"))
    frame = p.groupBy("run_id", "frame", "px_um").agg(F.count(F.lit(1)).alias("_n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("_a"), F.sum(F.col("psi_re") * F.col("psi_re") + F.col("psi_im") * F.col("psi_im")).alias("_psi"))
    run = frame.groupBy("run_id").agg(F.count(F.lit(1)).alias("_f"), F.avg("_n").alias("_N"), F.avg(F.when(F.col("_n") > 1, F.col("_a") * F.col("px_um") * F.col("px_um")).otherwise(0.0)).alias("_A"), (F.sum("_psi") / F.sum("_n")).alias("_m"))
    every = run.join(own.select("run_id", "_w", "_bins"), "run_id").withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)))
    j = every.join(g, ["run_id", "bin"], "left").fillna(0, ["n_pairs"])
    r = (F.col("bin") + 0.5) * F.col("_w")
    g_r = F.when(F.col("_A") > 0, 2 * F.col("n_pairs") / (F.col("_f") * F.col("_N") * (F.col("_N") / F.col("_A")) * (2 * math.pi * F.col("_w")) * r))
    g6 = F.when(F.col("n_pairs") > 0, F.col("_g6") / F.col("n_pairs") / F.greatest("_m", F.lit(1e-12)))
    j = j.select("run_id", "bin", r.alias("r_um"), "n_pairs", g_r.alias("g_r"), g6.alias("g6_r"))
    return j.withColumn("g6_over_g_r", F.when(F.col("g_r") > 0, F.col("g6_r") / F.col("g_r")))
