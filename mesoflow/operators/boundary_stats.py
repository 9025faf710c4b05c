"""Fluctuation statistics of tracked low-angle boundaries, from a table of their members.

A boundary's cores (dislocations) are placed along and across one axis, that of
all its members of all frames, and members closer than a core's width are one core.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesoflow.operators.groupmap import map_groups
from mesoflow.operators.quantiles import exact_medians
from mesoflow.operators.series import collapse_cores
from mesoflow.operators.structure import along_line, band_sides, line_fit

GB = ["run_id", "gb_id"]
SNAP = [*GB, "frame"]


def lasting(members: DataFrame, least_frames: int | Column = 10) -> DataFrame:
    """Members of boundaries seen in at least ``least_frames`` frames (a column: by run), half of them low-angle."""
    least = least_frames if isinstance(least_frames, Column) else F.lit(least_frames)
    snap = members.groupBy(*SNAP).agg((F.avg(F.col("low").cast("double")) >= 0.5).cast("int").alias("_low"), F.max(least).alias("_least"))
    good = snap.groupBy(*GB).agg(F.count(F.lit(1)).alias("_n"), F.avg("_low").alias("_share"), F.max("_least").alias("_least")).where((F.col("_n") >= F.col("_least")) & (F.col("_share") >= 0.5))
    return members.join(good.select(*GB), GB, "left_semi")


def pooled_axes(members: DataFrame) -> DataFrame:
    """``run_id, gb_id, cx, cy, ux, uy``: centre and axis of all members of all frames."""
    return line_fit(members, GB).select(*GB, "cx", "cy", "ux", "uy")


def pooled_cores(members: DataFrame, axes: DataFrame, scale: DataFrame) -> DataFrame:
    """``run_id, gb_id, frame, core_no, s, h, n`` in um: the cores of each frame along and across the boundary's pooled axis.

    ``scale``: ``run_id, spacing`` (lattice constant in px) and ``px_um``. Members at most two lattice constants
    from the one before along the axis are one core, at their mean; without a lattice constant each member is a core.
    """
    placed = along_line(members.select(*SNAP, "x", "y"), axes, GB).join(scale.select("run_id", "spacing", "px_um"), "run_id")
    um = placed.select(*SNAP, (F.col("s") * F.col("px_um")).alias("s"), (F.col("h") * F.col("px_um")).alias("h"), F.coalesce(2 * F.col("spacing") * F.col("px_um"), F.lit(-1.0)).alias("_core"))
    return collapse_cores(um, SNAP, "s", "h", F.col("_core"))


def spacings(cores: DataFrame) -> DataFrame:
    """``run_id, gb_id, frame, d``: distances between neighbouring cores along the line."""
    line = Window.partitionBy(*SNAP).orderBy("s")
    return cores.select(*SNAP, (F.col("s") - F.lag("s").over(line)).alias("d")).where("d is not null")


def boundary_summary(cores: DataFrame, members: DataFrame, scale: DataFrame) -> DataFrame:
    """``run_id, gb_id, n_frames, n_dislocations, D_um, L_um, b_um, theta_psi6_deg, theta_frank_deg, G1_um_inv, dq_res_um_inv``.

    D is the median spacing of all frames, L the longest extent, b the lattice constant. theta_psi6 is the mean over frames of the
    boundary's own misorientation (``mis`` of the members), theta_frank the small-angle form b / D of
    Frank's formula in degrees. Boundaries without a spacing (all members one core) have NULL for what needs D.
    """
    d = exact_medians(spacings(cores), GB, "d").where("median > 0").select(*GB, F.col("median").alias("D_um"))
    snap = cores.groupBy(*SNAP).agg((F.max("s") - F.min("s")).alias("_L"), F.count(F.lit(1)).alias("_n"))
    g = snap.groupBy(*GB).agg(F.count(F.lit(1)).alias("n_frames"), F.avg("_n").alias("n_dislocations"), F.max("_L").alias("L_um"))
    theta = members.groupBy(*SNAP).agg(F.avg("mis").alias("_m")).groupBy(*GB).agg(F.avg("_m").alias("theta_psi6_deg"))
    j = g.join(d, GB, "left").join(theta, GB, "left").join(scale.select("run_id", (F.col("spacing") * F.col("px_um")).alias("b_um")), "run_id", "left")
    there = F.col("D_um").isNotNull()
    j = j.withColumn("L_um", F.when(there, F.col("L_um"))).withColumn("theta_psi6_deg", F.when(there, F.col("theta_psi6_deg")))
    j = j.withColumn("theta_frank_deg", F.degrees(F.col("b_um") / F.col("D_um"))).withColumn("G1_um_inv", 2 * math.pi / F.col("D_um"))
    return j.withColumn("dq_res_um_inv", F.when(F.col("L_um") > 0, 2 * math.pi / F.col("L_um")))


def _whole(summary: DataFrame) -> DataFrame:
    return summary.where("D_um > 0 and L_um > 0").select(*GB, "D_um", "L_um")


def fluctuations(cores: DataFrame, summary: DataFrame, least: int = 3) -> DataFrame:
    """``run_id, gb_id, bin, x_um, n, B_perp_um2, C_par_um2``: mean squared differences across and along the line, by distance.

    Bins: max(4, floor(2 L / D)) of equal width up to the longest extent, by their middle; NULL where no pair falls. Along the line the
    expected distance (rank difference times D) is taken off. Frames under ``least`` cores are passed over.
    The pairs of one boundary in one image are formed and summed in a task.
    """

    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        s, h, d, length = g["s"], g["h"], float(g["D_um"][0]), float(g["L_um"][0])
        if len(s) < least:
            return None
        bins = max(4, int(2 * length / d))
        n, across, along = np.zeros(bins, np.int64), np.zeros(bins), np.zeros(bins)
        for k in range(1, len(s)):
            ds = s[k:] - s[:-k]
            at = np.clip((ds / (length + 1e-9) * bins).astype(np.int64), 0, bins - 1)
            n += np.bincount(at, minlength=bins)
            across += np.bincount(at, (h[k:] - h[:-k]) ** 2, bins)
            along += np.bincount(at, (ds - k * d) ** 2, bins)
        at = np.flatnonzero(n)
        return {"bin": at, "_n": n[at], "_b": across[at], "_c": along[at]}

    per = map_groups(cores.join(_whole(summary), GB).select(*SNAP, "s", "h", "D_um", "L_um"), SNAP, ["s", "h"], one, "bin int, _n bigint, _b double, _c double")
    g = per.groupBy(*GB, "bin").agg(F.sum("_n").alias("n"), F.sum("_b").alias("_b"), F.sum("_c").alias("_c"))
    many = F.greatest(F.lit(4), F.floor(2 * F.col("L_um") / F.col("D_um"))).cast("int")
    every = _whole(summary).withColumn("_bins", many).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)))
    j = every.join(g, [*GB, "bin"], "left").fillna(0, ["n"])
    return j.select(*GB, "bin", ((F.col("bin") + 0.5) * (F.col("L_um") + 1e-9) / F.col("_bins")).alias("x_um"), "n", (F.col("_b") / F.col("n")).alias("B_perp_um2"), (F.col("_c") / F.col("n")).alias("C_par_um2"))


def structure_factor(cores: DataFrame, summary: DataFrame, points: int = 1600, m_max: int = 3, least: int = 4) -> DataFrame:
    """``run_id, gb_id, k, q_um_inv, S_q``: mean over frames of |sum exp(i q s)|^2 / N on ``points`` values of q from 0.05 G to (m_max + 1/2) G, G = 2 pi / D."""

    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        s = g["s"]
        if len(s) < least:
            return None
        unit = 2 * np.pi / float(g["D_um"][0])
        q = np.linspace(0.05 * unit, (m_max + 0.5) * unit, points)
        c, i = np.zeros(points), np.zeros(points)
        for v in s:
            c += np.cos(q * v)
            i += np.sin(q * v)
        return {"k": np.arange(points), "q_um_inv": q, "_p": (c * c + i * i) / len(s)}

    per = map_groups(cores.join(_whole(summary), GB).select(*SNAP, "s", "D_um"), SNAP, ["s"], one, "k int, q_um_inv double, _p double")
    return per.groupBy(*GB, "k").agg(F.max("q_um_inv").alias("q_um_inv"), F.avg("_p").alias("S_q"))


def peak_exponents(sq: DataFrame, summary: DataFrame, m_max: int = 3, least: int = 8) -> DataFrame:
    """``run_id, gb_id, m, eta``: 1 plus the slope of ln S against ln |q - m G| between 2 pi / L and 0.35 G; peaks under ``least`` points have no row."""
    j = sq.join(_whole(summary).select(*GB, (2 * math.pi / F.col("D_um")).alias("_G"), (2 * math.pi / F.col("L_um")).alias("_res")), GB)
    j = j.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(m_max)))).withColumn("_d", F.abs(F.col("q_um_inv") - F.col("m") * F.col("_G")))
    j = j.where((F.col("_d") > F.col("_res")) & (F.col("_d") < 0.35 * F.col("_G")) & (F.col("S_q") > 0))
    g = j.groupBy(*GB, "m").agg(F.regr_slope(F.log("S_q"), F.log("_d")).alias("_k"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return g.select(*GB, "m", (1 + F.col("_k")).alias("eta"))


def normed_spacings(cores: DataFrame, summary: DataFrame) -> DataFrame:
    """``run_id, gb_id, frame, spacing_over_D``."""
    return spacings(cores).join(_whole(summary), GB).select(*SNAP, (F.col("d") / F.col("D_um")).alias("spacing_over_D"))


def pooled_misorientation(members: DataFrame, axes: DataFrame, summary: DataFrame, points: DataFrame, scale: DataFrame, least: int = 5) -> DataFrame:
    """``run_id, gb_id, theta_grains_deg``: angle between the lattices on both sides of a tracked boundary, over its frames.

    Bands beside the pooled axis, as of ``structure.band_misorientation``, over each frame's extent; each side's
    mean unit vector of a frame counts if ``least`` points with |psi6| above 0.3 are in it, and the frames' means are averaged.
    """
    placed = along_line(members.select(*SNAP, "x", "y"), axes, GB)
    x = placed.groupBy(*SNAP).agg(F.min("s").alias("_s0"), F.max("s").alias("_s1")).join(axes, GB)
    x = x.join(summary.where("D_um > 0").select(*GB, "D_um"), GB).join(scale.select("run_id", F.col("spacing").alias("_b"), "px_um"), "run_id")
    x = x.withColumn("_in", 1.5 * F.col("_b")).withColumn("_out", F.col("_in") + F.greatest(2 * F.col("_b"), F.col("D_um") / F.col("px_um") / 2))
    sides = band_sides(x, points, SNAP).where(F.col("n") >= least)
    g = sides.groupBy(*GB).pivot("side", ["a", "b"]).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    turn = (F.atan2("a_im", "a_re") - F.atan2("b_im", "b_re")) / 6
    g = g.where(F.col("a_re").isNotNull() & F.col("b_re").isNotNull())
    return g.select(*GB, F.abs(F.pmod(F.degrees(turn) + 30, F.lit(60.0)) - 30).alias("theta_grains_deg"))
