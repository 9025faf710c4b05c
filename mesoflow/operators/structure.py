"""Crystal structure per image: neighbours, hexatic order, dislocation pairs, grains, boundaries.

Triangulation runs per image (``map_groups``); everything after it is joins,
aggregates and windows over the edge and point tables.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesoflow.operators.geometry import components, delaunay
from mesoflow.operators.groupmap import map_groups
from mesoflow.operators.proximity import near_pairs
from mesoflow.operators.quantiles import bounded_medians
from mesoflow.session import ensure_checkpoint_dir

FRAME = ["run_id", "frame"]


def delaunay_edges(points: DataFrame, rec: str, max_len: float | None = None, least: int = 4) -> DataFrame:
    """``run_id, frame, i, j, len`` (i, j are ``rec`` values, i < j) of the triangulation of each frame's points.

    Frames under ``least`` points, and frames whose points lie on a line, have no edges. Rows without a
    finite place must be gone. An image's points are bounded by its size.
    """

    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        if len(g["x"]) < least:
            return None
        e = delaunay(g["x"], g["y"])
        i, j = g[rec][e[:, 0]], g[rec][e[:, 1]]
        length = np.hypot(g["x"][e[:, 0]] - g["x"][e[:, 1]], g["y"][e[:, 0]] - g["y"][e[:, 1]])
        return {"i": np.minimum(i, j), "j": np.maximum(i, j), "len": length}

    e = map_groups(points.select(*FRAME, rec, "x", "y"), FRAME, [rec], one, "i bigint, j bigint, len double")
    return e if max_len is None else e.where(F.col("len") <= max_len)


def structure_points(points: DataFrame, edges: DataFrame, rec: str) -> DataFrame:
    """``points`` with ``coord, psi_re, psi_im``: number of neighbours and the mean of exp(6 i theta) over them; all 0 without neighbours."""
    end = lambda s: points.select(F.col(rec).alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    e = edges.join(end("i"), "i").join(end("j"), "j")
    angle = F.atan2(F.col("jy") - F.col("iy"), F.col("jx") - F.col("ix")) * 6
    # the opposite direction differs by pi, and 6 pi is a full turn: one angle serves both ends
    both = e.select(F.explode(F.array("i", "j")).alias(rec), F.cos(angle).alias("_c"), F.sin(angle).alias("_s"))
    g = both.groupBy(rec).agg(F.count(F.lit(1)).cast("int").alias("coord"), F.avg("_c").alias("psi_re"), F.avg("_s").alias("psi_im"))
    return points.join(g, rec, "left").fillna(0, ["coord"]).fillna(0.0, ["psi_re", "psi_im"])


def misorientation(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> Column:
    """Angle between two lattices in degrees, NULL if either order parameter is below 0.1."""
    weak = (F.hypot(a_re, a_im) < 0.1) | (F.hypot(b_re, b_im) < 0.1)
    return F.when(~weak, F.degrees(F.abs(F.atan2(a_im * b_re - a_re * b_im, a_re * b_re + a_im * b_im))) / 6)


def pairs57(points: DataFrame, edges: DataFrame, rec: str, max_dist: float | None = None) -> DataFrame:
    """``run_id, frame, i5, i7, x, y, misorientation_deg``: edges between a 5- and a 7-coordinated point, placed at their middle."""
    side = lambda s: points.where(F.col("coord").isin(5, 7)).select(F.col(rec).alias(s), *[F.col(c).alias(s + c) for c in ("coord", "x", "y", "psi_re", "psi_im")])
    e = (edges if max_dist is None else edges.where(F.col("len") <= max_dist)).join(side("i"), "i").join(side("j"), "j").where("icoord <> jcoord")
    five = F.col("icoord") == 5
    mis = misorientation(*[F.col(c) for c in ("ipsi_re", "ipsi_im", "jpsi_re", "jpsi_im")])
    return e.select(*FRAME, F.when(five, F.col("i")).otherwise(F.col("j")).alias("i5"), F.when(five, F.col("j")).otherwise(F.col("i")).alias("i7"), ((F.col("ix") + F.col("jx")) / 2).alias("x"), ((F.col("iy") + F.col("jy")) / 2).alias("y"), mis.alias("misorientation_deg"))


def defect_series(points: DataFrame) -> DataFrame:
    """``run_id, frame, n, frac_defect, frac_5fold, frac_7fold, mean_psi6`` per frame."""
    share = lambda c: F.avg(c.cast("double"))
    return points.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), share(F.col("coord") != 6).alias("frac_defect"), share(F.col("coord") == 5).alias("frac_5fold"), share(F.col("coord") == 7).alias("frac_7fold"), F.avg(F.hypot("psi_re", "psi_im")).alias("mean_psi6"))


def grains(points: DataFrame, edges: DataFrame, rec: str, least_psi: float = 0.6, angle_tol_rad: float = math.radians(15) / 6) -> DataFrame:
    """``run_id, frame, rec, grain``: ordered points joined over edges along which the lattice angle turns by at most ``angle_tol_rad``.

    A grain is named by its smallest point. Components are found per image.
    """
    ordered = points.where(F.hypot("psi_re", "psi_im") > least_psi).select(*FRAME, F.col(rec).alias("i"), (F.atan2("psi_im", "psi_re") / 6).alias("_t"))
    e = edges.join(ordered.select("i", F.col("_t").alias("_a")), "i").join(ordered.select(F.col("i").alias("j"), F.col("_t").alias("_b")), "j")
    turn = F.abs(F.pmod(F.col("_a") - F.col("_b") + math.pi / 6, F.lit(math.pi / 3)) - math.pi / 6)
    links = e.where(turn <= angle_tol_rad).select(*FRAME, "i", "j").unionByName(ordered.select(*FRAME, "i", F.col("i").alias("j")))
    return link_components(links, FRAME).withColumnsRenamed({"node": rec, "component": "grain"})


def link_components(links: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, component``: connected components of the links (i, j) of each group (one image), named by their smallest node."""

    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        nodes, at = np.unique(np.concatenate([g["i"], g["j"]]), return_inverse=True)
        n = len(g["i"])
        return {"node": nodes, "component": nodes[components(len(nodes), at[:n], at[n:])]}

    return map_groups(links.select(*keys, "i", "j"), keys, ["i", "j"], one, "node bigint, component bigint")


def dbscan(points: DataFrame, rec: str, eps: float, least: int) -> DataFrame:
    """``run_id, frame, rec, cluster``: density clusters, -1 for noise.

    A point with at least ``least`` points within ``eps``, itself counted, is a core
    point; cores within ``eps`` of each other are one cluster, named by its smallest core;
    another point joins the cluster of least name among its core neighbours.
    The pairs and counts are read several times and so are checkpointed.
    """
    ensure_checkpoint_dir(points.sparkSession)
    p = near_pairs(points, FRAME, rec, eps).select(*FRAME, "a", "b").checkpoint()
    both = p.select(*FRAME, F.col("a").alias("i"), F.col("b").alias("j")).unionByName(p.select(*FRAME, F.col("b").alias("i"), F.col("a").alias("j")))
    n = both.groupBy(*FRAME, "i").agg((F.count(F.lit(1)) + 1).alias("_n"))
    all_ = points.select(*FRAME, F.col(rec).alias("i")).join(n, [*FRAME, "i"], "left").fillna(1, ["_n"]).checkpoint()
    ids = all_.where(F.col("_n") >= least).select(*FRAME, "i")
    links = both.where("i < j").join(ids, [*FRAME, "i"], "left_semi").join(ids.withColumnRenamed("i", "j"), [*FRAME, "j"], "left_semi").select(*FRAME, "i", "j")
    named = link_components(links.unionByName(ids.withColumn("j", F.col("i"))), FRAME).select(*FRAME, F.col("node").alias("i"), "component").checkpoint()
    border = both.join(ids, [*FRAME, "i"], "left_anti").join(named.withColumnRenamed("i", "j"), [*FRAME, "j"]).groupBy(*FRAME, "i").agg(F.min("component").alias("component"))
    label = named.unionByName(border)
    return all_.join(label, [*FRAME, "i"], "left").select(*FRAME, F.col("i").alias(rec), F.coalesce("component", F.lit(-1)).alias("cluster"))


def line_fit(members: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, cx, cy, ux, uy, aspect``: main axis of each group of points (x, y) from its second moments.

    The axis points to +x, or to +y if it is upright; aspect is 999 for points on a line.
    """
    m = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"), F.covar_pop("x", "y").alias("_vxy"))
    half, root = (F.col("_vx") + F.col("_vy")) / 2, F.hypot((F.col("_vx") - F.col("_vy")) / 2, F.col("_vxy"))
    angle = F.atan2(2 * F.col("_vxy"), F.col("_vx") - F.col("_vy")) / 2
    m = m.withColumn("_t", angle).withColumn("_least", (half - root) * F.col("n")).withColumn("_most", (half + root) * F.col("n"))
    aspect = F.when(F.col("_least") > 1e-9, F.sqrt(F.col("_most") / F.col("_least"))).otherwise(999.0)
    return m.select(*keys, "n", "cx", "cy", F.cos("_t").alias("ux"), F.sin("_t").alias("uy"), aspect.alias("aspect"))


def along_line(members: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` with their place along (``s``) and across (``h``) their line."""
    rx, ry = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    j = members.join(lines.select(*keys, "cx", "cy", "ux", "uy"), keys)
    return j.withColumn("s", rx * F.col("ux") + ry * F.col("uy")).withColumn("h", ry * F.col("ux") - rx * F.col("uy")).drop("cx", "cy", "ux", "uy")


def boundaries(pairs: DataFrame, eps: float = 76.0, least: int = 3, min_aspect: float = 2.0, max_angle: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """Grain boundaries as lines of dislocation pairs: (boundaries, members).

    ``run_id, frame, gb, kind, n, aspect, misorientation_deg, cx, cy, ux, uy, x1, y1, x2, y2`` and
    ``run_id, frame, gb, i5, x, y, s, h, mis``. Pairs are numbered in their frame by (i5, i7), and ``gb`` is the smallest number of the cluster's cores. A cluster rounder
    than ``min_aspect`` is none. Low-angle (LAGB) if the mean known misorientation (0 if none is known) is below ``max_angle``.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    # the pairs of one image are bounded
    p = pairs.withColumn("pair_id", F.row_number().over(Window.partitionBy(*FRAME).orderBy("i5", "i7")).cast("bigint")).checkpoint()
    c = dbscan(p, "pair_id", eps, least).where("cluster <> -1").select(*FRAME, "pair_id", F.col("cluster").alias("gb"))
    keys = [*FRAME, "gb"]
    m = p.join(c, [*FRAME, "pair_id"]).checkpoint()
    lines = line_fit(m, keys).where((F.col("aspect") >= min_aspect) & (F.col("n") >= least))
    placed = along_line(m, lines, keys).checkpoint()
    ends = placed.groupBy(*keys).agg(F.min("s").alias("_s0"), F.max("s").alias("_s1"), F.coalesce(F.avg("misorientation_deg"), F.lit(0.0)).alias("misorientation_deg"))
    b = lines.join(ends, keys).checkpoint()
    at = lambda c, u, s: F.col(c) + F.col(s) * F.col(u)
    b = b.select(*keys, F.when(F.col("misorientation_deg") < max_angle, "LAGB").otherwise("HAGB").alias("kind"), "n", "aspect", "misorientation_deg", "cx", "cy", "ux", "uy", at("cx", "ux", "_s0").alias("x1"), at("cy", "uy", "_s0").alias("y1"), at("cx", "ux", "_s1").alias("x2"), at("cy", "uy", "_s1").alias("y2"))
    return b, placed.select(*keys, "i5", "x", "y", "s", "h", F.col("misorientation_deg").alias("mis"))


def band_misorientation(b: DataFrame, members: DataFrame, points: DataFrame, spacing: Column, least: int = 5) -> DataFrame:
    """``run_id, frame, gb, theta_grains_deg, n_band_a, n_band_b``: angle between the lattices on both sides of a boundary.

    Bands start 1.5 lattice constants (``spacing``, a column of ``b``) off the line and are
    as wide as the greater of two constants and half the dislocation spacing.
    Only points with |psi6| above 0.3 count; each side needs ``least``.
    """
    keys = [*FRAME, "gb"]
    line = Window.partitionBy(*keys).orderBy("s")
    gaps = members.withColumn("_gap", F.col("s") - F.lag("s").over(line)).where("_gap is not null")
    d = bounded_medians(gaps, keys, "_gap").select(*keys, F.col("median").alias("_D"))
    ends = members.groupBy(*keys).agg(F.min("s").alias("_s0"), F.max("s").alias("_s1"))
    x = b.withColumn("_b", spacing).join(ends, keys).join(d, keys, "left")
    x = x.withColumn("_in", 1.5 * F.col("_b")).withColumn("_out", F.col("_in") + F.greatest(2 * F.col("_b"), F.greatest(F.coalesce("_D", "_b"), F.col("_b")) / 2))
    sides = band_sides(x, points, keys).where(F.col("n") >= least)
    g = sides.groupBy(*keys).pivot("side", ["a", "b"]).agg(F.first("n").alias("n"), F.first("re").alias("re"), F.first("im").alias("im")).where("a_n is not null and b_n is not null")
    turn = (F.atan2("a_im", "a_re") - F.atan2("b_im", "b_re")) / 6
    return g.select(*keys, F.abs(F.pmod(F.degrees(turn) + 30, F.lit(60.0)) - 30).alias("theta_grains_deg"), F.col("a_n").alias("n_band_a"), F.col("b_n").alias("n_band_b"))


def band_sides(lines: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, side, n, re, im``: mean unit vector of 6 times the lattice angle over the ordered points beside a line, by side (a: positive h).

    ``lines``: ``keys`` (run_id and frame among them), ``cx, cy, ux, uy``, the extent ``_s0, _s1`` and the band from ``_in`` to ``_out``.
    """
    p = points.where(F.hypot("psi_re", "psi_im") > 0.3).select(*FRAME, "x", "y", "psi_re", "psi_im", F.hypot("psi_re", "psi_im").alias("_m"))
    j = lines.select(*keys, "cx", "cy", "ux", "uy", "_s0", "_s1", "_in", "_out").join(p, FRAME)
    rx, ry = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    j = j.withColumn("_s", rx * F.col("ux") + ry * F.col("uy")).withColumn("_h", ry * F.col("ux") - rx * F.col("uy"))
    j = j.where((F.col("_s") > F.col("_s0")) & (F.col("_s") < F.col("_s1")) & (F.abs("_h") > F.col("_in")) & (F.abs("_h") < F.col("_out")))
    side = F.when(F.col("_h") > 0, "a").otherwise("b").alias("side")
    return j.groupBy(*keys, side).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("psi_re") / F.col("_m")).alias("re"), F.avg(F.col("psi_im") / F.col("_m")).alias("im"))


def trim_members(members: DataFrame, max_h: Column, least: int = 3) -> DataFrame:
    """Members within ``max_h`` of their boundary's median ``h``; boundaries left with fewer than ``least`` go."""
    keys = [*FRAME, "gb"]
    med = bounded_medians(members, keys, "h").select(*keys, F.col("median").alias("_med"))
    kept = members.join(med, keys).where(F.abs(F.col("h") - F.col("_med")) <= max_h).drop("_med")
    n = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return kept.join(n.select(*keys), keys, "left_semi")


def bond_filter(edges: DataFrame, times: float = 1.4) -> DataFrame:
    """Edges shorter than ``times`` the median edge of their frame."""
    med = bounded_medians(edges, FRAME, "len").select(*FRAME, F.col("median").alias("_m"))
    return edges.join(med, FRAME).where(F.col("len") < times * F.col("_m")).drop("_m")


def bond_asymmetry(edges: DataFrame, spins: DataFrame, rec: str) -> DataFrame:
    """``run_id, n_same, n_mixed, len_same, len_mixed, percent``: mean bond length between equal and opposite spins (``rec, s``), and by how much the mixed ones are shorter."""
    side = lambda c: spins.select(F.col(rec).alias(c), F.col("s").alias(f"_{c}"))
    e = edges.join(side("i"), "i").join(side("j"), "j").withColumn("_same", F.col("_i") == F.col("_j"))
    of = lambda f, same: f(F.when(F.col("_same") == same, F.col("len")))
    g = e.groupBy("run_id").agg(of(F.count, True).alias("n_same"), of(F.count, False).alias("n_mixed"), of(F.avg, True).alias("len_same"), of(F.avg, False).alias("len_mixed"))
    return g.withColumn("percent", (1 - F.col("len_mixed") / F.col("len_same")) * 100)


def frustrated_bonds(edges: DataFrame, spins: DataFrame, rec: str) -> DataFrame:
    """``run_id, frame, rec, n_frustrated``: bonds of a point to points of its own spin."""
    side = lambda c: spins.select(F.col(rec).alias(c), F.col("s").alias(f"_{c}"))
    e = edges.join(side("i"), "i").join(side("j"), "j").where("_i = _j")
    return e.select(*FRAME, F.explode(F.array("i", "j")).alias(rec)).groupBy(*FRAME, rec).agg(F.count(F.lit(1)).alias("n_frustrated"))
