"""Identities of grain boundaries over frames, as joins over a small table of lines.

A line is one boundary of one frame: centre, axis and extent along it. Which
lines can belong together is found by an equality join on the image tiles that
they reach into; of the candidates, links are granted by iterated mutual best, which
is the greedy one-to-one choice in order of the links; and identities are the roots of the
chains of links, found by pointer doubling. So a run with a third of all
boundaries is many tasks' work, and no step is serial in time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesoflow.operators.structure import FRAME, along_line, line_fit, link_components
from mesoflow.session import ensure_checkpoint_dir

LINE = [*FRAME, "gb"]
#: Side of the tiles by which lines are joined, in px.
TILE = 512.0


def lines_of(members: DataFrame) -> DataFrame:
    """``run_id, frame, gb, n, cx, cy, ux, uy, lo, hi, mis, low``: line, extent, mean misorientation and kind of each boundary of ``members``.

    ``members``: ``run_id, frame, gb, x, y, mis, low``. An unknown misorientation is passed over, and is 0 if no member's is known.
    ``low`` is the vote of the members.
    """
    fit = line_fit(members, LINE).drop("aspect")
    placed = along_line(members.select(*LINE, "x", "y", "mis", F.col("low").cast("double").alias("low")), fit, LINE)
    own = placed.groupBy(*LINE).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.coalesce(F.avg("mis"), F.lit(0.0)).alias("mis"), (F.avg("low") >= 0.5).alias("low"))
    return fit.join(own, LINE)


def _tiles(lines: DataFrame, grow: Column) -> DataFrame:
    """A row for each tile that the box of a line, grown on all sides, reaches into (``tx, ty``)."""
    for axis in ("x", "y"):
        ends = [F.col(f"c{axis}") + F.col(e) * F.col(f"u{axis}") for e in ("lo", "hi")]
        first, last = (F.floor(e / TILE).cast("int") for e in (F.least(*ends) - grow, F.greatest(*ends) + grow))
        lines = lines.withColumn(f"t{axis}", F.explode(F.sequence(first, last)))
    return lines


def _side(lines: DataFrame, mark: str) -> DataFrame:
    """The columns of ``lines`` but ``run_id``, ``tx``, ``ty`` and ``_on``, named for their side of a join."""
    return lines.select(*[F.col(c).alias(c if c in ("run_id", "tx", "ty", "_on") else f"{mark}{c}") for c in lines.columns])


def _offset() -> Column:
    """How far the centre of line b is from line a."""
    return F.abs((F.col("bcy") - F.col("acy")) * F.col("aux") - (F.col("bcx") - F.col("acx")) * F.col("auy"))


def _reach_of_b() -> tuple[Column, Column]:
    """The extent of line b along line a, by its ends."""
    at = [(F.col("bcx") + F.col(e) * F.col("bux") - F.col("acx")) * F.col("aux") + (F.col("bcy") + F.col(e) * F.col("buy") - F.col("acy")) * F.col("auy") for e in ("blo", "bhi")]
    return F.least(*at), F.greatest(*at)


def _parallel(degrees: float) -> Column:
    return F.abs(F.col("aux") * F.col("bux") + F.col("auy") * F.col("buy")) >= math.cos(math.radians(degrees))


def merge_collinear(members: DataFrame, settings: DataFrame, degrees: float = 20.0) -> DataFrame:
    """``members`` with ``gb`` of the first fragment for all fragments of one image that lie on one line.

    ``settings``: ``run_id, merge_gap, max_off`` in px. Two fragments are on one line if their axes agree within
    ``degrees``, the later one's centre is at most ``max_off`` off the earlier one's line, and at most
    ``merge_gap`` lies between them along it. Fragments joined through others are joined too.
    """
    f = lines_of(members).join(settings, "run_id")
    a = _side(_tiles(f.withColumn("_on", F.col("frame")), F.col("merge_gap") + F.col("max_off")), "a")
    b = _side(_tiles(f.drop("merge_gap", "max_off").withColumn("_on", F.col("frame")), F.lit(0.0)), "b")
    low, high = _reach_of_b()
    gap = F.greatest(low - F.col("ahi"), F.col("alo") - high)
    j = a.join(b, ["run_id", "_on", "tx", "ty"]).where((F.col("agb") < F.col("bgb")) & _parallel(degrees) & (_offset() <= F.col("amax_off")) & (gap <= F.col("amerge_gap")))
    links = j.select("run_id", F.col("aframe").alias("frame"), F.col("agb").alias("i"), F.col("bgb").alias("j")).distinct()
    own = f.select(*FRAME, F.col("gb").alias("i"), F.col("gb").alias("j"))
    first = link_components(links.unionByName(own), FRAME).withColumnsRenamed({"node": "gb", "component": "_first"})
    return members.join(first, LINE).withColumn("gb", F.col("_first")).drop("_first")


def _candidates(lines: DataFrame, settings: DataFrame, degrees: float, memory: int) -> DataFrame:
    """``run_id, aframe, agb, bframe, bgb, late, off``: lines b that may continue a line a of an earlier frame, ``late`` frames before."""
    f = lines.join(settings.select("run_id", "max_off"), "run_id")
    half = (F.col("hi") - F.col("lo")) / 2
    a = _side(_tiles(f, half + F.col("max_off")).withColumn("_on", F.explode(F.sequence(F.col("frame") + 1, F.col("frame") + memory + 1))), "a")
    b = _side(_tiles(f, half + F.col("max_off")).withColumn("_on", F.col("frame")), "b")
    along = (F.col("bcx") - F.col("acx")) * F.col("aux") + (F.col("bcy") - F.col("acy")) * F.col("auy")
    low, high = along + F.col("blo"), along + F.col("bhi")
    gap = F.greatest(F.col("alo") - high, low - F.col("ahi"))
    near = _parallel(degrees) & (_offset() <= F.col("amax_off")) & (gap <= F.greatest(F.col("ahi") - F.col("alo"), high - low) / 2)
    j = a.join(b, ["run_id", "_on", "tx", "ty"]).where(near)
    return j.select("run_id", "aframe", "agb", "bframe", "bgb", (F.col("bframe") - F.col("aframe")).alias("late"), _offset().alias("off")).distinct()


_A, _B = ["run_id", "aframe", "agb"], ["run_id", "bframe", "bgb"]


def _grant(candidates: DataFrame) -> DataFrame:
    """One-to-one links, the best first: fewest frames between, least offset, then names. Rounds of mutual best until no candidate is left."""
    order = [F.col("late"), F.col("off"), F.col("aframe"), F.col("agb"), F.col("bframe"), F.col("bgb")]
    left, granted = candidates, None
    while True:
        best = left.withColumn("_i", F.row_number().over(Window.partitionBy(*_A).orderBy(*order))).withColumn("_j", F.row_number().over(Window.partitionBy(*_B).orderBy(*order)))
        new = best.where("_i = 1 and _j = 1").select(*_A, "bframe", "bgb").checkpoint()
        granted = new if granted is None else granted.unionByName(new)
        left = left.join(new.select(*_A), _A, "left_anti").join(new.select(*_B), _B, "left_anti").checkpoint()
        if left.isEmpty():
            return granted


def _roots(lines: DataFrame, parents: DataFrame) -> DataFrame:
    """``run_id, frame, gb, rframe, rgb``: the first line of each line's chain; the reach of a pointer doubles in each round."""
    p = lines.select(*LINE).join(parents, LINE, "left")
    p = p.select(*LINE, F.coalesce("pframe", "frame").alias("rframe"), F.coalesce("pgb", "gb").alias("rgb")).checkpoint()
    while True:
        up = p.select("run_id", F.col("frame").alias("rframe"), F.col("gb").alias("rgb"), F.col("rframe").alias("_f"), F.col("rgb").alias("_g"))
        new = p.join(up, ["run_id", "rframe", "rgb"]).select(*LINE, F.col("_f").alias("rframe"), F.col("_g").alias("rgb"), ((F.col("_f") != F.col("rframe")) | (F.col("_g") != F.col("rgb"))).alias("_moved")).checkpoint()
        p = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return p


def track_boundaries(members: DataFrame, settings: DataFrame, degrees: float = 25.0, memory: int = 10) -> DataFrame:
    """``members`` with ``gb_id`` for ``gb``: identities that last over frames, numbered from 0 in each run by first frame.

    ``members``: ``run_id, frame, gb, x, y, mis, low`` and other columns; ``settings``: ``run_id, max_off`` and, to merge
    fragments first, ``merge_gap``. A line continues one of up to ``memory`` + 1 frames before if their axes agree
    within ``degrees``, its centre is at most ``max_off`` off that line and the gap along it is at most half the longer extent;
    one to one, by frames between and offset. A line that nothing is left to continue, but that could have continued what another line of its
    frame does, is a piece of the same boundary. Runs without settings have no rows.
    """
    ensure_checkpoint_dir(members.sparkSession)
    m = members.join(settings.select("run_id"), "run_id", "left_semi")
    if "merge_gap" in settings.columns:
        m = merge_collinear(m, settings)
    m = m.checkpoint()
    lines = lines_of(m).checkpoint()
    c = _candidates(lines, settings, degrees, memory).checkpoint()
    links = _grant(c)
    # pieces: their best candidate that is continued in the same frame
    loose = c.join(links.select(*_B), _B, "left_anti").join(links.select(*_A, "bframe", F.col("bgb").alias("_to")), [*_A, "bframe"])
    piece = loose.withColumn("_k", F.row_number().over(Window.partitionBy(*_B).orderBy("late", "off", "agb"))).where("_k = 1")
    up = lambda df, frame, gb: df.select("run_id", F.col("bframe").alias("frame"), F.col("bgb").alias("gb"), F.col(frame).alias("pframe"), F.col(gb).alias("pgb"))
    roots = _roots(lines, up(links, "aframe", "agb").unionByName(up(piece, "bframe", "_to")))
    names = roots.select("run_id", "rframe", "rgb").distinct().withColumn("gb_id", (F.row_number().over(Window.partitionBy("run_id").orderBy("rframe", "rgb")) - 1).cast("bigint"))
    of = roots.join(names, ["run_id", "rframe", "rgb"]).select(*LINE, "gb_id")
    return m.join(of, LINE).drop("gb")
