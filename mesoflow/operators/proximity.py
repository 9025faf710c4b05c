"""Points near other points, and points in regions, by space-filling-curve ranges.

Every point gets the Z-order code of its cell (cells as wide as the radius).
A disc or polygon is covered by cells, and these by ranges of consecutive codes.
Ranges are cut at tiles (2^k x 2^k cells, a common prefix of their codes), so
the range join is an equality on (group, tile) with a range condition on the
sorted codes; Spark sorts both sides by tile and splits tiles that hold
too much (AQE skew join). The last step is the exact distance or ray cast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesoflow.session import ensure_checkpoint_dir

#: log2 of the cells along a tile's side.
TILE_BITS = 3
#: Cells are numbered from -2^20 to 2^20 in both directions, which 42 bits of code hold.
_HALF = 1 << 20


def _spread(c: Column) -> Column:
    """Bits of a 21-bit number moved to the even places."""
    x = c.cast("bigint")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def cell_code(cx: Column, cy: Column) -> Column:
    """Z-order code of a cell; it rises with either coordinate."""
    return _spread(cx + _HALF).bitwiseOR(F.shiftleft(_spread(cy + _HALF), 1))


def _cells(v: str | Column, size: float | Column) -> Column:
    """Cell number; places beyond the numbered square share its rim, which keeps joins right and only makes them less even."""
    x = F.col(v) if isinstance(v, str) else v
    return F.least(F.greatest(F.floor(x / (F.lit(size) if isinstance(size, float) else size)).cast("bigint"), F.lit(2 - _HALF)), F.lit(_HALF - 2))


def usable(points: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose group is not NULL and whose coordinates are finite."""
    keep = F.lit(True)
    for c in ("x", "y"):
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    for c in cols:
        keep = keep & F.col(c).isNotNull()
    return points.where(keep)


def _near(queries: DataFrame, points: DataFrame, groups: list[str], rec: str, radius: float | None, wanted: Column) -> DataFrame:
    """``groups, a, b, dist2`` of queries a and points b of one group within ``radius`` for which ``wanted`` holds.

    With ``radius`` None it is the column ``_r`` of both tables, the same for all points of a group.
    """
    own = radius is None
    reach = F.col("_r") if own else radius

    def cells(df: DataFrame) -> DataFrame:
        p = usable(df.select(*groups, rec, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *["_r"] * own), [*groups, rec])
        return p.withColumn("_cx", _cells("x", reach)).withColumn("_cy", _cells("y", reach))

    code, n = cell_code(F.col("_cx"), F.col("_cy")), 1 << TILE_BITS
    right = cells(points).select(*groups, F.shiftright(code, 2 * TILE_BITS).alias("_tile"), code.alias("_code"), F.col(rec).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    # the disc lies in the square of 3 x 3 cells around its centre; of each tile (mostly one) that the square
    # touches, the codes of the common part lie between those of its lower left and upper right cell
    left = cells(queries)
    for axis in ("x", "y"):
        c = F.col(f"_c{axis}")
        left = left.withColumn(f"_t{axis}", F.explode(F.sequence(F.shiftright(c - 1, TILE_BITS), F.shiftright(c + 1, TILE_BITS))))
    corner = lambda pick, d, e: cell_code(*[pick(F.col(f"_c{axis}") + d, F.col(f"_t{axis}") * n + e) for axis in ("x", "y")])
    lo, hi = corner(F.greatest, -1, 0), corner(F.least, 1, n - 1)
    left = left.select(*groups, F.shiftright(lo, 2 * TILE_BITS).alias("_tile"), lo.alias("_lo"), hi.alias("_hi"), F.col(rec).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), *["_r"] * own)
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    near = wanted & F.col("_code").between(F.col("_lo"), F.col("_hi")) & (d2 <= reach * reach)
    joined = left.alias("l").join(right.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*groups, "_tile"]] + [near])
    return joined.select(*[F.col(f"l.{g}").alias(g) for g in groups], "a", "b", d2.alias("dist2"))


def near_pairs(points: DataFrame, groups: list[str], rec: str, radius: float | None) -> DataFrame:
    """``groups, a, b, dist2`` with a < b: points of one group at a distance of at most ``radius`` (None: the column ``_r``, one value per group).

    ``points`` has ``groups, rec, x, y`` and one row per ``rec``; rows with a
    NULL group or ``rec``, or NULL, NaN or infinite x or y have no pairs. The distance is
    computed in double. Points at the same place are pairs with distance 0.
    """
    return _near(points, points, groups, rec, radius, F.col("a") < F.col("b"))


def nearest(points: DataFrame, groups: list[str], rec: str, k: int) -> DataFrame:
    """``groups, a, b, dist2, rank``: the ``k`` nearest other points of each point in its group (fewer in a smaller group), ties by ``b``.

    A group's first discs are as large as hold 4 (k + 1) points on average over its bounding box;
    points that find fewer than ``k`` others (corners, gaps) go on with twice the radius, until none
    is left. Each round is checkpointed once, so no round is computed twice.
    """
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    p = usable(points.select(*groups, rec, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), [*groups, rec])
    wide, high = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    long = F.greatest(wide, high)
    # points on a line have no area: a strip of the mean distance stands for it
    area = F.greatest(wide * high, long * long / F.count(F.lit(1)))
    fair = F.sqrt(area * (4 * (k + 1)) / (F.count(F.lit(1)) * math.pi))
    sizes = p.groupBy(*groups).agg(F.least(F.count(F.lit(1)) - 1, F.lit(k)).alias("_need"), F.greatest(fair, long / _HALF, F.lit(1e-9)).alias("_r"))
    p = p.join(sizes, groups).where("_need > 0").checkpoint()
    todo, found = p, []
    order = Window.partitionBy(*groups, "a").orderBy("dist2", "b")
    for _ in range(80):
        pairs = _near(todo, p, groups, rec, None, F.col("a") != F.col("b"))
        top = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = top.groupBy(*groups, F.col("a").alias(rec)).agg(F.collect_list(F.struct("b", "dist2", "rank")).alias("_top"))
        done = todo.join(top, [*groups, rec], "left").checkpoint()
        enough = F.coalesce(F.size("_top"), F.lit(0)) >= F.col("_need")
        found.append(done.where(enough).select(*groups, F.col(rec).alias("a"), F.inline("_top")).select(*groups, "a", "b", "dist2", "rank"))
        todo = done.where(~enough).drop("_top").withColumn("_r", F.col("_r") * 2)
        if todo.isEmpty():
            break
        p = p.withColumn("_r", F.col("_r") * 2)
    else:
        raise ValueError("points too far apart for a search by doubled radius")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def inside_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray cast over an array of [x, y]; NULL for a NULL ring, false for fewer than 3 vertices."""
    n = F.size(ring)
    edges = F.sequence(F.lit(1), n)

    def cast(hits: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        ax, ay, bx, by = F.element_at(a, 1), F.element_at(a, 2), F.element_at(b, 1), F.element_at(b, 2)
        crosses = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        return hits + F.when(crosses, 1).otherwise(0)

    return F.when(ring.isNull(), F.lit(None).cast("boolean")).when(n < 3, F.lit(False)).otherwise(F.aggregate(edges, F.lit(0), cast) % 2 == 1)


def region_cover(regions: DataFrame, keys: list[str], ring: str, cell: float) -> DataFrame:
    """``keys, _tile, _lo, _hi, ring``: ranges of cell codes that cover each polygon, by tiles.

    In each row of tiles the cover reaches from the polygon's leftmost to its rightmost place
    there. Regions without three finite vertices, or with a NULL key, have no cover. Tiles are clamped like the points' cells.
    """
    n = 1 << TILE_BITS
    tile = lambda v: F.shiftright(_cells(v, cell), TILE_BITS)
    xs, ys = F.transform(F.col(ring), lambda p: F.element_at(p, 1)), F.transform(F.col(ring), lambda p: F.element_at(p, 2))
    whole = F.forall(F.col(ring), lambda p: F.coalesce((F.size(p) >= 2) & (F.abs(F.element_at(p, 1)) < float("inf")) & (F.abs(F.element_at(p, 2)) < float("inf")), F.lit(False)))
    there = (F.size(ring) >= 3) & whole
    for key in keys:
        there = there & F.col(key).isNotNull()
    box = regions.where(there).select(*keys, F.col(ring).alias("ring"), xs.alias("_xs"), ys.alias("_ys"))
    rows = box.withColumn("_ty", F.explode(F.sequence(tile(F.array_min("_ys")), tile(F.array_max("_ys")))))
    # rows at the rim reach to infinity, as the cells there do
    edge = lambda at, far, inf: F.when(F.col("_ty") == F.shiftright(F.lit(far).cast("bigint"), TILE_BITS), F.lit(inf)).otherwise(at * (cell * n))
    low, high = edge(F.col("_ty"), 2 - _HALF, float("-inf")), edge(F.col("_ty") + 1, _HALF - 2, float("inf"))
    rows = rows.withColumn("_y0", low).withColumn("_y1", high)
    count = F.size("_xs")

    def crossing(i: Column) -> Column:
        """The places of edge i in the row: its ends cut at the row's borders."""
        j = F.when(i == count, 1).otherwise(i + 1)
        ax, ay, bx, by = F.element_at("_xs", i), F.element_at("_ys", i), F.element_at("_xs", j), F.element_at("_ys", j)
        at = lambda y: F.when(by == ay, ax).otherwise(ax + (bx - ax) * ((y - ay) / (by - ay)))
        meets = (F.least(ay, by) <= F.col("_y1")) & (F.greatest(ay, by) >= F.col("_y0"))
        first, last = (F.greatest(F.least(y, F.col("_y1")), F.col("_y0")) for y in (ay, by))
        return F.when(meets, F.array(F.when(first == ay, ax).otherwise(at(first)), F.when(last == by, bx).otherwise(at(last)))).otherwise(F.array().cast("array<double>"))

    rows = rows.withColumn("_at", F.flatten(F.transform(F.sequence(F.lit(1), count), crossing))).where(F.size("_at") > 0)
    # a cell more on both sides: the cut places are rounded
    left, right = tile(F.array_min("_at") - cell), tile(F.array_max("_at") + cell)
    rows = rows.withColumn("_tx", F.explode(F.sequence(left, right)))
    lo = cell_code(F.col("_tx") * n, F.col("_ty") * n)
    return rows.select(*keys, "ring", F.shiftright(lo, 2 * TILE_BITS).alias("_tile"), lo.alias("_lo"), (lo + (1 << (2 * TILE_BITS)) - 1).alias("_hi"))


def points_in_regions(points: DataFrame, regions: DataFrame, keys: list[str], rec: str, ring: str, cell: float = 16.0) -> DataFrame:
    """``keys, rec`` of the points inside the polygon of their keys (even-odd; a polygon of under 3 vertices holds nothing)."""
    p = usable(points.select(*keys, rec, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), [*keys, rec])
    code = cell_code(_cells("x", cell), _cells("y", cell))
    p = p.withColumn("_code", code).withColumn("_tile", F.shiftright(F.col("_code"), 2 * TILE_BITS))
    cover = region_cover(regions, keys, ring, cell)
    on = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in [*keys, "_tile"]] + [F.col("_code").between(F.col("_lo"), F.col("_hi")), inside_polygon(F.col("x"), F.col("y"), F.col("ring"))]
    return p.alias("p").join(cover.alias("c"), on).select(*[F.col(f"p.{k}").alias(k) for k in keys], rec)
