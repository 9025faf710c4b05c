"""Irregular readings onto a regular grid, one row per slot and source.

Sorted grid and sorted readings of a source are merged as-of: every slot takes
the last reading at or before it and the first one at or after it, and is
interpolated between the two in proportion to time, unless they lie further
apart than the gap limit. Sources are cut into blocks of ``block`` slots, so a
source with a third of all rows is many tasks' work; what a block needs from
its neighbours (the last reading before it and the first one after it) comes
from a table of one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192


def one_per_slot(readings: DataFrame, source: list[str], slot: str, rec: str, values: list[str], near: str | None = None) -> DataFrame:
    """The reading that stands for its slot: the nearest to the slot's time (``near``, smaller is better), then the smallest ``rec``."""
    best = F.min(F.struct(*([F.coalesce(F.col(near), F.lit(float("inf"))).alias("_near")] if near else []), F.col(rec), *[F.col(v) for v in values]))
    picked = readings.where(F.col(slot).isNotNull()).groupBy(*source, slot).agg(best.alias("_b"))
    return picked.select(*source, slot, *[F.col(f"_b.{v}").alias(v) for v in values])


def regular_grid(readings: DataFrame, source: list[str], slot: str, value: str, gap_limit: int | None = None, block: int = BLOCK) -> DataFrame:
    """``source, slot, is_reading, value, filled, prev_slot, next_slot`` for each slot from a source's first to its last reading.

    ``readings`` has at most one usable reading per source and slot (see
    ``one_per_slot``); rows with a NULL slot or source or a NULL or NaN value
    count as not there. ``filled`` is ``value`` at a reading, else the time-weighted mean of
    the neighbours on both sides if they are at most ``gap_limit`` slots apart
    (None: no limit), else NULL: the slot is marked missing. A source with one
    reading has one row. Infinite neighbours give what their arithmetic gives.
    """
    v = F.col(value).cast("double")
    there = F.col(slot).isNotNull() & F.col(value).isNotNull() & ~F.isnan(v)
    for c in source:
        there = there & F.col(c).isNotNull()
    r = readings.where(there)
    r = r.select(*source, F.col(slot).cast("bigint").alias("slot"), v.alias("x")).withColumn("_block", F.floor(F.col("slot") / block).cast("bigint"))
    ends = r.groupBy(*source).agg(F.min("slot").alias("_first"), F.max("slot").alias("_last"))
    # the grid: blocks first, then their slots, so that no row ever holds a whole long source
    grid = ends.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / block).cast("bigint"), F.floor(F.col("_last") / block).cast("bigint"))))
    inside = F.sequence(F.greatest("_first", F.col("_block") * block), F.least("_last", (F.col("_block") + 1) * block - 1))
    slots = grid.select(*source, "_block", F.explode(inside).alias("slot"))
    keys = [*source, "_block"]
    merged = r.select(*keys, "slot", "x").withColumn("_grid", F.lit(0)).unionByName(slots.select(*keys, "slot", F.lit(None).cast("double").alias("x"), F.lit(1).alias("_grid")))
    here = F.when(F.col("x").isNotNull(), F.struct("slot", "x"))
    before = Window.partitionBy(*keys).orderBy("slot", "_grid").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.col("slot").desc(), "_grid").rowsBetween(Window.unboundedPreceding, 0)
    asof = merged.withColumn("_prev", F.last(here, ignorenulls=True).over(before)).withColumn("_next", F.last(here, ignorenulls=True).over(after)).where("_grid = 1")
    # across blocks: only sources of several blocks have rows here
    long = grid.where(F.floor(F.col("_first") / block) < F.floor(F.col("_last") / block)).select(*keys)
    edge = r.groupBy(*keys).agg(F.max(F.struct("slot", "x")).alias("_tail"), F.min(F.struct("slot", "x")).alias("_head"))
    line = Window.partitionBy(*source)
    carry = (
        long.join(edge, keys, "left")
        .withColumn("_before", F.last("_tail", ignorenulls=True).over(line.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_after", F.last("_head", ignorenulls=True).over(line.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "_before", "_after")
    )
    asof = asof.join(carry, keys, "left").withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after"))
    lo, hi = F.col("_prev.slot"), F.col("_next.slot")
    is_reading = lo == F.col("slot")
    share = (F.col("slot") - lo) / (hi - lo)
    between = F.col("_prev.x") * (1 - share) + F.col("_next.x") * share
    near = F.lit(True) if gap_limit is None else hi - lo <= gap_limit
    return asof.select(
        *source,
        "slot",
        is_reading.alias("is_reading"),
        F.when(is_reading, F.col("_prev.x")).alias("value"),
        F.when(is_reading, F.col("_prev.x")).when(near, between).alias("filled"),
        lo.alias("prev_slot"),
        hi.alias("next_slot"),
    )
