"""Exact percentiles per group from cumulative frequencies.

The column is first reduced to (group, value) counts, with partial aggregation
on the map side. The counts are put into value order in value ranges; running
sums inside a range plus the counts of all lower ranges give each value's
cumulative count, and the first value that reaches a target rank is the
percentile. There is no sketch: the rank error is 0, and the value error is 0
unless ``relative_error`` asks for coarser states.

A group's ranges are cut at its own values, at one distinct value in ``RANGE`` chosen by a
hash. So a group with a third of all rows is sorted by many tasks, groups on
different scales do not share cuts, a small group has one range, and the cuts
are the same whenever they are computed. The plan is one for all sizes and building it starts no job.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of a group per value range, on average. The cuts are broadcast: 8 bytes per so many distinct values (80 MB for 10^13).
RANGE = 1 << 20
#: Cuts between two steps of the coarse search.
_STEP = 256


def coarse(value: Column, relative_error: float) -> Column:
    """The value that stands for all values within ``relative_error`` of it (geometric buckets, sign kept, 0 and infinities exact)."""
    gamma = math.log((1 + relative_error) / (1 - relative_error))
    size = F.exp((F.floor(F.log(F.abs(value)) / F.lit(gamma)) + F.lit(0.5)) * F.lit(gamma))
    return F.when((value == 0) | (F.abs(value) == float("inf")), value).otherwise(F.signum(value) * size)


def value_counts(df: DataFrame, groups: list[str], value: str, relative_error: float = 0.0, extra: list[str] | None = None) -> DataFrame:
    """The combinable state: ``groups, extra, value, n``.

    States of separate days or partitions are combined by ``combine``.
    NULL and NaN values are not counted. With ``relative_error`` e every value
    is replaced by one within a factor (1 +- e), which bounds the state's size
    by the number of decades instead of the number of distinct values.
    """
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    v = F.col(value).cast("double")
    # -0.0 and 0.0 are one value
    v = F.when(v == 0, F.lit(0.0)).otherwise(coarse(v, relative_error) if relative_error else v)
    keys = [*groups, *(extra or [])]
    return kept.select(*keys, v.alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def combine(states: DataFrame, groups: list[str]) -> DataFrame:
    """Add up states of days, partitions or runs: counts of equal values are summed, so nothing is lost."""
    return states.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def _in_ranges(counts: DataFrame, every: int) -> DataFrame:
    """Adds ``_block``, the number of the group's cuts at or below the value."""
    chosen = counts.where(F.pmod(F.xxhash64("_g", "value"), F.lit(every)) == 0)
    cuts = chosen.groupBy("_g").agg(F.sort_array(F.collect_list("value")).alias("_cuts"))
    # every _STEP-th cut first, then the cuts from there on: a search of cuts / _STEP + _STEP steps
    rough = F.transform(F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / _STEP).cast("int")), lambda i: F.element_at("_cuts", i * _STEP + 1))
    keyed = counts.join(F.broadcast(cuts.withColumn("_rough", rough)), "_g", "left")
    start = F.greatest(F.size(F.filter("_rough", lambda c: c <= F.col("value"))) - 1, F.lit(0)) * _STEP
    at = start + F.size(F.filter(F.slice("_cuts", start + 1, F.lit(_STEP)), lambda c: c <= F.col("value")))
    return keyed.select("_g", "value", "n", F.when(F.col("_cuts").isNull(), 0).otherwise(at).alias("_block"))


def _in_octaves(counts: DataFrame) -> DataFrame:
    """Adds ``_block``, a 64th of the value's octave (0 below all): ranges for large groups of values of at least 0, which need no cuts."""
    return counts.withColumn("_block", F.coalesce(F.floor(F.log2("value") * 64), F.lit(-(1 << 20))).cast("int"))


def pick_ranks(counts: DataFrame, groups: list[str], ranks: Callable[[Column], list[Column]], every: int = RANGE) -> DataFrame:
    """``groups, n_rows, hit, value``: the first values whose cumulative counts reach given ranks.

    ``ranks`` makes, from a group's row count, structs that have a BIGINT field
    ``rank``; each comes back as ``hit``. ``every`` sets the size of the value ranges; 0 takes 64ths of octaves,
    for finite values of at least 0 and groups that are known to be large.
    """
    # one struct for the key: in it NULL equals NULL
    keyed = counts.select(F.struct(*groups).alias("_g"), "value", "n")
    keyed = _in_ranges(keyed, every) if every else _in_octaves(keyed)
    inside = Window.partitionBy("_g", "_block").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    lower = Window.partitionBy("_g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and range, with the ranks that lie in it
    blocks = keyed.groupBy("_g", "_block").agg(F.sum("n").alias("_in"))
    blocks = blocks.select("_g", "_block", "_in", F.coalesce(F.sum("_in").over(lower), F.lit(0)).alias("_offset"), F.sum("_in").over(Window.partitionBy("_g")).alias("n_rows"))
    own = F.filter(F.array(*ranks(F.col("n_rows"))), lambda r: (r["rank"] > F.col("_offset")) & (r["rank"] <= F.col("_offset") + F.col("_in")))
    blocks = blocks.select("_g", "_block", "_offset", "n_rows", own.alias("_ranks")).where(F.size("_ranks") > 0)
    summed = keyed.withColumn("_cum", F.sum("n").over(inside)).join(blocks, ["_g", "_block"])
    upto = F.col("_offset") + F.col("_cum")
    reached = F.filter("_ranks", lambda r: (r["rank"] <= upto) & (r["rank"] > upto - F.col("n")))
    hit = summed.select("_g", "value", "n_rows", reached.alias("_hit")).where(F.size("_hit") > 0)
    return hit.select("_g.*", "n_rows", F.explode("_hit").alias("hit"), "value")


def percentiles_of_counts(counts: DataFrame, groups: list[str], ps: list[float], every: int = RANGE) -> DataFrame:
    """``groups, n_rows, p, rank, value``: for each p the smallest value whose cumulative count reaches ``greatest(1, ceil(p * n))``.

    p * n is rounded to 6 digits first, so 0.1 * 30 is 3. Empty input gives no
    rows; a group whose key has NULLs is a group like any other.
    """

    def ranks(n: Column) -> list[Column]:
        return [F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.round(F.lit(float(p)) * n, 6))).cast("bigint").alias("rank")) for p in ps]

    return pick_ranks(counts, groups, ranks, every).select(*groups, "n_rows", F.col("hit.p").alias("p"), F.col("hit.rank").alias("rank"), "value")


def exact_percentiles(df: DataFrame, groups: list[str], value: str, ps: list[float], relative_error: float = 0.0, every: int = RANGE) -> DataFrame:
    """``percentiles_of_counts`` of a table."""
    return percentiles_of_counts(value_counts(df, groups, value, relative_error), groups, ps, every)


def linear_percentiles(df: DataFrame, groups: list[str], value: str, ps: dict[str, float], every: int = RANGE) -> DataFrame:
    """``groups, n_rows`` and a column per name: percentiles interpolated between the two nearest ranks, as numpy's default has them."""

    def ranks(n: Column) -> list[Column]:
        out = []
        for name, p in ps.items():
            at = F.lit(float(p)) * (n - 1)
            for side, r in (("lo", F.floor(at)), ("hi", F.ceil(at))):
                out.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (at - F.floor(at)).alias("share"), (r + 1).cast("bigint").alias("rank")))
        return out

    hit = pick_ranks(value_counts(df, groups, value), groups, ranks, every)
    of = lambda name, side, c: F.max(F.when((F.col("hit.name") == name) & (F.col("hit.side") == side), F.col(c)))
    mixed = [(of(n, "lo", "value") + (of(n, "hi", "value") - of(n, "lo", "value")) * of(n, "lo", "hit.share")).alias(n) for n in ps]
    return hit.groupBy(*groups).agg(F.max("n_rows").alias("n_rows"), *mixed)


def exact_medians(df: DataFrame, groups: list[str], value: str, every: int = RANGE) -> DataFrame:
    """``groups, n_rows, median``: the mean of the two middle values, as numpy has it."""

    def ranks(n: Column) -> list[Column]:
        return [F.struct(r.cast("bigint").alias("rank"), F.lit(i).alias("side")) for i, r in enumerate((F.ceil(n / 2), F.floor(n / 2) + 1))]

    hit = pick_ranks(value_counts(df, groups, value), groups, ranks, every)
    return hit.groupBy(*groups).agg(F.max("n_rows").alias("n_rows"), (F.sum("value") / 2).alias("median"))


def bounded_medians(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The same for groups that are bounded by nature (the points of one image): one aggregate, one shuffle.

    NULL and NaN are passed over; a group of only these has no row.
    """
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), F.median(v).alias("median"))
