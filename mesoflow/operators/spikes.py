"""Spikes, stuck values and impossible readings, relative to each source.

The readings of a source are cut into profiles (stretches of a fixed number of
consecutive readings, the "days" of a source that has no calendar). The
profiles of a source are the rows of a matrix, which robust principal
components split into a low-rank part L (the source's normal behaviour) and a
sparse part S. Two things come of the split. A reading's score is its |S|
against the robust scale of S in its source, and readings that score high are
reported as such. And the readings whose S, or L, is large are the candidates
to which alone the exact spike rule is applied; by the triangle inequality
(X = L + S) the rule loses none of its cases by that, so its result is exact whatever the split. Constant runs and
ranges are tested apart.

Work is spread by (source, block): a source's readings are cut into blocks of
``block`` units of its order column, so one source with a third of all rows is
many tasks' work. Each block of a source of several also gets the
readings before and after it that its decisions need, and such a source's median
comes from ``quantiles``, distributed too. The plan is one for all sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mesoflow.operators.arrowgroups import floats, group_median, whole_groups
from mesoflow.operators.quantiles import exact_medians


@dataclass(frozen=True)
class Field:
    """One numeric column and its rules."""

    name: str
    #: Column with the exclusive upper bound, or None.
    below: str | None = None
    #: Values under this are impossible; with ``positive`` also the value 0.
    least: float = 0.0
    positive: bool = False
    #: Equal consecutive readings that make a stretch stuck.
    stuck: int = 8
    #: "ratio": more than ``times`` times (or less than 1/times of) the source's median;
    #: "jump": one or two readings off both neighbours by ``times`` median absolute changes.
    spike: str = "ratio"
    times: float = 6.0
    #: Readings that a source must have to be judged for spikes.
    enough: int = 1
    #: Profile length and profiles per matrix, at most.
    width: int = 16
    #: Robust scales of S from which a reading counts as off its source's normal behaviour.
    off: float = 8.0


def robust_pca(x: np.ndarray, iterations: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse parts of a stack of matrices (n, r, c).

    Principal component pursuit by augmented Lagrangian: singular value
    thresholding for L, soft thresholding for S. S is returned as X - L, so
    the parts always add up. Zero matrices stay zero. The few rounds leave dense noise in S, by whose scale S is judged.
    """
    n, r, c = x.shape
    if not n:
        return x, x
    lam = 1 / math.sqrt(max(r, c))
    top = np.linalg.norm(x.reshape(n, -1), axis=1)
    top[top == 0] = 1.0
    two = np.maximum(np.sqrt(np.linalg.eigvalsh(x @ x.transpose(0, 2, 1))[:, -1].clip(0)), 1e-12)
    scale = np.maximum(two, np.abs(x).max(axis=(1, 2)) / lam)[:, None, None]
    y = x / scale
    mu = (1.25 / two)[:, None, None]
    s = np.zeros_like(x)
    low = x
    for _ in range(iterations):
        a = x - s + y / mu
        u, sv, vt = np.linalg.svd(a, full_matrices=False)
        low = (u * np.maximum(sv - 1 / mu[:, :, 0], 0)[:, None, :]) @ vt
        b = x - low + y / mu
        s = np.sign(b) * np.maximum(np.abs(b) - lam / mu, 0)
        gap = x - low - s
        if (np.linalg.norm(gap.reshape(n, -1), axis=1) <= 1e-6 * top).all():
            break
        y = y + mu * gap
        mu = np.minimum(mu * 1.7, 1e9)
    return low, x - low


def profile_parts(gid: np.ndarray, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """L and S per reading; ``x`` is centred per group, so the padding 0 of a group's last matrix is normal.

    A group of n readings has profiles of 4 readings, of 8 from n = 64 on and of 16 from 256 on (``width`` at most).
    """
    low, sparse = np.zeros_like(x), np.zeros_like(x)
    if not len(x):
        return low, sparse
    starts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
    n = np.diff(np.r_[starts, len(x)])
    own = np.minimum(np.where(n >= 256, 16, np.where(n >= 64, 8, 4)), width)
    of, pos = np.repeat(own, n), np.arange(len(x)) - np.repeat(starts, n)
    for w in np.unique(own).tolist():
        at = np.flatnonzero(of == w)
        area = w * w
        cell = pos[at] % area
        which = np.cumsum(np.r_[True, (gid[at][1:] != gid[at][:-1]) | (cell[1:] == 0)]) - 1
        for a in range(0, int(which[-1]) + 1, 2048):
            lo, hi = np.searchsorted(which, [a, a + 2048])
            m = np.zeros((int(which[hi - 1]) - a + 1, area))
            m[which[lo:hi] - a, cell[lo:hi]] = x[at[lo:hi]]
            l, s = robust_pca(m.reshape(-1, w, w))
            low[at[lo:hi]] = l.reshape(-1, area)[which[lo:hi] - a, cell[lo:hi]]
            sparse[at[lo:hi]] = s.reshape(-1, area)[which[lo:hi] - a, cell[lo:hi]]
    return low, sparse


def residual_scores(gid: np.ndarray, sparse: np.ndarray, n_groups: int) -> np.ndarray:
    """|S| in robust scales (1.4826 times its median) of its group; where that is 0 the mean stands for it, and 0 is 0."""
    size = np.abs(sparse)
    scale = 1.4826 * group_median(gid, size, n_groups)
    mean = np.bincount(gid, size, n_groups) / np.maximum(np.bincount(gid, minlength=n_groups), 1)
    scale = np.where(scale > 0, scale, mean)[gid]
    return np.divide(size, scale, out=np.zeros_like(size), where=scale > 0)


def _stuck(gid: np.ndarray, v: np.ndarray, least: int) -> np.ndarray:
    if not len(v):
        return np.zeros(0, bool)
    new = np.r_[True, (gid[1:] != gid[:-1]) | (v[1:] != v[:-1])]
    run = np.cumsum(new) - 1
    return np.bincount(run)[run] >= least


def _ratio_spikes(gid: np.ndarray, v: np.ndarray, median: np.ndarray, f: Field) -> tuple[np.ndarray, np.ndarray]:
    """(readings that the exact rule flags, S)."""
    centre = median[gid]
    low, sparse = profile_parts(gid, np.log(v) - np.log(centre), f.width)
    # |log(v/median)| > log(times) needs |L| or |S| above half of it
    half = 0.49 * math.log(f.times)
    candidate = (np.abs(sparse) > half) | (np.abs(low) > half)
    hit = np.zeros(len(v), bool)
    i = np.flatnonzero(candidate)
    hit[i] = (v[i] > f.times * centre[i]) | (v[i] * f.times < centre[i])
    return hit, sparse


def _jump_spikes(gid: np.ndarray, v: np.ndarray, unit: np.ndarray, judged: np.ndarray, f: Field) -> tuple[np.ndarray, np.ndarray]:
    """(readings that the exact rule flags, S)."""
    n = len(v)
    if n < 3:
        return np.zeros(n, bool), np.zeros(n)
    u, on = unit[gid], judged[gid]
    limit = f.times * u
    centre = group_median(gid, v, int(gid[-1]) + 1)[gid]
    step = np.where(u > 0, u, 1.0)
    low, sparse = profile_parts(gid, np.where(on, (v - centre) / step, 0.0), f.width)
    bound = np.where(u > 0, 0.32 * f.times, 0.0)  # a jump of 15 units needs a part above a third of it
    odd = np.abs(sparse) > bound
    jump = np.zeros(n + 1, bool)  # jump[i]: between i-1 and i
    same = np.zeros(n + 1, bool)
    same[1:n] = gid[1:] == gid[:-1]
    jump[1:n] = odd[1:] | odd[:-1] | (np.abs(np.diff(low)) > bound[1:])
    # u == 0: any difference counts, however small the numbers make L and S
    jump[1:n] |= (u[1:] == 0) & (v[1:] != v[:-1])
    candidate = (jump[:-1] | jump[1:]) & on
    prev, nxt = np.r_[np.nan, v[:-1]], np.r_[v[1:], np.nan]
    a, b = v - prev, v - nxt
    with np.errstate(invalid="ignore"):
        inside = same[:n] & same[1:]
        one = inside & (a * b > 0) & (np.abs(a) > limit) & (np.abs(b) > limit)
        # two readings i, i+1 between i-1 and i+2
        nxt2 = np.r_[v[2:], np.nan, np.nan]
        inside2 = same[:n] & same[1:] & np.r_[same[2:], False][:n]
        d = np.stack([a, v - nxt2, nxt - prev, nxt - nxt2])
        two = inside2 & ((d > limit).all(axis=0) | (d < -limit).all(axis=0))
    return (one | two | np.r_[False, two[:-1]]) & candidate, sparse


def _values(t: pa.Table, f: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The field, where it is present, and where it is impossible."""
    v = floats(t, f.name)
    there = ~np.isnan(v)
    top = floats(t, f.below) if f.below else np.full(len(v), np.nan)
    with np.errstate(invalid="ignore"):
        bad = there & (np.isinf(v) | (v < f.least) | ((v <= 0) if f.positive else False) | (v >= top))
    return v, there, bad


#: Tag of the rows that bring a source's distributed median to its blocks.
_STATS = 1 << 30


def _measure(fields: list[Field], keys: list[str]):
    """What the medians of sources of several blocks are taken of: ``source, field, x`` (a first reading has no change, so x NaN)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, gid in whole_groups(batches, keys):
            tag = np.asarray(t.column("_tag").combine_chunks())
            core = tag == 0
            rows, names, values = [], [], []
            for k, f in enumerate(fields):
                v, there, bad = _values(t, f)
                i = np.flatnonzero(there & ~bad & (core | (tag & (2 << (2 * k)) > 0)))
                x = v[i]
                if f.spike == "jump":
                    x = np.abs(np.diff(x, prepend=np.nan))
                    x[np.r_[True, gid[i[1:]] != gid[i[:-1]]][: len(x)]] = np.nan
                rows.append(i[core[i]])
                names.append(np.full(len(rows[-1]), f.name, object))
                values.append(x[core[i]])
            at = pa.array(np.concatenate(rows))
            source = [k for k in keys if k != "_block"]
            yield pa.RecordBatch.from_arrays([*[t.column(k).combine_chunks().take(at) for k in source], pa.array(np.concatenate(names), pa.string()), pa.array(np.concatenate(values), pa.float64())], [*source, "field", "x"])

    return run


def _flag(fields: list[Field], keys: list[str], rec: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, gid in whole_groups(batches, keys):
            n_groups = int(gid[-1]) + 1
            tag = np.asarray(t.column("_tag").combine_chunks())
            core = tag == 0
            ids, names, kinds, scores = [], [], [], []
            for k, f in enumerate(fields):
                v, there, bad = _values(t, f)
                i = np.flatnonzero(there & (core | (tag & (1 << (2 * k)) > 0)))
                stuck = np.zeros(len(v), bool)
                stuck[i] = _stuck(gid[i], v[i], f.stuck)
                i = np.flatnonzero(there & ~bad & (core | (tag & (2 << (2 * k)) > 0)))
                g, w = gid[i], v[i]
                if f.spike == "ratio":
                    own = group_median(g, w, n_groups)
                else:
                    same = g[1:] == g[:-1]
                    own = group_median(g[1:][same], np.abs(np.diff(w))[same], n_groups)
                count = np.bincount(g, minlength=n_groups).astype(float)
                for told, mine in ((f"_unit_{f.name}", own), (f"_n_{f.name}", count)):
                    x = floats(t, told)
                    given = np.flatnonzero(~np.isnan(x))
                    mine[gid[given]] = x[given]
                judged = (count >= f.enough) & ~np.isnan(own)
                spike, score = np.zeros(len(v), bool), np.zeros(len(v))
                if len(w):
                    hit, sparse = _ratio_spikes(g, w, own, f) if f.spike == "ratio" else _jump_spikes(g, w, np.nan_to_num(own), judged, f)
                    spike[i] = hit & judged[g]
                    score[i] = np.where(judged[g], residual_scores(g, sparse, n_groups), 0.0)
                off = score > f.off
                found = np.flatnonzero(core & (bad | stuck | spike | off))
                ids.append(found)
                names.append(np.full(len(found), f.name, object))
                kinds.append(bad[found] + 2 * stuck[found] + 4 * spike[found] + 8 * off[found])
                scores.append(np.where(bad[found], np.nan, score[found]))
            at = pa.array(np.concatenate(ids))
            cols = [t.column(rec).combine_chunks().take(at), pa.array(np.concatenate(names), pa.string()), pa.array(np.concatenate(kinds).astype(np.int32)), pa.array(np.concatenate(scores), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(cols, ["rec_id", "field", "kind", "score"])

    return run


def _with_halo(long: DataFrame, cols: list[str], keys: list[str], order: list[str], fields: list[Field]) -> DataFrame:
    """The readings of ``long`` in their block (``_tag`` 0), and those next to a block's border in the blocks beyond it too, tagged by what they serve.

    Of each block the first and last readings of every kind are taken: as many
    present values as a stretch can need, and three usable ones for spikes.
    They go to the blocks in ``_prev`` and ``_next``, of which there are as many as a stretch
    needs, as a block may hold as little as one reading of a kind.
    """
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    x = long
    for side, w in {"next": down, "prev": up}.items():
        bits = F.lit(0)
        for k, f in enumerate(fields):
            there = F.col(f.name).isNotNull() & ~F.isnan(F.col(f.name).cast("double"))
            v = F.col(f.name).cast("double")
            bad = (F.abs(v) == float("inf")) | (v < f.least)
            if f.positive:
                bad = bad | (v <= 0)
            if f.below:
                bad = bad | F.coalesce(v >= F.col(f.below), F.lit(False))
            run = w.rowsBetween(Window.unboundedPreceding, 0)
            for bit, here, n in ((1 << (2 * k), there, f.stuck), (2 << (2 * k), there & ~bad, 3)):
                seen = F.sum(F.when(here, 1).otherwise(0)).over(run)
                bits = bits + F.when(here & (seen <= n), bit).otherwise(0)
        x = x.withColumn(f"_to_{side}", bits)
    place = lambda block, tag: F.struct(block.alias("_block"), tag.alias("_tag"))
    beyond = lambda side: F.filter(F.transform(f"_{side}", lambda b: place(b, F.col(f"_to_{side}"))), lambda p: p["_tag"] > 0)
    places = F.concat(F.array(place(F.col("_block"), F.lit(0))), beyond("next"), beyond("prev"))
    return x.select(*cols, F.inline(places))


def flag_readings(readings: DataFrame, source: list[str], order: list[str], rec: str, fields: list[Field], block: int = 16_384) -> DataFrame:
    """``rec_id, field, kind, score`` for every odd reading; kind adds 1 impossible, 2 stuck, 4 spike by the exact rule, 8 off the source's normal behaviour.

    ``score`` is the reading's sparse part in robust scales of its source (of the block, for sources of several), NULL for
    impossible readings; kind 8 means a score above ``Field.off``. ``readings`` has one row per reading; the first ``order`` column is an
    integer that cuts sources into blocks of ``block`` units, the last one makes the order
    total. NULL and NaN values are missing: never flagged and
    passed over. Rows with a NULL source are not judged; a NULL order stands
    first. Empty input gives no rows.
    """
    cols = list(dict.fromkeys([*source, *order, rec, *[f.name for f in fields], *[f.below for f in fields if f.below]]))
    present = F.lit(False)
    for f in fields:
        present = present | (F.col(f.name).isNotNull() & ~F.isnan(F.col(f.name).cast("double")))
    for c in source:
        present = present & F.col(c).isNotNull()
    keys = [*source, "_block"]
    at = F.coalesce(F.floor(F.col(order[0]) / block).cast("bigint"), F.lit(-(1 << 62)))
    r = readings.select(*cols, at.alias("_block")).where(present)
    # one row per block of a source of several; the readings of a source of one block need nothing from others
    line = Window.partitionBy(*source).orderBy("_block")
    reach = max([f.stuck for f in fields] + [3])
    several = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    for side, a, b in (("_next", 1, reach), ("_prev", -reach, -1)):
        several = several.withColumn(side, F.collect_list("_block").over(line.rowsBetween(a, b)))
    several = several.where((F.size("_next") > 0) | (F.size("_prev") > 0))
    parts = _with_halo(r.join(several, keys), cols, keys, order, fields)
    kinds = ", ".join(f"`{k}` {dict(r.dtypes)[k]}" for k in source)
    # every reading of such a source is measured once, in its own block
    changes = parts.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_measure(fields, keys), f"{kinds}, field string, x double")
    of = lambda f, c: F.max(F.when(F.col("field") == f.name, F.col(c)))
    # n readings have n - 1 changes
    by_field = [c for f in fields for c in (of(f, "median").alias(f"_unit_{f.name}"), (of(f, "n_rows") + int(f.spike == "jump")).cast("double").alias(f"_n_{f.name}"))]
    stats = exact_medians(changes, [*source, "field"], "x", every=0).groupBy(*source).agg(*by_field)
    # the medians travel to the blocks as rows, so no reading is shuffled for them
    stats = stats.join(several.select(*keys), source).withColumn("_tag", F.lit(_STATS))
    halo = parts.where("_tag > 0")
    whole = r.withColumn("_tag", F.lit(0)).unionByName(halo).unionByName(stats, allowMissingColumns=True)
    parts = whole.repartition(*keys).sortWithinPartitions(*keys, *order)
    return parts.mapInArrow(_flag(fields, keys, rec), "rec_id bigint, field string, kind int, score double")
